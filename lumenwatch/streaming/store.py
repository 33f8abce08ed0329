"""Stored tables that micro-batches change, each batch once.

A store is a folder of versions. A batch reads the version before it, writes its own, and then a row of the
batch log (stream, batch, version); only versions in the log count. A batch that runs again, since the driver
or its executors were lost before or after that row, finds its own row, or none, and writes the same version
over. Everything is read and written by Spark, so a store may lie wherever Spark can write.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incidents import MAX_FINDINGS, WINDOW_US, merged

LOG = "stream string, batch long, version long"


class BatchLog:
    """Which batches of which streams are done, and the version that each made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException:  # none is written yet
            return self.spark.createDataFrame([], LOG)

    def versions(self) -> list[int]:
        return sorted(r[0] for r in self.rows().select("version").distinct().collect())  # a number a batch

    def begin(self, stream: str, batch: int) -> int:
        """The version that this batch makes: its own if it ran before, else the next."""
        own = self.rows().where((F.col("stream") == stream) & (F.col("batch") == batch)).select("version").first()
        return own[0] if own else max(self.versions(), default=0) + 1

    def done(self, stream: str, batch: int, version: int) -> None:
        row = self.spark.createDataFrame([(stream, batch, version)], LOG)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/at={version}")


class IncidentStore:
    """Incidents with their findings: findings are appended by version, incidents are a table a version."""

    #: Columns of findings, and of incidents.
    FINDING = "incident_key string, finding_id string, event_id long, rule_id string, severity int, risk_points int, techniques array<string>, entities array<string>, seq long, us long"
    INCIDENT = "incident_key string, risk_score long, severity int, findings long, anomalies long, first_us long, last_us long, entities array<string>, primary_entity string, kill_chain array<string>, title string, span string, status string, created_us long, material boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), BatchLog(spark, path.rstrip("/"))

    def findings(self, version: int | None = None) -> DataFrame:
        """All findings up to a version (the last by default), with their incident and fate."""
        versions = [v for v in self.log.versions() if version is None or v <= version]
        schema = f"{self.FINDING}, fate string"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/findings/version={v}" for v in versions]) if versions else self.spark.createDataFrame([], schema)

    def incidents(self, version: int | None = None) -> DataFrame:
        versions = [v for v in self.log.versions() if version is None or v <= version]
        return self.spark.read.schema(self.INCIDENT).parquet(f"{self.path}/incidents/version={versions[-1]}") if versions else self.spark.createDataFrame([], self.INCIDENT)

    def put(self, stream: str, batch: int, found: DataFrame, window_us: int = WINDOW_US, limit: int = MAX_FINDINGS) -> int:
        """Merge a batch of findings into the incidents of the version before; the version made."""
        version = self.log.begin(stream, batch)
        held = self.findings(version - 1).where("fate <> 'redelivered'").drop("fate")
        columns = [c.split()[0] for c in self.FINDING.split(", ")]
        new, after = merged(self.incidents(version - 1).drop("material"), held, found, window_us, limit, str(version))
        new.select(*columns, "fate").write.mode("overwrite").parquet(f"{self.path}/findings/version={version}")
        after.select(*[F.col(k).cast(t).alias(k) for k, t in (c.split() for c in self.INCIDENT.split(", "))]).write.mode("overwrite").parquet(f"{self.path}/incidents/version={version}")
        self.log.done(stream, batch, version)
        return version

    def close(self, keys: DataFrame, status: str = "closed", stream: str = "triage", batch: int = 0) -> int:
        """A version in which these incidents (incident_key) have another status."""
        version = self.log.begin(stream, batch)
        rows = self.incidents(version - 1).join(keys.select("incident_key", F.lit(status).alias("_new")), "incident_key", "left")
        rows.withColumn("status", F.coalesce("_new", "status")).drop("_new").write.mode("overwrite").parquet(f"{self.path}/incidents/version={version}")
        self.spark.createDataFrame([], f"{self.FINDING}, fate string").write.mode("overwrite").parquet(f"{self.path}/findings/version={version}")
        self.log.done(stream, batch, version)
        return version
