"""Tables that deliveries fill exactly once: keyed rows, lines with a quarantine, and an archive by day of ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BatchLog


def stable_key(tenant: Column, row: Column) -> Column:
    """The key of a row at every destination: the SHA-256 of the JSON list of tenant and id."""
    return F.sha2(F.to_json(F.array(tenant, row)), 256)


class Versions:
    """Named parts of a folder, appended by version; only versions in the batch log are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), BatchLog(spark, path.rstrip("/"))

    def write(self, part: str, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/version={version}")

    def read(self, part: str, schema: str, before: int | None = None) -> DataFrame:
        """A part's rows, of the versions before a given one or all, with their version."""
        done = [v for v in self.log.versions() if before is None or v < before]
        wanted = self.spark.createDataFrame([], f"{schema}, version int")
        if not done:
            return wanted
        try:
            found = self.spark.read.schema(f"{schema}, version int").parquet(f"{self.path}/{part}")
        except AnalysisException:  # no version wrote this part
            return wanted
        return found.where(F.col("version").isin(done))


class KeyedTable(Versions):
    """Rows under (tenant, id), each written once: the same content again changes nothing, other content is a conflict that is reported and not written."""

    STORED, REPORT = "tenant string, id string, seq long, content string, hash string", "tenant string, id string, seq long, status string"

    def put(self, stream: str, batch: int, rows: DataFrame) -> int:
        """Deliver rows (tenant, id, seq, content); of several contents under one key the first by seq counts."""
        version = self.log.begin(stream, batch)
        rows = rows.withColumn("hash", F.sha2("content", 256))
        held = self.read("rows", self.STORED, version).select("tenant", "id", F.col("hash").alias("held"))
        first = rows.groupBy("tenant", "id").agg(F.min_by("hash", "seq").alias("first"), F.min("seq").alias("at"))
        judged = rows.join(first, ["tenant", "id"]).join(held, ["tenant", "id"], "left")
        status = F.when(F.col("hash") != F.coalesce("held", "first"), "conflict").when(F.col("held").isNull() & (F.col("seq") == F.col("at")), "new").otherwise("same")
        judged = judged.withColumn("status", status)
        self.write("report", version, judged.select("tenant", "id", "seq", "status"))
        self.write("rows", version, judged.where("status = 'new'").select("tenant", "id", "seq", "content", "hash"))
        self.log.done(stream, batch, version)
        return version

    def rows(self) -> DataFrame:
        return self.read("rows", self.STORED)

    def report(self) -> DataFrame:
        return self.read("report", self.REPORT)


class Lines(Versions):
    """Lines (seq, line) that go on, and those set aside until they are mended; a line is in one of the two, and counts once."""

    SCHEMA = "seq long, line string"

    def put(self, stream: str, batch: int, rows: DataFrame, good: Column) -> int:
        version = self.log.begin(stream, batch)
        told = rows.select("seq", "line").withColumn("_good", F.coalesce(good, F.lit(False)))
        self.write("main", version, told.where("_good").drop("_good"))
        self.write("aside", version, told.where("NOT _good").drop("_good"))
        self.log.done(stream, batch, version)
        return version

    def aside(self, before: int | None = None) -> DataFrame:
        """Lines set aside and not taken back since."""
        taken = self.read("taken", "seq long", before).select("seq")
        return self.read("aside", self.SCHEMA, before).select("seq", "line").join(taken, "seq", "left_anti")

    def requeue(self, stream: str, batch: int, mended: Column, good: Column) -> int:
        """Take back the lines set aside that are good once mended; the others stay aside."""
        version = self.log.begin(stream, batch)
        back = self.aside(version).withColumn("line", mended).where(good)
        self.write("main", version, back)
        self.write("taken", version, back.select("seq"))
        self.log.done(stream, batch, version)
        return version

    def main(self) -> DataFrame:
        return self.read("main", self.SCHEMA).select("seq", "line")


class Projection(Versions):
    """An outbox and what each destination has received of it: each destination gets each (tenant, id) once, under a stable key.

    A delivery and its receipts are one part of one version, so both count once its row of the batch log is
    written; a delivery cut off before that is made again under the same version, in place of what it left.
    """

    ROWS = "key string, tenant string, id string, seq long, content string"

    def put(self, stream: str, batch: int, rows: DataFrame) -> int:
        """Add rows (tenant, id, seq, content) to the outbox; of one key, the first by seq, and none that lies in it."""
        version = self.log.begin(stream, batch)
        keyed = rows.withColumn("key", stable_key(F.col("tenant"), F.col("id")))
        first = keyed.groupBy("key").agg(F.min_by(F.struct("tenant", "id", "seq", "content"), F.struct("seq", "content")).alias("r")).select("key", "r.*")
        self.write("outbox", version, first.join(self.read("outbox", self.ROWS, version).select("key"), "key", "left_anti").select("key", "tenant", "id", "seq", "content"))
        self.log.done(stream, batch, version)
        return version

    def pending(self, destination: str, before: int | None = None) -> DataFrame:
        """Rows of the outbox that the destination has no receipt for."""
        receipts = self.read(f"delivered-{destination}", self.ROWS, before).select("key")
        return self.read("outbox", self.ROWS, before).drop("version").join(receipts, "key", "left_anti")

    def deliver(self, destination: str, batch: int, limit: int | None = None) -> int:
        """Deliver what is pending, the oldest by seq first; a limit is the size of a batch that the destination asks for."""
        version = self.log.begin(f"deliver-{destination}", batch)
        rows = self.pending(destination, version)
        rows = rows if limit is None else rows.orderBy("seq", "key").limit(limit)
        self.write(f"delivered-{destination}", version, rows.select("key", "tenant", "id", "seq", "content"))
        self.log.done(f"deliver-{destination}", batch, version)
        return version

    def delivered(self, destination: str) -> DataFrame:
        return self.read(f"delivered-{destination}", self.ROWS)

    def backlog(self, *destinations: str) -> DataFrame:
        """destination, tenant, pending and the oldest pending seq; a tenant without any has no row."""
        each = [self.pending(d).groupBy("tenant").agg(F.count("*").alias("pending"), F.min("seq").alias("oldest")).withColumn("destination", F.lit(d)) for d in destinations]
        return reduce(DataFrame.unionByName, each).select("destination", "tenant", "pending", "oldest")


class Archive(Versions):
    """Raw lines by day of ingest, with the range of seq that each day of each append holds, so replays read only the days they need."""

    LINES, RANGES = "seq long, line string, ingest_date date", "ingest_date date, first long, last long, n long"

    def append(self, stream: str, batch: int, rows: DataFrame) -> int:
        """rows: seq, line and ingest_date; each day's lines of an append lie in a partition of their own."""
        version = self.log.begin(stream, batch)
        rows.select("seq", "line", "ingest_date").write.mode("overwrite").partitionBy("ingest_date").parquet(f"{self.path}/lines/version={version}")
        self.write("ranges", version, rows.groupBy("ingest_date").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n")))
        self.log.done(stream, batch, version)
        return version

    def _days(self, ranges: DataFrame) -> list:
        return sorted({r[0] for r in ranges.select("ingest_date").collect()})  # one a day

    def _lines(self, days: list) -> DataFrame:
        return self.read("lines", self.LINES).where(F.col("ingest_date").isin(days)) if days else self.read("lines", self.LINES).limit(0)

    def since(self, seq: int) -> DataFrame:
        """The lines from a seq on, out of the days that hold any."""
        return self._lines(self._days(self.read("ranges", self.RANGES).where(F.col("last") >= seq))).where(F.col("seq") >= seq).select("seq", "line", "ingest_date")

    def last(self, n: int) -> DataFrame:
        """The last n lines by seq (a top-k report), out of the days that can hold any."""
        ranges = sorted(self.read("ranges", self.RANGES).collect(), key=lambda r: -r["last"])
        days, held, floor = set(), 0, None
        for r in ranges:  # days in falling order of their last seq, until those that lie wholly above the rest hold n
            if floor is not None and r["last"] < floor:
                break
            days.add(r["ingest_date"])
            held += r["n"]
            if held >= n and floor is None:
                floor = min(x["first"] for x in ranges if x["ingest_date"] in days)
        return self._lines(sorted(days)).orderBy(F.desc("seq")).limit(n).select("seq", "line", "ingest_date")
