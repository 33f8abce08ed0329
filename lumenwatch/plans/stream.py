"""Registered streaming queries: what a stream gives once it has drained the events, with the batch form's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES
from ..operators.detection import evaluate
from ..sources import events as view
from ..streaming import jobs
from .behaviour import BURST_US, SIGNALS

DAY = 86_400_000_000


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, jobs.arriving(spark, f"{sf_dir}/events.parquet"))


def _seen(spark: SparkSession, raw: DataFrame) -> DataFrame:
    rows = spark.sql(f"SELECT {view.FIELDS} FROM {{raw}}", raw=raw)
    return rows.withColumn("us", view.micros()).withColumn("at", F.timestamp_micros("us")).withColumn("entities", view.entities_of(*view.ENTITY_FIELDS))


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.health(_stream(spark, sf_dir)), "complete")


def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice and counted once."""
    twice = _stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select("event_id", "at", "source")
    return jobs.drained(jobs.without_duplicates(twice, "event_id")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir).where("outcome = 'failure'").withColumn("entity", F.explode("entities"))
    return jobs.drained(jobs.sessions(rows, "entity"), "complete")


def arrivals(spark: SparkSession, sf_dir: str, files: int, late: bool = False) -> DataFrame:
    """The events as a stream of files that come one in a micro-batch, in order of arrival; late: the second quarter of the files' span comes last, and the first file twice."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    where = jobs.folder(spark, "arrivals")
    top = rows.agg(F.max("event_id")).first()[0] or 0
    part = F.floor(F.col("event_id") * files / (top + 1))
    order = [*range(files)] if not late else [i for i in range(files) if i != 1] + [1, 0]
    for place, i in enumerate(order):
        rows.where(part == i).repartition(1).write.option("parquet.block.size", 2 << 20).parquet(f"{where}/{place:03d}")  # one file, which is read in parts
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/*")
    return _seen(spark, stream)


def stream_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drained(jobs.repeats(arrivals(spark, sf_dir, 4).where("user_name IS NOT NULL"), ["outcome", "user_name"], DAY, 5))


def stream_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir, 4).withColumn("entity", F.explode("entities"))
    return jobs.drained(jobs.novelty(rows, "entity", "action"))


def stream_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five signals of each entity's own past over events that come in four files, one a micro-batch."""
    return jobs.drained(jobs.signals(arrivals(spark, sf_dir, 4), BURST_US))


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that come in three files, the second quarter of them late and the first again, merged into the incidents that the batches before stored: each finding with its incident and fate."""
    store = jobs.stored_incidents(evaluate(arrivals(spark, sf_dir, 3, late=True), RULES))
    return store.findings().select("finding_id", "incident_key", "fate")


QUERIES = [stream_merge, stream_signals, stream_health, stream_redelivery, stream_sessions, stream_repeats, stream_novelty]
SQL = {
    "stream_signals": f"WITH {SIGNALS} SELECT event_id, seq, entity, signal, CAST(points AS BIGINT) AS points FROM s WHERE signal IN ('novel_action', 'novel_src_ip', 'novel_host', 'off_hours', 'burst')",
    "stream_health": f"WITH {view.V} SELECT us // {DAY} * {DAY} AS start_us, coalesce(source, 'unknown') AS source, count(*) AS n, max(us) AS last_us FROM v GROUP BY 1, 2",
    "stream_redelivery": f"WITH {view.V} SELECT source, count(*) AS n, count(*) AS ids FROM v GROUP BY 1",
    "stream_sessions": f"""WITH {view.X}, g AS (SELECT entity, us, CASE WHEN us - lag(us) OVER (PARTITION BY entity ORDER BY us) <= {DAY} THEN 0 ELSE 1 END AS s FROM x WHERE outcome = 'failure'),
e AS (SELECT entity, us, sum(s) OVER (PARTITION BY entity ORDER BY us) AS ep FROM g) SELECT entity, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM e GROUP BY entity, ep""",
    "stream_repeats": f"""WITH {view.V}, n AS (SELECT event_id, row_number() OVER (PARTITION BY outcome, user_name ORDER BY us, seq)
  - count(*) OVER (PARTITION BY outcome, user_name ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY + 1} PRECEDING) AS repeat_count FROM v WHERE user_name IS NOT NULL)
SELECT event_id, repeat_count, repeat_count > 5 AS repeated FROM n""",
    "stream_novelty": f"""WITH {view.X} SELECT event_id, entity AS key, action AS value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS r, row_number() OVER (PARTITION BY entity, action ORDER BY seq) AS ra FROM x) WHERE r > 1 AND ra = 1""",
}
