"""The security view of the `events` table: the same expressions run on Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = """
 event_id, event_id + 1 AS seq, ts,
 CASE event_type WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'authentication'
   WHEN 'purchase' THEN 'cloud' WHEN 'view' THEN 'network' ELSE 'process' END AS category,
 CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_success'
   WHEN 'purchase' THEN 'AssumeRole' WHEN 'view' THEN 'http_request' ELSE 'process_start' END
  || CASE WHEN event_id % 97 = 0 THEN '_rare' || CAST(event_id % 5 AS STRING) ELSE '' END AS action,
 CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
 CASE WHEN user_id % 19 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING) END AS user_name,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'h' || CAST(user_id * 3 + event_id % 4 AS STRING) END AS host,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE
   CASE WHEN user_id % 6 = 0 THEN '203.0.113.'
        ELSE '10.' || CAST(user_id % 8 AS STRING) || '.' || CAST(user_id % 250 AS STRING) || '.' END
   || CAST((user_id + event_id % 3) % 250 AS STRING) END AS src_ip,
 CASE WHEN event_type = 'purchase' THEN 'acct' || CAST(user_id % 4 AS STRING) END AS cloud_account,
 'src' || CAST(user_id % 5 AS STRING) AS source,
 CASE WHEN event_type = 'click' THEN 'cmd.exe /c step' || CAST(event_id % 13 AS STRING)
   || CASE WHEN event_id % 11 = 0 THEN ' -enc SQBF' ELSE '' END END AS command_line,
 CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'powershell.exe' ELSE 'cmd.exe' END END AS process_name,
 value, props"""

#: Oracle CTEs: v is the view, with us (microseconds); x has a row for each entity of an event, in entity order.
V = f"v AS (SELECT *, epoch_us(ts) AS us FROM (SELECT {FIELDS} FROM events))"
ENTITY_LIST = """list_filter([CASE WHEN trim(user_name) <> '' THEN 'user:' || user_name END, CASE WHEN trim(host) <> '' THEN 'host:' || host END,
  CASE WHEN trim(src_ip) <> '' THEN 'ip:' || src_ip END, CASE WHEN trim(cloud_account) <> '' THEN 'cloud_account:' || cloud_account END], lambda e: e IS NOT NULL)"""
X = f"""{V}, ve AS (SELECT *, {ENTITY_LIST} AS entities FROM v),
x AS (SELECT * EXCLUDE (entities), split_part(entity, ':', 1) AS kind, hour(ts) AS hour FROM (SELECT *, unnest(entities) AS entity FROM ve))"""


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def entities_of(*fields: tuple[str, str]) -> Column:
    """The entity keys kind:value of the fields (kind, column) that aren't blank, in that order."""
    return F.array_compact(F.array(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{kind}:"), F.col(c))) for kind, c in fields]))


ENTITY_FIELDS = (("user", "user_name"), ("host", "host"), ("ip", "src_ip"), ("cloud_account", "cloud_account"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with security fields, us (microseconds) and entities; seq is the arrival order."""
    rows = spark.sql(f"SELECT {FIELDS} FROM {{raw}}", raw=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.withColumn("us", micros()).withColumn("entities", entities_of(*ENTITY_FIELDS))


def by_entity(events: DataFrame) -> DataFrame:
    """A row for each event and entity: entity and kind besides the event's columns."""
    return events.withColumn("entity", F.explode("entities")).withColumn("kind", kind_of(F.col("entity")))


def kind_of(entity: Column) -> Column:
    return F.substring_index(entity, ":", 1)


def value_of(entity: Column) -> Column:
    return F.when(entity.contains(":"), F.regexp_replace(entity, "^[^:]*:", "")).otherwise(entity)
