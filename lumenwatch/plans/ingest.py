"""Registered queries of ingest: lines of several formats written from the events, parsed and normalized again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import graph, reports
from ..sources import lines, mappers
from ..sources.events import V, security_events
from ..streaming.tables import Archive, KeyedTable, Lines, Projection

#: A line for each event, in the format of its kind; the same expression on both engines.
LINE = """CASE category
  WHEN 'process' THEN '{"User": "' || coalesce(user_name, ' ') || '", "Action": "' || action || '", "severity": ' || CAST(event_id % 101 AS STRING) || ', "Result": "OK", "cmdline": "' || command_line || '", "time": ' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE '"' || CAST(event_id AS STRING) || '"' END || '}'
  WHEN 'cloud' THEN 'CEF:0|acme|gate|1.0|100|' || action || '|7|src=' || coalesce(src_ip, '') || ' suser=' || coalesce(user_name, '') || ' msg=role taken in ' || cloud_account || ' outcome=Success'
  WHEN 'network' THEN '<' || CAST(event_id % 192 AS STRING) || '>Jan  2 03:04:05 ' || coalesce(host, 'nohost') || ' connection number ' || CAST(event_id AS STRING)
  WHEN 'authentication' THEN CASE WHEN outcome = 'failure' THEN '{"username": "' || coalesce(user_name, '') || '", "message": "login failed", "level": "High", "hostname": "' || coalesce(host, '') || '"}'
    ELSE 'password accepted for ' || coalesce(user_name, 'nobody') END END"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_events(spark, sf_dir).select("seq", F.expr(LINE).alias("line"))


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalized(lines.records(raw_lines(spark, sf_dir))).select("seq", "format", "category", "action", "outcome", "user_name", "host", "src_ip", "message", "severity", "command_line", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts_defaulted")


#: Lines that logins, gateways and collectors write, one of five forms by event; the same expression on both engines.
OTHER_LINE = """CASE event_id % 5
  WHEN 0 THEN '<86>1 2024-03-05T06:07:08Z ' || coalesce(host, '-') || ' sshd 7 - - ' || CASE WHEN outcome = 'failure' THEN 'Failed password for invalid user ' ELSE 'Accepted password for ' END || coalesce(user_name, 'nobody') || ' from ' || coalesce(src_ip, '0.0.0.0') || ' port 22'
  WHEN 1 THEN '<' || CAST(event_id % 192 AS STRING) || '>1 2024-03-05T06:07:08+01:00 gw app 1 ID [x@1 k="v"] CEF:0|acme|gate|2.1|7|' || action || '|' || CAST(event_id % 13 AS STRING) || '|rt=1700000000 dhost=' || coalesce(host, 'h0') || ' shost=other duser=target suser=' || coalesce(user_name, 'nobody') || ' msg=' || CASE WHEN outcome = 'failure' THEN 'request denied' ELSE 'request granted' END
  WHEN 2 THEN '[{"username": "' || coalesce(user_name, '') || '", "severity": 0, "risk": "high", "eventtime": "2024-01-01T00:00:00Z"}, {"actor": "second", "file.hash": "abc", "channel": "Security", "severity": 95.5}]'
  WHEN 3 THEN '{"nested": {"a": [1, {"b": "}}"}]}, "operation": "Read", "target": "t' || CAST(event_id % 7 AS STRING) || '", "tenantId": "x", "status": "OK", "@timestamp": ' || CAST(1700000000 + event_id AS STRING) || '}'
  ELSE '{"deep": ' || repeat('[', 70) || repeat(']', 70) || '}' END"""


def parse_other_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins over syslog, CEF inside syslog, arrays of objects, nested and too deep JSON, normalized."""
    rows = normalize.normalized(lines.records(security_events(spark, sf_dir).select("seq", F.expr(OTHER_LINE).alias("line"))))
    return rows.select("seq", "format", "source", "user_name", "host", "src_ip", "outcome", "action", "resource", "cloud_account", "hashes", "log_product", "log_service", "severity", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def syslog_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = lines.Fields("pri", "timestamp")
    rows = look.of(lines.records(raw_lines(spark, sf_dir)).where("format = 'syslog'"))
    facility, severity = lines.priority(look.field("pri"))
    at = lines.without_year(look.field("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return rows.select(facility.alias("facility"), severity.alias("severity"), at.alias("at")).groupBy("facility", "severity", "at").agg(F.count("*").alias("n"))


#: Records of one export at most.
EXPORT = 1 << 12


def cloud_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of {"Records": [...]} for each source and run of EXPORT events, exploded and mapped."""
    events = security_events(spark, sf_dir).where("category = 'cloud'")
    arn = F.concat(F.lit("arn:aws:iam::1:user/"), F.coalesce("user_name", F.lit("root")))
    role = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("arn:aws:iam::1:role/"), "source"))
    record = F.struct(
        F.col("seq").cast("string").alias("eventID"), F.col("action").alias("eventName"), F.struct(arn.alias("arn"), F.col("cloud_account").alias("accountId")).alias("userIdentity"), F.col("src_ip").alias("sourceIPAddress"),
        F.when(F.col("value") > 150, "AccessDenied").alias("errorCode"), F.struct(role.alias("roleArn"), F.col("outcome").alias("roleName")).alias("requestParameters"),
    )
    files = events.groupBy("source", F.floor(F.col("seq") / EXPORT).alias("part")).agg(F.to_json(F.struct(F.collect_list(record).alias("Records"))).alias("body"))
    return mappers.cloudtrail(mappers.exported(files)).select(F.col("record_id").cast("long").alias("seq"), "action", "user_name", "src_ip", "cloud_account", "outcome", "resource", "log_service")


def new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay suppression: polled records whose id was seen before are dropped, records without an id never."""
    events = security_events(spark, sf_dir)
    polled = events.select(F.col("host").alias("record_id"), "seq")
    seen = events.where("category = 'network' AND host IS NOT NULL").select(F.col("host").alias("record_id")).distinct()
    fresh = polled.where("record_id IS NOT NULL").join(seen, "record_id", "left_anti").groupBy("record_id").agg(F.min("seq").alias("seq"))
    return fresh.unionByName(polled.where("record_id IS NULL"))


def _archive(spark: SparkSession, sf_dir: str) -> Archive:
    """The raw lines in two appends, by the day of their event."""
    rows = security_events(spark, sf_dir).select("seq", F.expr(LINE).alias("line"), F.to_date("ts").alias("ingest_date"))
    archive = Archive(spark, f"{graph.scratch(spark)}/archive-{uuid.uuid4().hex}")
    archive.append("first", 0, rows.where("seq % 3 > 0"))
    archive.append("second", 0, rows.where("seq % 3 = 0"))
    return archive


def archive_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines archived by day and replayed from the middle of the sequence."""
    archive = _archive(spark, sf_dir)
    middle = archive.read("ranges", archive.RANGES).agg(F.floor(F.max("last") / 2)).first()[0]
    return archive.since(middle).select("seq", "line")


def archive_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 archived lines (a top-k report) with the day they came."""
    return _archive(spark, sf_dir).last(500).select("seq", F.col("ingest_date").cast("string").alias("day"))


def persist_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures are stored first; then all events come, rare ones with other content, and that delivery comes twice: how each row fared by delivery."""
    events = security_events(spark, sf_dir).select(F.col("source").alias("tenant"), F.col("event_id").cast("string").alias("id"), "seq", "outcome", F.concat_ws("|", "action", "user_name", "host").alias("content"))
    changed = events.withColumn("content", F.when(F.col("content").contains("_rare"), F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    table = KeyedTable(spark, f"{graph.scratch(spark)}/keyed-{uuid.uuid4().hex}")
    for i, rows in enumerate((events.where("outcome = 'failure'"), changed, changed)):
        table.put("deliveries", i, rows)
    stored = table.rows().groupBy("version").agg(F.count("*").alias("n")).select("version", F.lit("stored").alias("status"), "n")
    return table.report().groupBy("version", "status").agg(F.count("*").alias("n")).unionByName(stored)


def requeued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that start like JSON and don't parse go aside; those of one step are mended and requeued, twice: what has gone on and what is still aside."""
    rows = raw_lines(spark, sf_dir).withColumn("line", F.when(F.col("line").rlike("step1?1 "), F.regexp_replace("line", '^."', "{")).otherwise(F.col("line")))
    good = ~F.col("line").startswith("{") | F.try_parse_json("line").isNotNull()
    lines = Lines(spark, f"{graph.scratch(spark)}/lines-{uuid.uuid4().hex}")
    lines.put("arrivals", 0, rows.where("seq % 2 = 0"), good)
    lines.put("arrivals", 1, rows.where("seq % 2 = 1"), good)
    mended = F.when(F.col("line").contains("step11 "), F.regexp_replace("line", r"^\{", '{"')).otherwise(F.col("line"))
    for i in range(2):
        lines.requeue("requeue", i, mended, good)
    return lines.main().select("seq", F.lit("main").alias("sink")).unionByName(lines.aside().select("seq", F.lit("aside").alias("sink")))


def projection_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows that a destination has no receipt for, by stable key."""
    events = security_events(spark, sf_dir)
    key = F.sha2(F.concat(F.lit('["tenant-1","'), F.col("event_id").cast("string"), F.lit('"]')), 256)
    outbox = events.select(key.alias("key"), "source", "us")
    receipts = events.where("outcome = 'success'").select(key.alias("key"))
    return outbox.join(receipts, "key", "left_anti").groupBy("source").agg(F.count("*").alias("backlog"), F.min("us").alias("oldest_us"))


def projection_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries to one destination and one to another, the outbox growing between them and a delivery coming twice: what each has, in which of the versions, and what it lacks."""
    events = security_events(spark, sf_dir).select(F.col("source").alias("tenant"), F.col("event_id").cast("string").alias("id"), "seq", F.col("action").alias("content"))
    path = f"{graph.scratch(spark)}/feed-{uuid.uuid4().hex}"
    feed = Projection(spark, path)
    feed.put("events", 0, events.where("seq % 3 = 0"))
    feed.deliver("search", 0)
    feed.put("events", 1, events.where("seq % 3 <> 1"))
    feed = Projection(spark, path)  # a driver started anew
    for batch in (1, 1):
        feed.deliver("search", batch)
    feed.deliver("warehouse", 0)
    feed.put("events", 2, events)
    out = [feed.delivered(d).groupBy(F.lit(d).alias("destination"), "tenant", F.col("version").cast("string").alias("state")).agg(F.count("*").alias("n"), F.min("seq").alias("oldest"), F.min("key").alias("first_key")) for d in ("search", "warehouse")]
    late = feed.backlog("search", "warehouse").select("destination", "tenant", F.lit("pending").alias("state"), F.col("pending").alias("n"), "oldest", F.lit(None).cast("string").alias("first_key"))
    return out[0].unionByName(out[1]).unionByName(late)


def metric_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram exposition of the events' values by source: cumulative buckets, sum and count."""
    limits = [10.0, 50.0, 100.0, 200.0]
    rows = security_events(spark, sf_dir).groupBy("source").agg(*[F.count_if(F.col("value") <= x).alias(f"le_{int(x)}") for x in limits], F.count("*").alias("le_inf"), F.round(F.sum("value"), 2).alias("total"))
    return rows


def metric_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as exposition rows of histograms: by source, and by source and outcome."""
    events = security_events(spark, sf_dir)
    one = reports.exposition(events, "event_value", "value", [10.0, 50.0, 100.0, 200.0], "source")
    return one.unionByName(reports.exposition(events, "outcome_value", "value", [0.5, 150.0], "source", "outcome"))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine: lines that start like JSON but don't parse go aside, all others go on."""
    rows = raw_lines(spark, sf_dir).withColumn("line", F.when(F.col("line").contains("step1 "), F.regexp_replace("line", '^."', "{")).otherwise(F.col("line")))
    bad = F.col("line").startswith("{") & F.try_parse_json("line").isNull()
    return rows.select("seq", F.when(bad, "quarantine").otherwise("main").alias("sink"))


_SEV = "CASE WHEN event_id % 101 >= 90 THEN 100 WHEN event_id % 101 >= 70 THEN 75 WHEN event_id % 101 >= 40 THEN 50 WHEN event_id % 101 > 0 THEN 25 ELSE 0 END"
QUERIES = [metric_exposition, projection_feed, archive_tail, requeued_lines, parse_lines, parse_other_lines, syslog_priorities, cloud_records, new_records, archive_replay, persist_conflicts, projection_backlog, metric_buckets, dead_letters]
SQL = {
    "parse_lines": f"""WITH {V} SELECT seq, CASE category WHEN 'process' THEN 'json' WHEN 'cloud' THEN 'cef' WHEN 'network' THEN 'syslog' ELSE CASE WHEN outcome = 'failure' THEN 'json' ELSE 'message' END END AS format,
  CASE category WHEN 'process' THEN 'process' WHEN 'cloud' THEN CASE WHEN contains(lower(action), 'assumerole') THEN 'cloud' END WHEN 'network' THEN 'network' ELSE 'authentication' END AS category,
  CASE category WHEN 'process' THEN action WHEN 'cloud' THEN 'observed' WHEN 'network' THEN 'network_connection' ELSE CASE WHEN outcome = 'failure' THEN 'login_failed' ELSE 'login_success' END END AS action,
  CASE category WHEN 'process' THEN 'ok' WHEN 'cloud' THEN 'success' ELSE 'unknown' END AS outcome,
  CASE WHEN category IN ('process', 'cloud') OR outcome = 'failure' THEN user_name END AS user_name,
  CASE WHEN category = 'network' THEN coalesce(host, 'nohost') WHEN outcome = 'failure' THEN host END AS host, CASE WHEN category = 'cloud' THEN src_ip END AS src_ip,
  CASE category WHEN 'cloud' THEN action WHEN 'network' THEN 'connection number ' || event_id WHEN 'authentication' THEN CASE WHEN outcome = 'failure' THEN 'login failed' ELSE 'password accepted for ' || coalesce(user_name, 'nobody') END ELSE '' END AS message,
  CASE WHEN category = 'process' THEN {_SEV} WHEN category = 'cloud' OR outcome = 'failure' THEN 75 WHEN category = 'network' THEN CAST(([100, 100, 100, 75, 50, 25, 25, 0])[event_id % 8 + 1] AS INTEGER) ELSE 0 END AS severity, CASE WHEN category = 'process' THEN command_line END AS command_line,
  CASE category WHEN 'process' THEN CASE WHEN event_id % 2 = 0 THEN event_id * 1000000 ELSE 0 END WHEN 'network' THEN epoch_us(TIMESTAMP '1969-01-02 03:04:05') ELSE 0 END AS us,
  NOT (category = 'network' OR (category = 'process' AND event_id > 0 AND event_id % 2 = 0)) AS ts_defaulted FROM v""",
    "parse_other_lines": f"""WITH {V}, k AS (SELECT *, event_id % 5 AS k FROM v) SELECT seq, CASE k WHEN 0 THEN 'syslog' WHEN 1 THEN 'syslog+cef' WHEN 4 THEN 'json-too-deep' ELSE 'json' END AS format, CASE k WHEN 1 THEN 'acme' ELSE 'unknown' END AS source,
  CASE WHEN k < 2 THEN coalesce(user_name, 'nobody') WHEN k = 2 THEN user_name END AS user_name, CASE k WHEN 0 THEN host WHEN 1 THEN coalesce(host, 'h0') END AS host, CASE k WHEN 0 THEN coalesce(src_ip, '0.0.0.0') END AS src_ip,
  CASE WHEN k < 2 THEN outcome WHEN k = 3 THEN 'ok' ELSE 'unknown' END AS outcome, CASE k WHEN 0 THEN CASE WHEN outcome = 'failure' THEN 'login_failed' ELSE 'login_success' END WHEN 1 THEN CASE WHEN starts_with(action, 'login_success') THEN 'login_success' WHEN starts_with(action, 'login_failed') THEN 'login_failed' WHEN starts_with(action, 'process') THEN 'process_start' ELSE 'observed' END WHEN 3 THEN 'Read' ELSE 'observed' END AS action,
  CASE k WHEN 3 THEN 't' || (event_id % 7) END AS resource, CASE k WHEN 3 THEN 'x' END AS cloud_account, NULL AS hashes, CASE k WHEN 1 THEN 'gate' END AS log_product, NULL AS log_service,
  CASE k WHEN 0 THEN 25 WHEN 1 THEN CASE WHEN event_id % 13 >= 9 THEN 100 WHEN event_id % 13 >= 7 THEN 75 WHEN event_id % 13 >= 4 THEN 50 WHEN event_id % 13 > 0 THEN 25 ELSE 0 END WHEN 2 THEN 75 ELSE 0 END AS severity,
  CASE k WHEN 0 THEN epoch_us(TIMESTAMP '2024-03-05 06:07:08') WHEN 1 THEN 1700000000000000 WHEN 2 THEN epoch_us(TIMESTAMP '2024-01-01 00:00:00') WHEN 3 THEN (1700000000 + event_id) * 1000000 ELSE 0 END AS us FROM k
UNION ALL SELECT seq, 'json', 'unknown', 'second', NULL, NULL, 'unknown', 'observed', NULL, NULL, 'abc', NULL, 'security', 100, 0 FROM k WHERE k = 2""",
    "syslog_priorities": f"""WITH {V} SELECT CAST((event_id % 192) // 8 AS INTEGER) AS facility, (['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'informational', 'debug'])[event_id % 8 + 1] AS severity,
  TIMESTAMP '2023-01-02 03:04:05' AS at, count(*) AS n FROM v WHERE category = 'network' GROUP BY ALL""",
    "cloud_records": f"WITH {V} SELECT seq, action, coalesce(user_name, 'root') AS user_name, src_ip, cloud_account, CASE WHEN value > 150 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 2 = 0 THEN source ELSE outcome END AS resource, 'cloudtrail' AS log_service FROM v WHERE category = 'cloud'",
    "new_records": f"""WITH {V} SELECT host AS record_id, min(seq) AS seq FROM v WHERE host IS NOT NULL AND host NOT IN (SELECT host FROM v WHERE category = 'network' AND host IS NOT NULL) GROUP BY 1
UNION ALL SELECT host, seq FROM v WHERE host IS NULL""",
    "archive_replay": f"WITH {V} SELECT seq, {LINE} AS line FROM v WHERE seq >= (SELECT max(seq) // 2 FROM v)",
    "archive_tail": f"WITH {V} SELECT seq, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM v ORDER BY seq DESC LIMIT 500",
    "persist_conflicts": f"""WITH {V}, d AS (SELECT outcome = 'failure' AS old, contains(action, '_rare') AS rare FROM v)
SELECT CAST(version AS INTEGER) AS version, status, count(*) AS n FROM (SELECT 1 AS version, unnest(['new', 'stored']) AS status FROM d WHERE old UNION ALL SELECT 2, unnest(CASE WHEN NOT old THEN ['new', 'stored'] WHEN rare THEN ['conflict'] ELSE ['same'] END) FROM d
  UNION ALL SELECT 3, CASE WHEN old AND rare THEN 'conflict' ELSE 'same' END FROM d) GROUP BY ALL""",
    "requeued_lines": f"WITH {V} SELECT seq, CASE WHEN category = 'process' AND contains({LINE}, 'step1 ') THEN 'aside' ELSE 'main' END AS sink FROM v",
    "projection_backlog": f"WITH {V} SELECT source, count(*) AS backlog, min(us) AS oldest_us FROM v WHERE outcome = 'failure' GROUP BY 1",
    "projection_feed": f"""WITH {V}, k AS (SELECT source AS tenant, seq, sha256('["' || source || '","' || event_id || '"]') AS key, seq % 3 AS r FROM v),
d AS (SELECT 'search' AS destination, tenant, CASE r WHEN 0 THEN '2' WHEN 2 THEN '4' ELSE 'pending' END AS state, seq, key FROM k UNION ALL SELECT 'warehouse', tenant, CASE r WHEN 1 THEN 'pending' ELSE '5' END, seq, key FROM k)
SELECT destination, tenant, state, count(*) AS n, min(seq) AS oldest, min(CASE WHEN state <> 'pending' THEN key END) AS first_key FROM d GROUP BY destination, tenant, state""",
    "metric_buckets": f"WITH {V} SELECT source, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (value <= 200) AS le_200, count(*) AS le_inf, round(sum(value), 2) AS total FROM v GROUP BY 1",
    "metric_exposition": f"""WITH {V}, h AS (SELECT 'event_value' AS name, 'source="' || source || '"' AS l, value, x, CASE WHEN isinf(x) THEN '+Inf' ELSE CAST(CAST(x AS INTEGER) AS VARCHAR) END AS le FROM v, unnest([10, 50, 100, 200, 'Infinity'::DOUBLE]) AS t(x)
  UNION ALL SELECT 'outcome_value', 'source="' || source || '",outcome="' || outcome || '"', value, x, CASE x WHEN 0.5 THEN '0.5' WHEN 150 THEN '150' ELSE '+Inf' END FROM v, unnest([0.5, 150, 'Infinity'::DOUBLE]) AS t(x))
SELECT name || '_bucket' AS metric, l || ',le="' || le || '"' AS labels, CAST(count(*) FILTER (value <= x) AS DOUBLE) AS value FROM h GROUP BY name, l, le, x
UNION ALL SELECT name || '_sum', l, round(sum(value), 6) FROM h WHERE le = '+Inf' GROUP BY name, l UNION ALL SELECT name || '_count', l, CAST(count(value) AS DOUBLE) FROM h WHERE le = '+Inf' GROUP BY name, l""",
    "dead_letters": f"WITH {V} SELECT seq, CASE WHEN category = 'process' AND contains({LINE}, 'step1 ') THEN 'quarantine' ELSE 'main' END AS sink FROM v",
}
