"""Registered queries of reports and record mappers, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..operators import incidents, quality, reports, search
from ..sources import mappers
from ..sources.events import V, by_entity, security_events
from .detection import INCIDENTS, SUMMARY, _findings, _matrix_table, _members, _status, named

RUNBOOKS = [("contain", "T1059", "isolate_host", "host"), ("reset", "T1110", "disable_user", "user"), ("block", "T1562", "block_indicator", "ip")]


def mapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as the records of four vendors, by category, and mapped back."""
    e = security_events(spark, sf_dir)
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "user.session.start").when(n % 3 == 1, "policy.evaluate").otherwise("app.user.sso")
    result = F.when(F.col("outcome") == "failure", "FAILURE").when(n % 4 == 0, "ALLOW").otherwise("SUCCESS")
    okta = F.struct(kind.alias("eventType"), F.struct(result.alias("result")).alias("outcome"), F.array(F.struct(F.lit("").alias("alternateId"), F.col("user_name").alias("displayName"))).alias("actor"), F.struct(F.col("src_ip").alias("ipAddress")).alias("client"), F.array(F.struct(F.col("source").alias("id"))).alias("target"))
    code = F.when(F.col("value") > 150, "50126").when(n % 5 == 1, "Success").when(n % 5 > 1, "0")
    entra = F.struct(F.col("user_name").alias("userPrincipalName"), F.col("src_ip").alias("ipAddress"), code.alias("resultType"), F.col("source").alias("appDisplayName"), F.struct(F.col("host").alias("displayName")).alias("deviceDetail"), F.col("cloud_account").alias("userId"))
    data = F.struct(F.concat(F.lit("C:\\bin\\"), "process_name").alias("Image"), F.col("command_line").alias("CommandLine"), F.col("user_name").alias("ParentImage"))
    sysmon = F.struct(F.struct(F.struct(F.lit("1").alias("EventID"), F.col("host").alias("Computer"), n.alias("EventRecordID")).alias("System"), data.alias("EventData")).alias("Event"))
    zeek = F.struct(F.col("src_ip").alias("id.orig_h"), F.lit("192.0.2.1").alias("id.resp_h"), F.lit("tcp").alias("proto"), F.col("host").alias("host"), F.when(n % 2 == 0, "p").when(n % 3 == 0, "/q").alias("uri"), (n * 1000 + 1_700_000_000_000).alias("ts"))
    parts = []
    for category, name, body in (("authentication", "okta", okta), ("cloud", "entra", entra), ("process", "sysmon", sysmon), ("network", "zeek", zeek)):
        rows = e.where(F.col("category") == category).select("seq", F.to_json(body).alias("body"))
        own = [F.col(c) if c in _OWN[name] else F.lit(None).cast("string").alias(c) for c in ("process_name", "command_line", "url")]
        parts.append(mappers.MAPPERS[name](rows, "seq").select("seq", "record_id", "user_name", "host", "src_ip", "dst_ip", "cloud_account", "action", "category", "outcome", "resource", "ts_text", *own))
    return reduce(DataFrame.unionByName, parts)


_OWN = {"okta": (), "entra": (), "sysmon": ("process_name", "command_line"), "zeek": ("url",)}


def related_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = incidents.exploded(_members(spark, sf_dir)).select("incident_key", "event_id", "entity")
    return reports.related_events(members, by_entity(security_events(spark, sf_dir)))


def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return reports.report_text(incidents.summarized(incidents.roll_up(members), _matrix_table(spark)), named(members).join(security_events(spark, sf_dir).select("event_id", "action", "user_name", "host", "src_ip"), "event_id", "left"))


def incident_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.features(_members(spark, sf_dir))


def runbook_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = spark.createDataFrame(RUNBOOKS, "runbook string, technique string, action string, kind string")
    return reports.runbook_steps(incidents.roll_up(_members(spark, sf_dir)), books)


def triage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of hosts, from their events: the latest status and assignee."""
    e = security_events(spark, sf_dir).where("host IS NOT NULL")
    log = e.select("host", F.when(F.col("category") != "network", F.col("outcome")).alias("status"), F.col("user_name").alias("assignee"), F.col("seq").alias("at"))
    return reports.current_state(log, "host", "status", "assignee")


def decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as decisions: by clerk priority and status, with late ones as escalations."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select("o_orderpriority", "o_orderstatus", (F.col("o_totalprice") < 50_000).alias("fallback"), (F.col("o_totalprice") > 200_000).alias("escalated"), (F.col("o_orderkey") % 997).alias("latency_ms"))
    return reports.decision_stats(rows, "o_orderpriority", "o_orderstatus")


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as assessments: by disposition, how many there are and how many disagree with the engine, which changes nothing."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    a, b = F.when(F.col("n_chars") % 5 > 0, F.least(F.lit(1.0), F.col("n_chars") / 3000.0)), F.when(F.col("n_chars") % 3 > 0, F.least(F.lit(1.0), F.col("n_chars") / 2000.0))
    return labels.groupBy(reports.disposition(a, b).alias("disposition")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("disagreements"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stored table, and of them by tenant, here an event's source."""
    e = security_events(spark, sf_dir).groupBy(F.col("source").alias("tenant")).agg(F.count("*").alias("n")).select(F.lit("events").alias("name"), "tenant", "n")
    f = incidents.exploded(_findings(spark, sf_dir)).join(security_events(spark, sf_dir).select("event_id", F.col("source").alias("tenant")), "event_id").groupBy("tenant").agg(F.countDistinct("finding_id").alias("n"))
    return e.unionByName(f.select(F.lit("findings").alias("name"), "tenant", "n"))


def seal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of the events by tenant; failures are sealed."""
    log = security_events(spark, sf_dir).select(F.col("source").alias("tenant"), F.when(F.col("outcome") == "failure", F.sha2("action", 256)).alias("mac"))
    return search.seal_summary(log)


def open_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest open incidents of some entities in each tenant; an incident belongs to its primary entity's kind."""
    rows = incidents.roll_up(_members(spark, sf_dir)).withColumn("tenant", F.substring_index("primary_entity", ":", 1))
    rows = rows.withColumn("status", F.when(F.col("risk_score") >= 70, "open").when(F.col("risk_score") >= 40, "investigating").otherwise("closed"))
    entities = [f"user:u{i}" for i in range(40)]
    return search.open_incidents(rows, entities).select("tenant", "incident_key", "status", "place")


def incident_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runbooks, and each tenant's 50 newest incidents with what became of them; an incident belongs to its primary entity's kind."""
    rows = incidents.summarized(incidents.roll_up(_members(spark, sf_dir)), _matrix_table(spark)).withColumn("tenant", F.substring_index("primary_entity", ":", 1))
    rows = rows.withColumn("status", _status(F.col("risk_score"))).withColumn("resolution", F.when(F.col("status") == "closed", "false_positive"))
    books = spark.createDataFrame([(name, f"When {technique} is seen: {action}.") for name, technique, action, _ in RUNBOOKS], "name string, content string")
    return search.retrieval_corpus(rows, books)


def baseline_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.baseline_decision(incidents.roll_up(_members(spark, sf_dir)))


def address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents by class: how many of each a document's text then names."""
    text = redaction.address_tokens(F.col("text"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("t"))
    return docs.select("doc_id", F.regexp_count("t", F.lit("<IP:internal>")).cast("long").alias("internal"), F.regexp_count("t", F.lit("<IP:public>")).cast("long").alias("public")).where("internal + public > 0")


_title = "CASE WHEN others <= 0 THEN 'Suspicious activity involving ' || primary_entity ELSE 'Correlated activity involving ' || primary_entity || ' and ' || others || ' related entit' || CASE WHEN others = 1 THEN 'y' ELSE 'ies' END END"
_books = ", ".join(str(b) for b in RUNBOOKS)
QUERIES = [mapped_records, related_events, incident_reports, incident_features, runbook_plan, triage_state, decision_stats, dispositions, table_counts, seal_summary, open_incidents, incident_documents, baseline_decisions, address_tokens]
SQL = {
    "mapped_records": f"""WITH {V}, k AS (SELECT *, CASE category WHEN 'authentication' THEN 'okta' WHEN 'cloud' THEN 'entra' WHEN 'process' THEN 'sysmon' ELSE 'zeek' END AS k, event_id % 6 IN (0, 2, 3, 4) AS asked FROM v)
SELECT seq, CASE k WHEN 'sysmon' THEN CAST(event_id AS VARCHAR) END AS record_id, CASE WHEN k IN ('okta', 'entra') THEN user_name END AS user_name,
  CASE WHEN k IN ('entra', 'sysmon') OR (k = 'zeek' AND asked) THEN host END AS host, CASE WHEN k <> 'sysmon' THEN src_ip END AS src_ip, CASE k WHEN 'zeek' THEN '192.0.2.1' END AS dst_ip, CASE k WHEN 'entra' THEN cloud_account END AS cloud_account,
  CASE k WHEN 'okta' THEN CASE WHEN outcome = 'failure' THEN 'login_failed' WHEN event_id % 4 > 0 AND event_id % 3 = 0 THEN 'login' ELSE (['user.session.start', 'policy.evaluate', 'app.user.sso'])[event_id % 3 + 1] END
    WHEN 'entra' THEN CASE WHEN value > 150 THEN 'login_failed' ELSE 'login' END WHEN 'sysmon' THEN 'process_start' ELSE CASE WHEN asked THEN 'http_request' ELSE 'network_connection' END END AS action,
  CASE k WHEN 'okta' THEN CASE WHEN event_id % 3 <> 1 THEN 'authentication' END WHEN 'entra' THEN 'authentication' WHEN 'sysmon' THEN 'process' ELSE 'network' END AS category,
  CASE k WHEN 'okta' THEN outcome WHEN 'entra' THEN CASE WHEN value > 150 THEN 'failure' WHEN event_id % 5 = 0 THEN 'unknown' ELSE 'success' END END AS outcome,
  CASE k WHEN 'sysmon' THEN user_name WHEN 'zeek' THEN 'tcp' ELSE source END AS resource, CASE k WHEN 'zeek' THEN (1700000000 + event_id) || '.000' END AS ts_text,
  CASE k WHEN 'sysmon' THEN process_name END AS process_name, CASE k WHEN 'sysmon' THEN command_line END AS command_line, CASE WHEN k = 'zeek' AND asked THEN host || CASE WHEN event_id % 2 = 0 THEN '/p' ELSE '/q' END END AS url FROM k""",
    "related_events": f"""WITH RECURSIVE {INCIDENTS}, m AS (SELECT DISTINCT incident_key, entity FROM fe JOIN key USING (finding_id)), own2 AS (SELECT DISTINCT incident_key, event_id FROM sf JOIN key USING (finding_id)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us DESC, seq DESC) AS r FROM x) WHERE r <= 25)
SELECT incident_key, event_id, count(*) AS entities FROM m JOIN l USING (entity) WHERE NOT EXISTS (SELECT 1 FROM own2 WHERE own2.incident_key = m.incident_key AND own2.event_id = l.event_id) GROUP BY 1, 2""",
    "incident_reports": f"""WITH RECURSIVE {INCIDENTS}, {SUMMARY}, r AS (SELECT incident_key, seq, name, severity, action, user_name, host, src_ip, row_number() OVER (PARTITION BY incident_key ORDER BY us, seq, rule_id) AS r FROM sf JOIN key USING (finding_id) JOIN (SELECT rule_id, name FROM rules) USING (rule_id) JOIN (SELECT event_id, action, user_name, host, src_ip FROM v) USING (event_id)),
b AS (SELECT incident_key, string_agg('- ' || name || ': action=' || action || ' user=' || coalesce(user_name, 'None') || ' host=' || coalesce(host, 'None') || ' src_ip=' || coalesce(src_ip, 'None') || ' severity=' || CASE severity WHEN 0 THEN 'informational' WHEN 25 THEN 'low' WHEN 50 THEN 'medium' WHEN 75 THEN 'high' ELSE 'critical' END, chr(10) ORDER BY r) AS body FROM r WHERE r <= 10 GROUP BY 1)
SELECT incident_key, 'Incident: ' || {_title} || chr(10) || 'Severity: ' || CASE severity WHEN 0 THEN 'informational' WHEN 25 THEN 'low' WHEN 50 THEN 'medium' WHEN 75 THEN 'high' ELSE 'critical' END || ' | Risk: ' || risk_score || chr(10) || 'Entities: ' || array_to_string(entities, ', ')
  || chr(10) || 'MITRE ATT&CK: ' || CASE WHEN len(chain) > 0 THEN array_to_string(chain, ', ') ELSE 'not mapped' END || chr(10) || chr(10) || 'Why it matters:' || chr(10) || summary || chr(10) || chr(10) || 'Key evidence:' || chr(10) || body || chr(10) || chr(10) || 'Recommended next steps:' || chr(10)
  || '1. Validate whether the user/session/source IP is expected.' || chr(10) || '2. Pull surrounding events for the same user, host, and source IP for +/- 24 hours.' || chr(10) || '3. Check asset criticality, recent vulnerabilities, and identity privilege level.' || chr(10)
  || '4. Look for lateral movement, credential access, persistence, and exfiltration signals.' || chr(10) || '5. If confidence is high, preserve evidence and use approval-gated containment playbooks.' AS report FROM inc JOIN summ USING (incident_key) JOIN b USING (incident_key)""",
    "incident_features": f"""WITH RECURSIVE {INCIDENTS}, m AS (SELECT incident_key, rule_id, risk_points, us, unnest(CASE WHEN len(entities) = 0 THEN [NULL] ELSE entities END) AS entity FROM sf JOIN key USING (finding_id))
SELECT incident_key, count(DISTINCT entity) FILTER (starts_with(entity, 'user:')) AS users, count(DISTINCT entity) FILTER (starts_with(entity, 'host:')) AS hosts, count(DISTINCT entity) FILTER (starts_with(entity, 'ip:')) AS addresses,
  count(DISTINCT rule_id) AS rules, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_list, max(risk_points) AS top_risk, max(us) - min(us) AS span_us FROM m GROUP BY 1""",
    "runbook_plan": f"""WITH RECURSIVE {INCIDENTS}, books(runbook, technique, action, kind) AS (VALUES {_books}), t AS (SELECT DISTINCT incident_key, entities, unnest([t, split_part(t, '.', 1)]) AS technique FROM (SELECT incident_key, entities, unnest(chain) AS t FROM inc)),
s AS (SELECT incident_key, action, kind, list_filter(entities, lambda e: starts_with(e, kind || ':')) AS targets FROM t JOIN books USING (technique))
SELECT DISTINCT incident_key, action, unnest(targets) AS target, NULL AS dropped FROM s WHERE len(targets) > 0 UNION ALL SELECT DISTINCT incident_key, action, NULL, 'no ' || kind || ' in scope' FROM s WHERE len(targets) = 0""",
    "triage_state": f"WITH {V} SELECT host, arg_max(CASE WHEN category <> 'network' THEN outcome END, seq) FILTER (category <> 'network') AS status, arg_max(user_name, seq) FILTER (user_name IS NOT NULL) AS assignee FROM v WHERE host IS NOT NULL GROUP BY 1",
    "decision_stats": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice < 50000) AS fallbacks, count(*) FILTER (o_totalprice > 200000) AS escalations, round(avg(o_orderkey % 997), 6) AS avg_latency_ms FROM orders GROUP BY ALL",
    "dispositions": """WITH a AS (SELECT CASE WHEN n_chars % 5 > 0 THEN least(1.0, n_chars / 3000.0) END AS a, CASE WHEN n_chars % 3 > 0 THEN least(1.0, n_chars / 2000.0) END AS b, quality = toxic AS other FROM labels JOIN documents USING (doc_id)),
w AS (SELECT other, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a < b THEN a ELSE b END AS w FROM a)
SELECT CASE WHEN w >= 0.75 THEN 'accepted' WHEN w >= 0.5 THEN 'review' WHEN w IS NULL THEN 'unavailable' ELSE 'ignored' END AS disposition, count(*) AS n, count(*) FILTER (other) AS disagreements FROM w GROUP BY 1""",
    "table_counts": f"""WITH RECURSIVE {INCIDENTS} SELECT 'events' AS name, source AS tenant, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'findings', v.source, count(DISTINCT finding_id) FROM sf JOIN v USING (event_id) GROUP BY ALL""",
    "seal_summary": f"WITH {V} SELECT source AS tenant, count(*) AS total, count(*) FILTER (outcome = 'failure') AS sealed FROM v GROUP BY 1",
    "open_incidents": f"""WITH RECURSIVE {INCIDENTS}, o AS (SELECT split_part(primary_entity, ':', 1) AS tenant, incident_key, CASE WHEN risk_score >= 70 THEN 'open' WHEN risk_score >= 40 THEN 'investigating' ELSE 'closed' END AS status, last_us, entities FROM inc),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY last_us DESC, incident_key) AS place FROM o WHERE status <> 'closed' AND list_has_any(entities, [{", ".join(f"'user:u{i}'" for i in range(40))}]))
SELECT tenant, incident_key, status, CAST(place AS INTEGER) AS place FROM r WHERE place <= 500""",
    "incident_documents": f"""WITH RECURSIVE {INCIDENTS}, {SUMMARY}, i AS (SELECT *, split_part(primary_entity, ':', 1) AS tenant, CASE WHEN risk_score >= 70 THEN 'open' WHEN risk_score >= 40 THEN 'investigating' ELSE 'closed' END AS status FROM inc JOIN summ USING (incident_key)),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first_us DESC, incident_key) AS r FROM i), books(name, technique, action, kind) AS (VALUES {_books})
SELECT incident_key AS doc_id, '[past incident] ' || {_title} || ' | status=' || status || CASE WHEN status = 'closed' THEN ' | resolution=false_positive' ELSE '' END || CASE WHEN len(chain) > 0 THEN ' | ' || array_to_string(chain, ' ') ELSE '' END || ' | ' || array_to_string(entities, ' ') || ' | ' || summary AS text FROM r WHERE r <= 50
UNION ALL SELECT 'runbook:' || name, '[runbook] ' || name || chr(10) || 'When ' || technique || ' is seen: ' || action || '.' FROM books""",
    "baseline_decisions": f"""WITH RECURSIVE {INCIDENTS}, b AS (SELECT incident_key, severity, risk_score, greatest(0.02::DOUBLE, least(0.98::DOUBLE, risk_score / 500.0::DOUBLE)) AS c FROM inc),
p AS (SELECT *, CASE WHEN severity IN (75, 100) THEN greatest(c, 0.9::DOUBLE) WHEN risk_score >= 100 THEN greatest(c, 0.6::DOUBLE) ELSE c END AS p FROM b)
SELECT incident_key, p AS probability, p >= 0.5 AS malicious, severity, CASE severity WHEN 100 THEN 'escalate' WHEN 75 THEN 'investigate' WHEN 50 THEN 'investigate' WHEN 25 THEN 'monitor' ELSE 'suppress' END AS action, c AS confidence, 0.2::DOUBLE AS narrative, false AS needs_narrative FROM p""",
    "address_tokens": r"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS m FROM documents),
b AS (SELECT doc_id, [CAST(x AS BIGINT) FOR x IN string_split(m, '.')] AS p FROM a WHERE regexp_full_match(m, '(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){3}')),
c AS (SELECT doc_id, p[1] IN (10, 127) OR (p[1] = 192 AND p[2] = 168) OR (p[1] = 169 AND p[2] = 254) OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 100 AND p[2] BETWEEN 64 AND 127) AS internal FROM b WHERE list_max(p) <= 255)
SELECT doc_id, count(*) FILTER (internal) AS internal, count(*) FILTER (NOT internal) AS public FROM c GROUP BY 1""",
}
