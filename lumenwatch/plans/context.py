"""Registered queries of context and search: enrichment, intelligence, redaction, retrieval, quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..operators import context, detection, quality, search
from ..operators.incidents import roll_up, summarized
from ..sources.events import V, X, by_entity, security_events
from .detection import FOUND, INCIDENTS, SUMMARY, _findings, _matrix_table, _members, named

RANGES = [("corp", "10.0.0.0/13"), ("branch", "10.2.0.0/16"), ("branch-2-lab", "10.2.2.0/24"), ("lab", "203.0.113.0/25")]
BUNDLE = [("i1", "bad address", "[ipv4-addr:value = '203.0.113.12']"), ("i2", "tooling", "[process:command_line = 'cmd.exe /c STEP3'] OR [file:name = 'powershell.exe']"), ("i3", "text", "marked 'SQBF' or 'NOWHERE', not step1"), ("i4", "two", "[ipv4-addr:value = '10.1.1.2'] AND [ipv4-addr:value = '10.1.1.3']")]
ROLES = [("it-admin", "SEED-EXEC-2"), ("it-admin", "SEED-AUTH-1"), ("ci-deploy", "SEED-CLOUD-1"), ("backup", "SEED-RARE-1")]
NEVER = ["SEED-RARE-1"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(label, int(c.partition("/")[2]), context.cidr_range(c)[0] >> (32 - int(c.partition("/")[2]))) for label, c in RANGES]
    ranges = spark.createDataFrame(rows, "label string, prefix int, net long")
    addresses = security_events(spark, sf_dir).where("src_ip IS NOT NULL").groupBy(F.col("src_ip").alias("ip")).agg(F.count("*").alias("n"))
    return context.named_ranges(addresses, F.broadcast(ranges)).withColumn("labels", F.concat_ws(",", "labels"))


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an asset inventory: a host each, its criticality by market segment; the last record of a host counts."""
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), (F.col("c_custkey") % 450).cast("string")).alias("key"), F.when(F.col("c_acctbal") > 5000, "Tier0").when(F.col("c_acctbal") > 2000, "important").when(F.col("c_acctbal") > 0, "normal").otherwise("minor").alias("c"), F.col("c_custkey").alias("position"))
    return context.last_record(rows.select("key", context.criticality(F.col("c")).alias("criticality"), "position"), "key", "position")


def criticality_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.risk_by_criticality(_findings(spark, sf_dir), _assets(spark, sf_dir)).select("finding_id", "risk_points")


def routine_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as an identity directory of roles, of rules that are routine for some of them alone, and of accounts that are off in several spellings."""
    role = F.element_at(F.array(F.lit("it-admin"), F.lit(" CI-Deploy"), F.lit("backup"), F.lit("guest")), (F.col("c_nationkey") % 4 + 1).cast("int"))
    off = F.element_at(F.array(F.lit("disabled"), F.lit("Disabled "), F.lit("SUSPENDED"), F.lit("terminated")), (F.col("c_custkey") % 4 + 1).cast("int"))
    expected = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("SEED-EXT-1"), F.lit(""), F.lit("SEED-RARE-1")))
    people = _table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"), role.alias("role"), F.when(F.col("c_acctbal") < 0, off).otherwise("active").alias("status"), expected.alias("expected_rules"))
    roles = F.broadcast(spark.createDataFrame(ROLES, "role string, rule_id string"))
    return context.routine_for_role(_findings(spark, sf_dir), people, roles, NEVER).select("finding_id", "severity", "risk_points", "routine")


def host_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a vulnerability inventory (supplier: host, part: CVE), retail prices as the exploited catalogue."""
    cve = lambda c: F.concat(F.lit("CVE-2024-"), F.lpad(F.col(c).cast("string"), 5, "0"))
    inventory = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("host"), cve("l_partkey").alias("cve"))
    catalogue = _table(spark, sf_dir, "part").where("p_retailprice > 1500").select(cve("p_partkey").alias("cve"), (F.col("p_retailprice") > 1600).alias("ransomware"))
    return context.exposure(inventory, catalogue).withColumn("first_exploited", F.concat_ws(",", "first_exploited"))


def indicator_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = context.indicator_clauses(spark.createDataFrame(BUNDLE, "id string, name string, pattern string"))
    hay = F.concat_ws(" ", "action", "user_name", "host", "process_name", "command_line", "props")
    return context.indicator_hits(security_events(spark, sf_dir), clauses, "src_ip", hay)


def event_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_events(security_events(spark, sf_dir), text="rare_4").unionByName(search.search_events(security_events(spark, sf_dir), text="STEP1", entity="user:u12")).select("event_id", "action", "user_name")


def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 100 newest events."""
    return security_events(spark, sf_dir).orderBy(F.desc("us"), F.desc("seq")).limit(100).select("event_id", "us", "action")


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.source_health(security_events(spark, sf_dir))


def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.entity_profile(by_entity(security_events(spark, sf_dir)))


def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return search.timeline(summarized(roll_up(members), _matrix_table(spark)), named(members), security_events(spark, sf_dir))


def audit_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit chain of all events in which the payloads of rare actions were changed and costly ones lost their link."""
    log = search.audit_log(security_events(spark, sf_dir))
    log = log.withColumn("prev_hash", F.when(F.col("payload").contains("failure") & F.col("payload").contains("_rare1"), "lost").otherwise(F.col("prev_hash")))
    return search.verify_chain(log.withColumn("payload", F.when(F.col("payload").contains("_rare0"), F.concat("payload", F.lit("x"))).otherwise(F.col("payload"))))


def redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the five patterns that SQL has too, by source over all documents."""
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(*[F.sum(c).alias(n) for n, c in redaction.hits(F.col("text")).items() if n in ("ipv4", "email", "ssn", "ipv6", "aws_key")])


def all_redaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each pattern by source over all documents."""
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(*[F.sum(c).alias(n) for n, c in redaction.hits(F.col("text")).items()])


def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns and documents with secrets and personal data masked."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), redaction.mask(F.col("text")).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), redaction.mask(F.col("text")).alias("text"))
    return docs.unionByName(turns)


def keyword_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark item."""
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.retrieve(_table(spark, sf_dir, "documents").select("doc_id", "text"), queries, 5)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as truth; a deterministic score of the document's length as the prediction."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("n_chars") / 4000.0))
    rows = _table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("probability", p)
    rows = rows.withColumn("predicted", (F.col("probability") >= 0.5).cast("int")).withColumn("confidence", F.greatest("probability", F.lit(1.0) - F.col("probability")))
    return rows.select("doc_id", "source", F.col("quality").alias("expected"), "predicted", "probability", "confidence", (F.col("n_chars") % 997).alias("latency_ms"), (F.col("n_chars") < 300).alias("fallback"))


def decision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decisions(spark, sf_dir)
    out = quality.accuracy(rows, "source").join(quality.brier(rows, "source"), "source").join(quality.calibration(rows, 10, "source"), "source")
    return out.join(quality.percentiles(rows, "latency_ms", "source"), "source").select("source", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "fallback_rate", "brier", "ece", "mean")], "p50", "p95")


def decision_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.confusion(_decisions(spark, sf_dir), "source")


_DEC = """dq AS (SELECT d.source, quality AS expected, p >= 0.5 AS hit, CAST(p >= 0.5 AS INTEGER) AS predicted, p, greatest(p, 1.0::DOUBLE - p) AS c, n_chars % 997 AS ms, n_chars < 300 AS fb
  FROM labels JOIN (SELECT doc_id, source, n_chars, least(0.95::DOUBLE, greatest(0.05::DOUBLE, n_chars / 4000.0::DOUBLE)) AS p FROM documents) d USING (doc_id))"""
_stop = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: NOT list_contains([{_stop}], w))"
_assets_sql = """a AS (SELECT key, arg_max(m, pos) AS m FROM (SELECT 'h' || (c_custkey % 450) AS key, c_custkey AS pos, CASE WHEN c_acctbal > 5000 THEN 200 WHEN c_acctbal > 2000 THEN 150 WHEN c_acctbal > 0 THEN 100 ELSE 75 END AS m FROM customer) GROUP BY 1)"""
_number = "list_sum([CAST(split_part(ip, '.', 1 + i) AS BIGINT) * CAST(pow(256, 3 - i) AS BIGINT) FOR i IN range(4)])"
_ranges = ", ".join(f"('{label}', {context.cidr_range(c)[0]}, {context.cidr_range(c)[1]})" for label, c in RANGES)

QUERIES = [address_context, criticality_risk, routine_roles, host_exposure, indicator_findings, event_search, latest_events, source_health, entity_profiles, incident_timeline, audit_verification, redaction_audit, all_redaction_audit, redacted_text, keyword_retrieval, decision_quality, decision_confusion]
SQL = {
    "address_context": f"""WITH {V}, a AS (SELECT src_ip AS ip, count(*) AS n FROM v WHERE src_ip IS NOT NULL GROUP BY 1), r(label, lo, hi) AS (VALUES {_ranges}), b AS (SELECT *, {_number} AS k FROM a),
l AS (SELECT ip, string_agg(label, ',' ORDER BY label) AS labels FROM b JOIN r ON k BETWEEN lo AND hi GROUP BY 1)
SELECT ip, n, coalesce(labels, '') AS labels, CASE WHEN starts_with(ip, '10.') THEN 'private' ELSE 'documentation' END AS scope FROM a LEFT JOIN l USING (ip)""",
    "criticality_risk": f"""WITH {FOUND}, {_assets_sql}, e AS (SELECT finding_id, unnest(entities) AS entity FROM found),
m AS (SELECT finding_id, max(m) AS m FROM e JOIN a ON a.key = lower(regexp_replace(entity, '^[^:]*:', '')) GROUP BY 1)
SELECT finding_id, CASE WHEN m IS NULL OR risk_points <= 0 THEN risk_points ELSE greatest(CAST(round_even(risk_points * m / 100, 0) AS INTEGER), 1) END AS risk_points FROM found LEFT JOIN m USING (finding_id)""",
    "routine_roles": f"""WITH {FOUND}, p AS (SELECT c_custkey AS pos, 'u' || c_custkey AS key, (['it-admin', 'ci-deploy', 'backup', 'guest'])[c_nationkey % 4 + 1] AS role FROM customer WHERE c_acctbal >= 0),
roles(role, rule_id) AS (VALUES {", ".join(str(r) for r in ROLES)}), u AS (SELECT finding_id, rule_id, unnest(entities) AS entity FROM found WHERE rule_id <> 'SEED-RARE-1'),
q AS (SELECT finding_id FROM u JOIN p ON entity = 'user:' || key JOIN roles ON roles.role = p.role AND roles.rule_id = u.rule_id UNION SELECT finding_id FROM u JOIN p ON entity = 'user:' || key WHERE rule_id = 'SEED-EXT-1' AND pos % 3 = 0)
SELECT finding_id, CASE WHEN r THEN least(severity, 25) ELSE severity END AS severity, CASE WHEN r AND risk_points > 0 THEN greatest(CAST(round_even(risk_points * 0.25, 0) AS INTEGER), 1) ELSE risk_points END AS risk_points, r AS routine
FROM (SELECT *, finding_id IN (SELECT finding_id FROM q) AS r FROM found)""",
    "host_exposure": """WITH i AS (SELECT DISTINCT 'h' || l_suppkey AS host, 'CVE-2024-' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') AS cve FROM lineitem),
k AS (SELECT 'CVE-2024-' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS cve, p_retailprice > 1600 AS ransomware FROM part WHERE p_retailprice > 1500),
h AS (SELECT host, count(*) AS cves, count(ransomware) AS exploited, count(*) FILTER (ransomware) AS ransomware, coalesce(array_to_string((list(cve ORDER BY cve) FILTER (ransomware IS NOT NULL))[1:10], ','), '') AS first_exploited FROM i LEFT JOIN k USING (cve) GROUP BY 1)
SELECT *, CASE WHEN ransomware > 0 THEN 'critical' WHEN exploited > 0 THEN 'high' END AS level FROM h""",
    "indicator_findings": f"""WITH {V}, t AS (SELECT event_id, lower(concat_ws(' ', action, user_name, host, process_name, command_line, props)) AS h, src_ip FROM v),
m AS (SELECT event_id, list_filter([CASE WHEN src_ip = '203.0.113.12' THEN 'i1' END, CASE WHEN contains(h, 'cmd.exe /c step3') OR contains(h, 'powershell.exe') THEN 'i2' END, CASE WHEN contains(h, 'sqbf') THEN 'i3' END, CASE WHEN src_ip IN ('10.1.1.2', '10.1.1.3') THEN 'i4' END], lambda i: i IS NOT NULL) AS l FROM t)
SELECT event_id, array_to_string(l, ',') AS indicators, 75 AS severity, 75 AS risk_points FROM m WHERE len(l) > 0""",
    "event_search": f"""WITH {V} SELECT event_id, action, user_name FROM v WHERE concat_ws(chr(10), event_id, action, user_name, host, src_ip, source, command_line) ILIKE '%rare_4%' UNION ALL
SELECT event_id, action, user_name FROM v WHERE concat_ws(chr(10), event_id, action, user_name, host, src_ip, source, command_line) ILIKE '%step1%' AND user_name = 'u12'""",
    "latest_events": f"WITH {V} SELECT event_id, us, action FROM v ORDER BY us DESC, seq DESC LIMIT 100",
    "source_health": f"WITH {V} SELECT coalesce(source, 'unknown') AS source, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM v GROUP BY 1",
    "entity_profiles": f"""WITH {X}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY us DESC, seq DESC) AS r FROM x)
SELECT entity, count(*) AS n, min(us) AS first_us, max(us) AS last_us, string_agg(DISTINCT action, ',' ORDER BY action) AS actions, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM r WHERE r <= 25 GROUP BY 1""",
    "incident_timeline": f"""WITH RECURSIVE {INCIDENTS}, {SUMMARY} SELECT incident_key, sf.us, 'finding' AS kind, finding_id AS ref, name AS title, sf.severity, CAST(sf.risk_points AS BIGINT) AS risk,
  v.action || ' user=' || coalesce(v.user_name, 'unknown-user') || ' host=' || coalesce(v.host, 'unknown-host') || ' src_ip=' || coalesce(v.src_ip, 'unknown-ip') AS summary FROM sf JOIN key USING (finding_id) JOIN v USING (event_id) JOIN (SELECT rule_id, name FROM rules) USING (rule_id)
UNION ALL SELECT incident_key, first_us, 'incident_created', incident_key, CASE WHEN others <= 0 THEN 'Suspicious activity involving ' || primary_entity ELSE 'Correlated activity involving ' || primary_entity || ' and ' || others || ' related entit' || CASE WHEN others = 1 THEN 'y' ELSE 'ies' END END, severity, risk_score, summary FROM inc JOIN summ USING (incident_key)""",
    "audit_verification": f"WITH {V} SELECT seq, CASE WHEN contains(action, '_rare0') THEN 'payload' ELSE 'link' END AS problem FROM v WHERE contains(action, '_rare0') OR (outcome = 'failure' AND contains(action, '_rare1'))",
    "redaction_audit": r"""SELECT source, CAST(sum(len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))) AS BIGINT) AS ipv4, CAST(sum(len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]+\b'))) AS BIGINT) AS email, CAST(sum(len(regexp_extract_all(text, '\b\d{3}-\d{2}-\d{4}\b'))) AS BIGINT) AS ssn,
  CAST(sum(len(regexp_extract_all(text, '\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b'))) AS BIGINT) AS ipv6, CAST(sum(len(regexp_extract_all(text, '\bAKIA[0-9A-Z]{16}\b'))) AS BIGINT) AS aws_key FROM documents GROUP BY 1""",
    "keyword_retrieval": f"""WITH q AS (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark), p0 AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM p0 GROUP BY ALL),
w AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM p GROUP BY 1), s AS (SELECT query_id, doc_id, round(sum(tf * idf), 6) AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 5""",
    "decision_quality": f"""WITH {_DEC}, b AS (SELECT source, greatest(0, least(9, floor(c * 10))) AS bin, count(*) AS n, avg(c) AS c, avg(CAST(expected = predicted AS DOUBLE)) AS a FROM dq GROUP BY 1, 2),
e AS (SELECT source, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY 1), o AS (SELECT source, list(ms ORDER BY ms) AS l FROM dq GROUP BY 1)
SELECT source, count(*) AS n, round(avg(CAST(expected = predicted AS DOUBLE)), 9) AS accuracy, round(avg(CAST(fb AS DOUBLE)), 9) AS fallback_rate, round(avg((p - expected) * (p - expected)), 9) AS brier, round(any_value(ece), 9) AS ece, round(avg(ms), 9) AS mean,
  any_value(l[CAST(round_even(0.5 * (len(l) - 1), 0) AS BIGINT) + 1]) AS p50, any_value(l[CAST(round_even(0.95 * (len(l) - 1), 0) AS BIGINT) + 1]) AS p95 FROM dq JOIN e USING (source) JOIN o USING (source) GROUP BY 1""",
    "decision_confusion": f"WITH {_DEC} SELECT source, CAST(expected AS VARCHAR) AS expected, CAST(predicted AS VARCHAR) AS predicted, count(*) AS n FROM dq GROUP BY ALL",
}
