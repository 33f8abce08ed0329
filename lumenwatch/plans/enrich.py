"""Registered queries of identities, context tables, stored incidents, vendor alerts, catalogues and predicates, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import compile_selection
from ..functions.rules import RULES
from ..operators import context, incidents, quality, reports, search, suppression, triage
from ..sources import mappers
from ..sources.events import V, X, by_entity, security_events
from .context import BUNDLE, _assets, _assets_sql, _table
from .detection import INCIDENTS, _findings, _incidents, _members, _status, named
from .reports import RUNBOOKS
from .reports import SQL as REPORT_SQL

SEAL_KEY = b"a key for this query's own chain"
#: Starts of IPv6 addresses that a decimal number ends, and the scope of the whole.
NETWORKS6 = [("fe80::", "link-local"), ("ff02::1:", "multicast"), ("2001:db8::", "documentation"), ("fd00:1::", "private"), ("2606:4700::", "public"), ("2001:20::", "public"), ("2001:0:0:0:0:0:0:", "private"), ("::ffff:10.0.0.", "private"), ("::ffff:", "public"), ("1::2::", "invalid"), ("1:2:3:4:5:6:7:8:", "invalid")]

#: One selection for each predicate of the language, and the same test in SQL.
PREDICATES = {
    "scalar": ({"outcome": "failure"}, "outcome = 'failure'"),
    "scalar_null": ({"host": None}, "host IS NULL"),
    "member": ({"source": ["src1", "src3"]}, "source IN ('src1', 'src3')"),
    "contains": ({"command_line": {"contains": "STEP1"}}, "contains(lower(coalesce(command_line, '')), 'step1')"),
    "contains_any": ({"action": {"contains_any": ["FAIL", "rare1"]}}, "contains(action, 'fail') OR contains(action, 'rare1')"),
    "contains_all": ({"action": {"contains_all": ["login", "rare"]}}, "contains(action, 'login') AND contains(action, 'rare')"),
    "not_contains": ({"command_line": {"not_contains": "enc"}}, "NOT contains(lower(coalesce(command_line, '')), 'enc')"),
    "not_contains_any": ({"action": {"not_contains_any": ["login", "http"]}}, "NOT (contains(action, 'login') OR contains(action, 'http'))"),
    "not_contains_all": ({"action": {"not_contains_all": ["login", "success"]}}, "NOT (contains(action, 'login') AND contains(action, 'success'))"),
    "regex": ({"host": {"regex": "^H[0-9]{2}$"}}, "regexp_matches(coalesce(host, ''), '^h[0-9]{2}$')"),
    "not_regex": ({"host": {"not_regex": "^h[0-9]{2}$"}}, "NOT regexp_matches(coalesce(host, ''), '^h[0-9]{2}$')"),
    "equals": ({"event_id": {"equals": "77"}}, "event_id = 77"),
    "not_equals": ({"user_name": {"not_equals": "u7"}}, "coalesce(user_name, '') <> 'u7'"),
    "startswith": ({"src_ip": {"startswith": "203."}}, "starts_with(coalesce(src_ip, ''), '203.')"),
    "not_startswith": ({"src_ip": {"not_startswith": "203."}}, "NOT starts_with(coalesce(src_ip, ''), '203.')"),
    "endswith": ({"user_name": {"endswith": "9"}}, "ends_with(coalesce(user_name, ''), '9')"),
    "not_endswith": ({"user_name": {"not_endswith": "9"}}, "NOT ends_with(coalesce(user_name, ''), '9')"),
    "startswith_any": ({"action": {"startswith_any": ["LOGIN", "http"]}}, "starts_with(action, 'login') OR starts_with(action, 'http')"),
    "startswith_all": ({"action": {"startswith_all": ["login", "login_f"]}}, "starts_with(action, 'login_f')"),
    "not_startswith_any": ({"action": {"not_startswith_any": ["login", "http"]}}, "NOT (starts_with(action, 'login') OR starts_with(action, 'http'))"),
    "not_startswith_all": ({"action": {"not_startswith_all": ["login", "login_f"]}}, "NOT starts_with(action, 'login_f')"),
    "endswith_any": ({"host": {"endswith_any": ["1", "2"]}}, "ends_with(coalesce(host, ''), '1') OR ends_with(coalesce(host, ''), '2')"),
    "endswith_all": ({"host": {"endswith_all": ["1", "11"]}}, "ends_with(coalesce(host, ''), '11')"),
    "not_endswith_any": ({"host": {"not_endswith_any": ["1", "2"]}}, "NOT (ends_with(coalesce(host, ''), '1') OR ends_with(coalesce(host, ''), '2'))"),
    "not_endswith_all": ({"host": {"not_endswith_all": ["1", "11"]}}, "NOT ends_with(coalesce(host, ''), '11')"),
    "in": ({"host": {"in": ["h4", "h7"]}}, "coalesce(host IN ('h4', 'h7'), false)"),
    "not_in": ({"host": {"not_in": ["h4", "h7"]}}, "NOT coalesce(host IN ('h4', 'h7'), false)"),
    "exists": ({"cloud_account": {"exists": True}}, "cloud_account IS NOT NULL"),
    "not_exists": ({"cloud_account": {"exists": False}}, "cloud_account IS NULL"),
    "any_of": ({"any_of": [{"host": None}, {"outcome": "failure"}]}, "host IS NULL OR outcome = 'failure'"),
    "all_of": ({"all_of": [{"category": "process"}, {"host": {"exists": True}}]}, "category = 'process' AND host IS NOT NULL"),
    "not": ({"not": {"category": "process"}}, "category <> 'process'"),
    "several": ({"src_ip": {"startswith": "10.", "not_endswith": "1"}}, "starts_with(coalesce(src_ip, ''), '10.') AND NOT ends_with(coalesce(src_ip, ''), '1')"),
}


def predicate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events meet one selection of each predicate, in one scan."""
    counts = security_events(spark, sf_dir).agg(*[F.count_if(compile_selection(s)).alias(name) for name, (s, _) in PREDICATES.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"`{n}`").alias("hits")) for n in PREDICATES])).alias("p")).select("p.*")


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a directory export: odd ones have a user name, all a mail address; some are privileged or disabled."""
    n = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        F.when(n % 2 == 1, F.concat(F.lit("U"), n.cast("string"))).alias("username"),
        F.concat(F.lit("u"), (n % 90).cast("string"), F.lit("@corp.example")).alias("email"),
        F.when(F.col("c_nationkey") == 3, "Yes").alias("privileged"),
        F.when(F.col("c_acctbal") < 0, " Suspended").otherwise("active").alias("status"),
        F.when(F.col("c_acctbal") > 8000, "important").when(F.col("c_acctbal") > 4000, "minor").alias("criticality"),
        n.alias("position"),
    )


def _known_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.identity_context(by_entity(security_events(spark, sf_dir)), context.identity_index(_identities(spark, sf_dir)))


def identity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known_identities(spark, sf_dir).select("entity", "criticality", F.concat_ws(",", "tags").alias("tags"))


def _clauses(spark: SparkSession) -> DataFrame:
    bundle = [*BUNDLE, ("i5", "bad address", "[ipv4-addr:value = '203.0.113.12']"), ("i6", "seen user", "[user-account:user_id = 'U7']"), ("i7", "other name", "[user-account:user_id = 'u7'] OR [ipv4-addr:value = '10.1.1.2']")]
    return context.indicator_clauses(spark.createDataFrame(bundle, "id string, name string, pattern string"))


def indicator_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that equal an indicator's value: hits and names."""
    return context.indicator_lookup(by_entity(security_events(spark, sf_dir)), _clauses(spark)).withColumn("indicators", F.concat_ws(",", "indicators"))


def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, assets and indicators of each entity in one table."""
    entities = by_entity(security_events(spark, sf_dir)).select("entity").distinct()
    no_tags = F.array().cast("array<string>").alias("tags")
    hosts = entities.where("startswith(entity, 'host:')").join(_assets(spark, sf_dir).withColumn("entity", F.concat(F.lit("host:"), "key")), "entity")
    known = context.indicator_lookup(entities, _clauses(spark))
    parts = [_known_identities(spark, sf_dir), hosts.select("entity", F.lit("asset").alias("source"), "criticality", no_tags), known.select("entity", F.lit("threat_intel").alias("source"), F.lit("critical").alias("criticality"), F.array(F.lit("threat-intel-hit")).alias("tags"))]
    return context.context_table(*parts).select("entity", F.concat_ws(",", "sources").alias("sources"), "criticality", F.concat_ws(",", "tags").alias("tags"))


def incident_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k reports: incidents that name a technique, and open ones of an entity."""
    rows = _incidents(spark, sf_dir).withColumn("status", _status(F.col("risk_score")))
    by_text = search.search_incidents(rows, text="t1110").withColumn("asked", F.lit("text"))
    return by_text.unionByName(search.search_incidents(rows, entity="HOST:H1", status="open").withColumn("asked", F.lit("entity"))).select("asked", "incident_key", "risk_score", "status")


def incident_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored about incidents: findings, events, proposals and the latest of their decisions, here one for each finding."""
    members = _members(spark, sf_dir)
    rolled = incidents.roll_up(members)
    log = members.select("incident_key", "rule_id", F.col("seq").alias("at"), F.concat(F.lit("seen "), "rule_id").alias("decision")).groupBy("incident_key", "at").agg(F.max("decision").alias("decision"))
    return search.incident_bundle(rolled, members, triage.proposals(triage.decide(triage.confidence(rolled))), log)


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 100 newest audit rows of each tenant, here an event's source."""
    log = security_events(spark, sf_dir).select(F.col("source").alias("tenant"), "seq", "action")
    return search.audit_list(log).select("tenant", "seq", "action", "place")


def case_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    return reports.case_notes(incidents.roll_up(members), named(members))


def mapped_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as the records of four further vendors and mapped back."""
    e = security_events(spark, sf_dir)
    n = F.col("event_id")
    github = F.to_json(F.struct(F.col("user_name").alias("user"), F.col("src_ip").alias("ip"), F.concat(F.lit("repo."), "outcome").alias("action"), F.col("source").alias("org"), F.col("host").alias("repo"), F.when(n % 8 == 0, F.col("outcome")).alias("result"), (n * 1000 + 1_700_000_000_000).alias("@timestamp")))
    suricata = F.to_json(F.struct("src_ip", F.col("host").alias("dest_ip"), F.struct(F.col("action").alias("signature"), (n % 6).alias("severity")).alias("alert"), F.when(n % 8 == 1, "flow").alias("event_type")))
    asset = F.to_json(F.struct(F.lit("").alias("hostname"), F.col("host").alias("fqdn"), F.col("src_ip").alias("ip"), F.col("user_name").alias("owner"), F.col("source").alias("os"), F.col("cloud_account").alias("org")))
    text = lambda name, c: F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(c, F.lit("")), F.lit("</Data>"))
    xml = F.concat(F.lit('<Event xmlns="urn:e"><System><Provider Name="p1"/><EventID>1</EventID><Computer>'), F.coalesce("host", F.lit("")), F.lit("</Computer></System><EventData>"), text("ParentImage", F.col("user_name")), text("Image", F.lit("C:\\bin\\cmd.exe")), F.lit("</EventData></Event>"))
    parts = []
    for i, (name, body) in enumerate((("github", github), ("suricata", suricata), ("assets", asset), ("sysmon_xml", xml))):
        rows = mappers.MAPPERS[name](e.where(n % 4 == i).select("seq", body.alias("body")), "seq")
        process = F.col("process_name") if name == "sysmon_xml" else F.lit(None).cast("string").alias("process_name")
        parts.append(rows.select("seq", F.lit(name).alias("vendor"), "user_name", "host", "src_ip", "dst_ip", "cloud_account", "action", "category", "outcome", "resource", "severity", "ts_text", process))
    return reduce(DataFrame.unionByName, parts)


def catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as exploited vulnerabilities, techniques and lookup files, and read back: rows of each."""
    p = _table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    kev = p.select(F.to_json(F.struct(F.array(F.struct(F.concat(F.when(n % 3 == 0, "cve-2024-").when(n % 3 == 1, "CVE-2024-").otherwise("GHSA-"), F.lpad(n.cast("string"), 5, "0")).alias("cveID"), F.when(n % 2 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"))).alias("vulnerabilities"))).alias("body"))
    reference = F.array(F.struct(F.lit("other").alias("source_name"), F.lit("X").alias("external_id")), F.struct(F.when(n % 5 == 0, "capec").otherwise("mitre-attack").alias("source_name"), F.concat(F.lit("T"), n.cast("string")).alias("external_id")))
    phases = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lit("execution").alias("phase_name")), F.struct(F.lit("other").alias("kill_chain_name"), F.lit("x").alias("phase_name")))
    bundle = p.select(F.to_json(F.struct(F.array(F.struct(F.when(n % 7 == 0, "tool").otherwise("attack-pattern").alias("type"), F.col("p_name").alias("name"), (n % 11 == 0).alias("revoked"), reference.alias("external_references"), phases.alias("kill_chain_phases"))).alias("objects"))).alias("body"))
    item = F.struct(n.cast("string").alias("k"))
    files = p.select(F.when(n % 4 == 0, F.to_json(F.array(item, item))).when(n % 4 == 1, F.to_json(F.struct(F.array(item).alias("users")))).when(n % 4 == 2, F.to_json(item)).otherwise("not json").alias("body"))
    return (
        mappers.exploited_catalogue(kev).select(F.lit("exploited").alias("catalogue"), F.col("cve").alias("id"), F.col("ransomware").cast("string").alias("told"))
        .unionByName(mappers.technique_bundle(bundle).select(F.lit("technique").alias("catalogue"), F.col("technique").alias("id"), F.concat_ws(",", "tactics").alias("told")))
        .unionByName(mappers.lookup_records(files, "k string").select(F.lit("lookup").alias("catalogue"), F.col("k").alias("id"), F.lit("").alias("told")))
    )


def suppression_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions logged by events of hosts: the latest row of each counts, unless it deletes."""
    e = security_events(spark, sf_dir).where("host IS NOT NULL")
    log = e.select(F.col("host").alias("suppression_id"), "action", F.col("seq").alias("updated_at"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 1).alias("deleted"))
    return suppression.current(log, "suppression_id").select("suppression_id", "action")


def proposals_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that aren't pending or approved already; here those for users with even names are, and those for hosts were rejected."""
    proposed = triage.proposals(triage.decide(triage.confidence(_incidents(spark, sf_dir))))
    log = proposed.where(F.col("target").rlike("^user:u[0-9]*[02468]$|^host:")).select("incident_key", "action", "target", F.when(F.col("target").startswith("host:"), "rejected").otherwise("pending").alias("status"))
    return triage.without_live(proposed, log).select("incident_key", "action", "target")


def technique_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique codes that texts about the events name."""
    text = F.concat(F.lit("xT1059 T"), F.col("event_id") + 1000, F.lit(" then T1059.00"), F.col("event_id") % 3, F.lit(", T1059.00"), F.col("event_id") % 2, F.lit(" T12"))
    return security_events(spark, sf_dir).select("event_id", F.concat_ws(",", reports.technique_codes(text)).alias("codes"))


_CODES = "'T1059.00' || (event_id % 3) || CASE WHEN event_id % 3 <> event_id % 2 THEN ',T1059.00' || (event_id % 2) ELSE '' END"
_IDENTITIES = """cu AS (SELECT c_custkey AS pos, 'u' || c_custkey AS uk, 'u' || (c_custkey % 90) AS lk, c_nationkey = 3 AS strong, c_acctbal < 0 AS off, CASE WHEN c_acctbal > 8000 THEN 'high' WHEN c_acctbal > 4000 THEN 'low' END AS crit FROM customer),
ik AS (SELECT uk AS key, pos, true AS whole, strong, off, crit FROM cu WHERE pos % 2 = 1 UNION ALL SELECT lk, pos, false, strong, off, crit FROM cu),
ix AS (SELECT key, coalesce(max(pos) FILTER (whole), min(pos)) AS pos FROM ik GROUP BY 1),
ident AS (SELECT DISTINCT entity, CASE WHEN strong OR off THEN 'critical' ELSE crit END AS criticality, list_filter([CASE WHEN strong THEN 'privileged' END, CASE WHEN off THEN 'disabled-account' END], lambda t: t IS NOT NULL) AS tags
  FROM x JOIN ix ON kind = 'user' AND ix.key = substr(entity, 6) JOIN cu USING (pos))"""
_INTEL = """clause(indicator, name, value) AS (VALUES ('i1', 'bad address', '203.0.113.12'), ('i2', 'tooling', 'cmd.exe /c step3'), ('i2', 'tooling', 'powershell.exe'), ('i3', 'text', 'sqbf'), ('i4', 'two', '10.1.1.2'), ('i4', 'two', '10.1.1.3'), ('i5', 'bad address', '203.0.113.12'), ('i6', 'seen user', 'u7'), ('i7', 'other name', 'u7'), ('i7', 'other name', '10.1.1.2')),
intel AS (SELECT entity, CAST(sum(n) AS BIGINT) AS hits, string_agg(name, ',' ORDER BY first) AS indicators FROM (SELECT DISTINCT entity FROM x) JOIN (SELECT value, name, count(*) AS n, min(indicator) AS first FROM clause GROUP BY 1, 2) ON value = regexp_replace(entity, '^[^:]*:', '') GROUP BY 1)"""
_DATA = "'{\"entities\":[\"' || array_to_string(entities, '\",\"') || '\"],\"kill_chain\":[' || CASE WHEN len(chain) > 0 THEN '\"' || array_to_string(chain, '\",\"') || '\"' ELSE '' END || ']}'"
_title = "CASE WHEN others <= 0 THEN 'Suspicious activity involving ' || primary_entity ELSE 'Correlated activity involving ' || primary_entity || ' and ' || others || ' related entit' || CASE WHEN others = 1 THEN 'y' ELSE 'ies' END END"
_names = ", ".join(f"('{r['rule_id']}', '{r['name']}')" for r in RULES)
_state = "CASE WHEN risk_score >= 70 THEN 'open' WHEN risk_score >= 40 THEN 'investigating' ELSE 'closed' END"
_PROPOSED = """pr AS (SELECT incident_key, CASE split_part(target, ':', 1) WHEN 'user' THEN 'disable_user' WHEN 'host' THEN 'isolate_host' ELSE 'block_indicator' END AS action, target, true AS approval
  FROM (SELECT incident_key, unnest(entities) AS target FROM dec WHERE decision = 'containment_proposed') WHERE split_part(target, ':', 1) IN ('user', 'host', 'ip') UNION ALL SELECT incident_key, 'notify_channel', 'channel:soc-escalations', false FROM dec WHERE decision = 'escalate')"""

def runbook_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runbook steps that the proposals don't hold yet."""
    rows = _incidents(spark, sf_dir)
    books = spark.createDataFrame(RUNBOOKS, "runbook string, technique string, action string, kind string")
    return reports.runbook_additions(reports.runbook_steps(rows, books), rows, triage.proposals(triage.decide(triage.confidence(rows))))


def audit_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit chain sealed after its hundredth row, in which rows of one rare action carry the seal of another key and those of another lost theirs."""
    log = search.audit_log(security_events(spark, sf_dir))
    mac = F.when(F.col("payload").contains("_rare0"), search.seal(b"other", F.col("hash"))).otherwise(search.seal(SEAL_KEY, F.col("hash")))
    return search.verify_seals(log.withColumn("mac", F.when((F.col("seq") > 100) & ~F.col("payload").contains("_rare1"), mac)), SEAL_KEY)


def address6_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6 addresses of the events' users in networks of every scope: events and distinct addresses by scope."""
    prefix = F.element_at(F.array(*[F.lit(p) for p, _ in NETWORKS6]), (F.col("event_id") % len(NETWORKS6) + 1).cast("int"))
    user = F.coalesce(F.substring("user_name", 2, 9).cast("long"), F.lit(0)) % 250
    rows = security_events(spark, sf_dir).select(F.concat(prefix, user.cast("string")).alias("ip"))
    return rows.groupBy(F.coalesce(context.scope_of(F.col("ip")), F.lit("invalid")).alias("scope")).agg(F.count("*").alias("n"), F.countDistinct("ip").alias("addresses"))


def decision_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as decisions by language, that of English reporting no tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = F.when(F.col("lang") != "en", F.col("n_chars"))
    rows = docs.select("lang", (F.col("n_chars") % 11 == 0).alias("error"), (F.col("n_chars") < 300).alias("fallback"), told.alias("input_tokens"), (told % 7).alias("output_tokens"))
    out = quality.usage(rows, "lang")
    return out.select("lang", "cases", *[F.round(c, 9).alias(c) for c in ("error_rate", "fallback_rate")], "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"))


QUERIES = [runbook_additions, audit_seals, address6_scopes, decision_usage, predicate_hits, identity_contexts, indicator_contexts, entity_contexts, incident_search, incident_bundles, audit_rows, case_notes, mapped_alerts, catalogues, suppression_state, proposals_left, technique_mentions]
SQL = {
    "runbook_additions": f"""WITH RECURSIVE {INCIDENTS}, {_PROPOSED}, plan AS ({REPORT_SQL["runbook_plan"]})
SELECT incident_key, action, target, least(round_even(50 + severity / 4.0::DOUBLE + least(findings, 3) * 5, 0), 90.0::DOUBLE) / 100 AS confidence FROM plan JOIN inc USING (incident_key)
WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.incident_key = plan.incident_key AND pr.action = plan.action AND pr.target = plan.target)""",
    "audit_seals": f"""WITH {V}, s AS (SELECT seq, action, seq > 100 AND NOT contains(action, '_rare1') AS sealed FROM v)
SELECT seq, CASE WHEN sealed THEN 'mac' ELSE 'unsigned' END AS problem FROM s WHERE (sealed AND contains(action, '_rare0')) OR (NOT sealed AND seq > (SELECT min(seq) FROM s WHERE sealed))""",
    "address6_scopes": f"""WITH {V}, a AS (SELECT [{", ".join(f"'{p}'" for p, _ in NETWORKS6)}][event_id % {len(NETWORKS6)} + 1] || (coalesce(CAST(substr(user_name, 2) AS BIGINT), 0) % 250) AS ip, [{", ".join(f"'{s}'" for _, s in NETWORKS6)}][event_id % {len(NETWORKS6)} + 1] AS scope FROM v)
SELECT scope, count(*) AS n, count(DISTINCT ip) AS addresses FROM a GROUP BY 1""",
    "decision_usage": f"""WITH t AS (SELECT lang, n_chars, CASE WHEN lang <> 'en' THEN n_chars END AS told FROM documents), u AS (SELECT lang, count(*) AS cases, avg(CAST(n_chars % 11 = 0 AS DOUBLE)) AS e, avg(CAST(n_chars < 300 AS DOUBLE)) AS f, CAST(coalesce(sum(told), 0) AS BIGINT) AS i, CAST(coalesce(sum(told % 7), 0) AS BIGINT) AS o FROM t GROUP BY 1)
SELECT lang, cases, round(e, 9) AS error_rate, round(f, 9) AS fallback_rate, i AS input_tokens, o AS output_tokens, CASE WHEN i + o > 0 THEN round(i / 1e6 * {quality.PRICES[0]}::DOUBLE + o / 1e6 * {quality.PRICES[1]}::DOUBLE, 9) END AS cost_usd FROM u""",
    "predicate_hits": f"WITH {V} " + " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) FILTER ({t}) AS hits FROM v" for n, (_, t) in PREDICATES.items()),
    "identity_contexts": f"WITH {X}, {_IDENTITIES} SELECT entity, criticality, array_to_string(tags, ',') AS tags FROM ident",
    "indicator_contexts": f"WITH {X}, {_INTEL} SELECT * FROM intel",
    "entity_contexts": f"""WITH {X}, {_IDENTITIES}, {_INTEL}, {_assets_sql}, p AS (SELECT entity, 0 AS place, 'identity' AS source, criticality, tags FROM ident
UNION ALL SELECT DISTINCT entity, 1, 'asset', CASE m WHEN 200 THEN 'critical' WHEN 150 THEN 'high' WHEN 100 THEN 'medium' ELSE 'low' END, [] FROM x JOIN a ON kind = 'host' AND key = substr(entity, 6) UNION ALL SELECT entity, 2, 'threat_intel', 'critical', ['threat-intel-hit'] FROM intel)
SELECT entity, string_agg(source, ',' ORDER BY place) AS sources, arg_max(criticality, CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END) AS criticality, array_to_string(flatten(list(tags ORDER BY place)), ',') AS tags FROM p GROUP BY 1""",
    "incident_search": f"""WITH RECURSIVE {INCIDENTS}, i AS (SELECT *, {_state} AS status, {_DATA} AS data, {_title} AS title FROM inc)
(SELECT 'text' AS asked, incident_key, risk_score, status FROM i WHERE incident_key ILIKE '%t1110%' OR title ILIKE '%t1110%' OR data ILIKE '%t1110%' ORDER BY risk_score DESC, first_us DESC, incident_key LIMIT 50)
UNION ALL (SELECT 'entity', incident_key, risk_score, status FROM i WHERE data ILIKE '%HOST:H1%' AND status = 'open' ORDER BY risk_score DESC, first_us DESC, incident_key LIMIT 50)""",
    "incident_bundles": f"""WITH RECURSIVE {INCIDENTS}, {_PROPOSED}, m AS (SELECT incident_key, finding_id, rule_id, event_id, seq FROM sf JOIN key USING (finding_id))
SELECT incident_key, 'finding' AS part, finding_id AS ref, rule_id AS told FROM m UNION ALL SELECT DISTINCT incident_key, 'event', CAST(event_id AS VARCHAR), '' FROM m
UNION ALL SELECT incident_key, 'proposal', action || ' ' || target, CASE WHEN approval THEN 'approval' ELSE 'free' END FROM pr UNION ALL SELECT incident_key, 'decision', CAST(max(seq) AS VARCHAR), max('seen ' || rule_id) FROM (SELECT *, max(seq) OVER (PARTITION BY incident_key) AS last FROM m) WHERE seq = last GROUP BY 1""",
    "audit_rows": f"WITH {V} SELECT source AS tenant, seq, action, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq DESC) AS r FROM v) WHERE r <= 100",
    "case_notes": f"""WITH RECURSIVE {INCIDENTS}, nm(rule_id, rule_name) AS (VALUES {_names}), rn AS (SELECT incident_key, list(rule_name ORDER BY rule_name)[1:5] AS rules FROM (SELECT DISTINCT incident_key, rule_name FROM sf JOIN key USING (finding_id) JOIN nm USING (rule_id)) GROUP BY 1)
SELECT incident_key, 'AI triage note for ' || {_title} || chr(10) || chr(10) || 'Risk ' || risk_score || ' / severity ' || CASE severity WHEN 0 THEN 'informational' WHEN 25 THEN 'low' WHEN 50 THEN 'medium' WHEN 75 THEN 'high' ELSE 'critical' END || ' from ' || findings || ' finding(s) across ' || len(entities) || ' entit' || CASE WHEN len(entities) = 1 THEN 'y' ELSE 'ies' END || '.'
  || CASE WHEN len(chain) > 0 THEN chr(10) || 'ATT&CK progression: ' || array_to_string(chain, ' -> ') || '.' ELSE '' END || chr(10) || 'Detections: ' || array_to_string(rules, '; ') || '.' || chr(10) || 'Entities: ' || array_to_string(entities, ', ') || '.' AS note FROM inc JOIN rn USING (incident_key)""",
    "mapped_alerts": f"""WITH {V}, k AS (SELECT *, event_id % 4 AS k FROM v) SELECT seq, (['github', 'suricata', 'assets', 'sysmon_xml'])[k + 1] AS vendor, CASE WHEN k IN (0, 2) THEN user_name END AS user_name, CASE WHEN k >= 2 THEN host END AS host, CASE WHEN k <= 2 THEN src_ip END AS src_ip,
  CASE k WHEN 1 THEN host END AS dst_ip, CASE k WHEN 0 THEN source WHEN 2 THEN cloud_account END AS cloud_account,
  CASE k WHEN 0 THEN 'repo.' || outcome WHEN 1 THEN CASE WHEN event_id % 8 = 1 THEN 'flow' ELSE 'alert' END WHEN 2 THEN 'asset_inventory_observed' ELSE 'process_start' END AS action, (['cloud', 'network', 'endpoint', 'process'])[k + 1] AS category,
  CASE k WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN outcome ELSE 'unknown' END END AS outcome, CASE k WHEN 0 THEN host WHEN 1 THEN action WHEN 2 THEN source ELSE user_name END AS resource,
  CASE k WHEN 1 THEN (['info', 'critical', 'high', 'medium', 'low', 'info'])[event_id % 6 + 1] END AS severity, CASE k WHEN 0 THEN (1700000000 + event_id) || '.000' END AS ts_text, CASE k WHEN 3 THEN 'cmd.exe' END AS process_name FROM k""",
    "catalogues": """SELECT 'exploited' AS catalogue, 'CVE-2024-' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS id, CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS told FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT 'technique', 'T' || p_partkey, 'execution' FROM part WHERE p_partkey % 7 > 0 AND p_partkey % 11 > 0 AND p_partkey % 5 > 0
UNION ALL SELECT 'lookup', CAST(p_partkey AS VARCHAR), '' FROM part, unnest(range(CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END)) AS t(i)""",
    "suppression_state": f"WITH {V}, l AS (SELECT host, arg_max(action, seq) AS action, max_by(event_id, seq) AS last FROM v WHERE host IS NOT NULL GROUP BY 1) SELECT host AS suppression_id, action FROM l WHERE last % 3 <> 1",
    "proposals_left": f"WITH RECURSIVE {INCIDENTS}, {_PROPOSED} SELECT incident_key, action, target FROM pr WHERE NOT regexp_matches(target, '^user:u[0-9]*[02468]$')",
    "technique_mentions": f"WITH {V} SELECT event_id, CASE WHEN event_id + 1000 < 10000 THEN 'T' || (event_id + 1000) || ',' ELSE '' END || {_CODES} AS codes FROM v",
}
