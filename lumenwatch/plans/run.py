"""The composed run over all events, and what is told about its incidents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES
from ..operators import context, graph, quality, reports, run, suppression
from ..sources.events import by_entity, security_events
from .behaviour import BURST_US, SIGNAL_CTES
from .context import BUNDLE, NEVER, ROLES, _assets, _assets_sql
from .detection import _FEEDBACK, CORRELATED, EXCEPTIONS, FOUND, NOW_US, _exceptions, _feedback
from .enrich import _IDENTITIES, _identities, _title

ROLE_NAMES = ["it-admin", "CI-deploy ", "backup", "guest"]


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with their outcome, and those that are kept with the risk and severity that they end with."""
    events = security_events(spark, sf_dir)
    clauses = context.indicator_clauses(spark.createDataFrame(BUNDLE, "id string, name string, pattern string"))
    hay = F.concat_ws(" ", "action", "user_name", "host", "process_name", "command_line", "props")
    role = F.element_at(F.array(*map(F.lit, ROLE_NAMES)), (F.col("position") % 4 + 1).cast("int"))
    index = context.identity_index(_identities(spark, sf_dir).withColumn("role", role))
    entities = by_entity(events).select("entity").distinct()
    no_tags = F.array().cast("array<string>").alias("tags")
    hosts = _assets(spark, sf_dir).select(F.concat(F.lit("host:"), "key").alias("entity"), F.lit("asset").alias("source"), "criticality", no_tags)
    contexts = context.context_table(context.identity_context(entities, index), hosts)
    roles = F.broadcast(spark.createDataFrame(ROLES, "role string, rule_id string"))
    facts = graph.save(context.entity_facts(entities, contexts, index, roles, [*NEVER, *run.NEVER_ROUTINE]), "facts")
    found = graph.save(run.findings(events, RULES, clauses, "src_ip", hay, BURST_US, facts), "findings")
    exceptions = F.broadcast(spark.createDataFrame(EXCEPTIONS, "suppression_id string, position int, rule_id string, entity string, action string, downgrade_to int, expires_us long, enabled boolean"))
    return run.weighed(suppression.settled(found, exceptions, F.lit(NOW_US)), F.broadcast(suppression.trust(_feedback(spark, sf_dir))))  # a row a rule


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return run.recommended(graph.save(_settled(spark, sf_dir), "settled").where("outcome IN ('kept', 'downgraded')"), RULES)


def full_run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the run: what became of it, and the severity and risk that it ends with."""
    return run.told(_settled(spark, sf_dir), RULES).select("finding_id", "rule_id", "rule_name", "outcome", "suppression_id", "routine", "severity", "risk_points", F.concat_ws(",", "indicators").alias("indicators"), F.size("signals").alias("signals"))


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's incidents, over findings of rules, indicators and behaviour together, and what is recommended for each."""
    rows, _ = _run(spark, sf_dir)
    return rows.select("incident_key", "risk_score", "severity", "findings", "anomalies", "primary_entity", F.concat_ws(",", "entities").alias("entities"), F.concat_ws(",", "kill_chain").alias("kill_chain"), "first_us", "last_us", "confidence", "decision", "owner")


def full_run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decision about each incident rests on: entities, rules, risk and the behaviour signals with their novelty."""
    _, members = _run(spark, sf_dir)
    told = run.signal_features(members).withColumns({c: F.concat_ws(",", c) for c in ("signal_names", "novelty")})
    return reports.features(members).join(told, "incident_key")


def full_run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case notes with detections, behaviour signals and repeated alerts."""
    rows, members = _run(spark, sf_dir)
    return reports.case_notes(rows, members, signals=run.signal_features(members), repeats=reports.repeated_pairs(members))


def full_run_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic answers for each incident, fed with its signals."""
    rows, members = _run(spark, sf_dir)
    told = rows.join(run.signal_features(members).select("incident_key", "signals"), "incident_key")
    return quality.baseline_decision(told, F.col("signals"))


_names = ", ".join(f"('{r['rule_id']}', '{r['name']}')" for r in RULES)
_SETTLED = f"""{FOUND}, {_FEEDBACK}, {_IDENTITIES}, {_assets_sql}, nm(rule_id, rule_name) AS (VALUES {_names}), x0(suppression_id, position, xr, xe, xaction, downgrade_to, expires_us, enabled) AS (VALUES {_exceptions}),
sig AS (WITH {SIGNAL_CTES} SELECT event_id, entity, signal, CAST(points AS BIGINT) AS points FROM s),
anom AS (SELECT event_id, CAST(least(sum(points), 100) AS INTEGER) AS score, string_agg(DISTINCT signal, ', ' ORDER BY signal) AS names, count(*) AS n FROM sig GROUP BY 1 HAVING sum(points) >= 25),
hay AS (SELECT *, lower(concat_ws(' ', action, user_name, host, process_name, command_line, props)) AS h FROM ve),
ti AS (SELECT *, array_to_string(list_filter([CASE WHEN src_ip = '203.0.113.12' THEN 'i1' END, CASE WHEN contains(h, 'cmd.exe /c step3') OR contains(h, 'powershell.exe') THEN 'i2' END, CASE WHEN contains(h, 'sqbf') THEN 'i3' END, CASE WHEN src_ip IN ('10.1.1.2', '10.1.1.3') THEN 'i4' END], lambda i: i IS NOT NULL), ',') AS ind FROM hay),
af AS (SELECT finding_id, event_id, rule_id, rule_name, severity, risk_points, techniques, entities, seq, us, '' AS indicators, 0 AS signals FROM found JOIN nm USING (rule_id)
  UNION ALL SELECT sha256('AUTO-INTEL-001:' || event_id), event_id, 'AUTO-INTEL-001', 'Threat intelligence match', 75, 75, [], entities, seq, us, ind, 0 FROM ti WHERE ind <> ''
  UNION ALL SELECT 'anomaly-' || event_id, event_id, 'builtin-anomaly-baseline', 'Behavioral anomaly (' || names || ')', CASE WHEN score >= 50 THEN 75 ELSE 50 END, score, [], entities, seq, us, '', n FROM anom JOIN ve USING (event_id)),
mx AS (SELECT finding_id, arg_min(suppression_id, position) AS suppression_id FROM af, x0 WHERE enabled AND (expires_us IS NULL OR expires_us >= {NOW_US}) AND (xr = '*' OR xr = rule_id) AND (xe IS NULL OR list_contains(entities, xe)) GROUP BY 1),
ex AS (SELECT af.*, suppression_id, xaction, downgrade_to FROM af LEFT JOIN mx USING (finding_id) LEFT JOIN x0 USING (suppression_id)),
rc AS (SELECT finding_id, row_number() OVER (PARTITION BY rule_id, coalesce(entities[1], '') ORDER BY us, seq) - count(*) OVER (PARTITION BY rule_id, coalesce(entities[1], '') ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 900000001 PRECEDING) AS n FROM ex WHERE suppression_id IS NULL),
jd AS (SELECT ex.* REPLACE (CASE WHEN xaction = 'downgrade' AND severity > downgrade_to THEN downgrade_to ELSE severity END AS severity), CASE WHEN n > 5 THEN 'repeated' WHEN xaction = 'suppress' THEN 'suppressed' WHEN xaction = 'downgrade' AND severity > downgrade_to THEN 'downgraded' ELSE 'kept' END AS outcome FROM ex LEFT JOIN rc USING (finding_id)),
tw AS (SELECT jd.* REPLACE (CASE WHEN outcome IN ('kept', 'downgraded') AND weight < 1 THEN CAST(round_even(risk_points * weight, 0) AS INTEGER) ELSE risk_points END AS risk_points) FROM jd LEFT JOIN w USING (rule_id)),
rl(role, rule_id) AS (VALUES {", ".join(str(r) for r in ROLES)}), act AS (SELECT key, rule_id FROM ix JOIN cu USING (pos) JOIN rl ON role = (['it-admin', 'ci-deploy', 'backup', 'guest'])[pos % 4 + 1] WHERE NOT off AND rule_id <> 'SEED-RARE-1'),
fr AS (SELECT finding_id, rule_id, unnest(entities) AS entity FROM tw), rt AS (SELECT DISTINCT finding_id FROM fr JOIN act ON entity = 'user:' || key AND fr.rule_id = act.rule_id),
cm AS (SELECT finding_id, max(m) AS m FROM fr JOIN (SELECT entity, CASE criticality WHEN 'critical' THEN 200 WHEN 'high' THEN 150 WHEN 'medium' THEN 100 ELSE 75 END AS m FROM ident WHERE criticality IS NOT NULL UNION ALL SELECT 'host:' || key, m FROM a) USING (entity) GROUP BY 1),
st AS (SELECT * REPLACE (CASE WHEN routine THEN least(severity, 25) ELSE severity END AS severity, CASE WHEN NOT live OR risk_points <= 0 THEN risk_points WHEN routine THEN greatest(CAST(round_even(risk_points * 0.25, 0) AS INTEGER), 1)
    WHEN m IS NOT NULL THEN greatest(CAST(round_even(risk_points * m / 100, 0) AS INTEGER), 1) ELSE risk_points END AS risk_points)
  FROM (SELECT tw.*, outcome IN ('kept', 'downgraded') AS live, outcome IN ('kept', 'downgraded') AND severity < 100 AND finding_id IN (SELECT finding_id FROM rt) AS routine, m FROM tw LEFT JOIN cm USING (finding_id)) z)"""
_RUN = f"{_SETTLED}, sf AS (SELECT finding_id, event_id, rule_id, rule_name, severity, risk_points, techniques, entities, seq, us FROM st WHERE live), {CORRELATED}"
_SIGNALS = """sg AS (SELECT incident_key, signal, points FROM sf JOIN key USING (finding_id) JOIN sig USING (event_id) WHERE rule_id = 'builtin-anomaly-baseline'),
sn AS (SELECT incident_key, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signal_names, count(*) AS signals, CAST(sum(points) AS BIGINT) AS signal_points, string_agg(DISTINCT signal, ',' ORDER BY signal) FILTER (starts_with(signal, 'novel_')) AS novelty,
  bool_or(signal = 'off_hours') AS off_hours, bool_or(signal = 'rare_action') AS rare_action, bool_or(signal = 'peer_rare') AS peer_rare, bool_or(signal = 'burst') AS burst FROM sg GROUP BY 1)"""
QUERIES = [full_run, full_run_findings, full_run_features, full_run_notes, full_run_baseline]
SQL = {
    "full_run_findings": f"WITH {_SETTLED} SELECT finding_id, rule_id, rule_name, outcome, suppression_id, routine, severity, risk_points, indicators, CAST(signals AS INTEGER) AS signals FROM st",
    "full_run": f"WITH RECURSIVE {_RUN} SELECT incident_key, risk_score, severity, findings, anomalies, primary_entity, array_to_string(entities, ',') AS entities, array_to_string(chain, ',') AS kill_chain, first_us, last_us, confidence, decision, owner FROM dec",
    "full_run_features": f"""WITH RECURSIVE {_RUN}, {_SIGNALS}, mb AS (SELECT incident_key, rule_id, risk_points, us, unnest(CASE WHEN len(entities) = 0 THEN [NULL] ELSE entities END) AS entity FROM sf JOIN key USING (finding_id)),
ft AS (SELECT incident_key, count(DISTINCT entity) FILTER (starts_with(entity, 'user:')) AS users, count(DISTINCT entity) FILTER (starts_with(entity, 'host:')) AS hosts, count(DISTINCT entity) FILTER (starts_with(entity, 'ip:')) AS addresses,
  count(DISTINCT rule_id) AS rules, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_list, max(risk_points) AS top_risk, max(us) - min(us) AS span_us FROM mb GROUP BY 1)
SELECT ft.*, coalesce(signal_names, '') AS signal_names, coalesce(signals, 0) AS signals, coalesce(signal_points, 0) AS signal_points, coalesce(novelty, '') AS novelty, coalesce(off_hours, false) AS off_hours, coalesce(rare_action, false) AS rare_action, coalesce(peer_rare, false) AS peer_rare, coalesce(burst, false) AS burst FROM ft LEFT JOIN sn USING (incident_key)""",
    "full_run_notes": f"""WITH RECURSIVE {_RUN}, {_SIGNALS}, rn AS (SELECT incident_key, array_to_string(list(rule_name ORDER BY rule_name)[1:5], '; ') AS rules FROM (SELECT DISTINCT incident_key, rule_name FROM sf JOIN key USING (finding_id) WHERE NOT starts_with(rule_id, 'builtin-anomaly')) GROUP BY 1),
dp AS (SELECT incident_key, count(*) AS pairs, sum(n) - count(*) AS collapsed FROM (SELECT incident_key, rule_id, coalesce(entities[1], 'global:unknown') AS e, count(*) AS n FROM sf JOIN key USING (finding_id) GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)
SELECT incident_key, 'AI triage note for ' || {_title} || chr(10) || chr(10) || 'Risk ' || risk_score || ' / severity ' || CASE severity WHEN 0 THEN 'informational' WHEN 25 THEN 'low' WHEN 50 THEN 'medium' WHEN 75 THEN 'high' ELSE 'critical' END || ' from ' || findings || ' finding(s) across ' || len(entities) || ' entit' || CASE WHEN len(entities) = 1 THEN 'y' ELSE 'ies' END || '.'
  || CASE WHEN len(chain) > 0 THEN chr(10) || 'ATT&CK progression: ' || array_to_string(chain, ' -> ') || '.' ELSE '' END || coalesce(chr(10) || 'Detections: ' || rules || '.', '') || coalesce(chr(10) || 'Behavioral signals: ' || replace(signal_names, ',', ', ') || '.', '')
  || coalesce(chr(10) || 'Context: ' || pairs || ' repeated rule/entity pair(s) collapsing ' || CAST(collapsed AS BIGINT) || ' finding(s).', '') || chr(10) || 'Entities: ' || array_to_string(entities, ', ') || '.' AS note
FROM dec LEFT JOIN rn USING (incident_key) LEFT JOIN sn USING (incident_key) LEFT JOIN dp USING (incident_key)""",
    "full_run_baseline": f"""WITH RECURSIVE {_RUN}, {_SIGNALS}, b AS (SELECT incident_key, severity, risk_score, coalesce(signals, 0) > 1 AS several, greatest(0.02::DOUBLE, least(0.98::DOUBLE, risk_score / 500.0::DOUBLE)) AS c FROM dec LEFT JOIN sn USING (incident_key)),
p AS (SELECT *, CASE WHEN severity IN (75, 100) THEN greatest(c, 0.9::DOUBLE) WHEN risk_score >= 100 THEN greatest(c, 0.6::DOUBLE) ELSE c END AS p, CASE WHEN severity IN (50, 75) AND several THEN 0.7::DOUBLE ELSE 0.2::DOUBLE END AS n FROM b)
SELECT incident_key, p AS probability, p >= 0.5 AS malicious, severity, CASE severity WHEN 100 THEN 'escalate' WHEN 75 THEN 'investigate' WHEN 50 THEN 'investigate' WHEN 25 THEN 'monitor' ELSE 'suppress' END AS action, c AS confidence, n AS narrative, n >= 0.5 AS needs_narrative FROM p""",
}
