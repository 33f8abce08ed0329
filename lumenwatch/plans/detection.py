"""Registered queries of detection, suppression, incidents and triage, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES, TECHNIQUES
from ..operators import detection, graph, incidents, suppression, triage
from ..sources.events import V, X, security_events

NOW_US, DAY = 0, 86_400_000_000
#: (suppression_id, position, rule_id, entity, action, downgrade_to, expires_us, enabled): the first that fits counts.
EXCEPTIONS = [
    ("s1", 1, "SEED-AUTH-1", "user:u7", "suppress", None, None, True),
    ("s2", 2, "*", "ip:203.0.113.12", "downgrade", 25, None, True),
    ("s3", 3, "SEED-EXEC-1", None, "downgrade", 50, 1, True),
    ("s4", 4, "SEED-RARE-1", None, "downgrade", 50, None, True),
    ("s5", 5, "*", "user:u9", "suppress", None, -1, True),
    ("s6", 6, "*", "user:u10", "suppress", None, None, False),
]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.evaluate(security_events(spark, sf_dir), RULES)


def detect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select("finding_id", "event_id", "rule_id", "severity", "risk_points", F.concat_ws(",", "entities").alias("entities"), F.concat_ws(",", "techniques").alias("techniques"))


def rule_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.backtest(security_events(spark, sf_dir), RULES, F.col("outcome") == "failure")


def rule_state_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule switches logged by signups: the latest one counts."""
    events = security_events(spark, sf_dir).where("action LIKE 'login_success%'")
    names = F.array(*[F.lit(r["rule_id"]) for r in RULES])
    changes = events.select(F.element_at(names, (F.col("event_id") % (len(RULES) - 1) + 1).cast("int")).alias("rule_id"), (F.col("value") > 50).alias("enabled"), F.col("us").alias("updated_at"), "seq")
    rules = detection.merge_rules(detection.rule_table(spark, RULES), detection.rule_table(spark, [{**RULES[0], "name": "loses"}]))
    return detection.overlay_state(rules, changes).select("rule_id", "name", "severity", "enabled")


def rule_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = {"rule_id": "SEED-DNS-1", "selection": {"category": "dns", "query": {"contains": ".zip"}}}
    return detection.applicability(security_events(spark, sf_dir), [*RULES, extra])


def technique_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.coverage(_findings(spark, sf_dir), _matrix_table(spark))


def exceptions_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(EXCEPTIONS, "suppression_id string, position int, rule_id string, entity string, action string, downgrade_to int, expires_us long, enabled boolean")
    out = suppression.apply_exceptions(suppression.matched(_findings(spark, sf_dir), F.broadcast(rows), F.lit(NOW_US)))
    return out.select("finding_id", "rule_id", "suppression_id", "outcome", "severity")


def repeat_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = security_events(spark, sf_dir).where("user_name IS NOT NULL")
    return suppression.repeats(events, DAY, rule="outcome", entity=F.col("user_name")).select("event_id", "repeat_count", "repeated")


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst decisions, from the quality labels of documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = F.array(*[F.lit(r["rule_id"]) for r in RULES])
    decision = F.when(F.col("quality") == 1, "approve").when(F.col("toxic") == 1, "reject").otherwise("defer")
    return labels.select(F.element_at(names, (F.col("doc_id") % len(RULES) + 1).cast("int")).alias("rule_id"), F.concat(F.lit("user:u"), (F.col("doc_id") % 50).cast("string")).alias("entity"), decision.alias("decision"))


def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppression.trust(_feedback(spark, sf_dir))


def feedback_reweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suppression.reweight(_findings(spark, sf_dir), suppression.trust(_feedback(spark, sf_dir)))
    return out.groupBy("rule_id").agg(F.sum("risk_points").alias("risk"), F.count("*").alias("n"))


def feedback_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppression.rejected_pairs(_feedback(spark, sf_dir))


def entity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.entity_risk(_findings(spark, sf_dir)).withColumn("reasons", F.concat_ws(",", "reasons"))


def named(members: DataFrame) -> DataFrame:
    """Findings with the name of their rule."""
    names = F.create_map(*[F.lit(x) for r in RULES for x in (r["rule_id"], r["name"])])
    return members.withColumn("rule_name", names[F.col("rule_id")])


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.save_incidents(_findings(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.save_members(_findings(spark, sf_dir))


def _matrix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TECHNIQUES, "technique string, name string, tactics array<string>")


def incident_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _incidents(spark, sf_dir)
    return rows.select("incident_key", "risk_score", "severity", "findings", "primary_entity", "title", F.concat_ws(",", "entities").alias("entities"), F.concat_ws(",", "kill_chain").alias("kill_chain"), "first_us", "last_us")


def incident_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.decide(triage.confidence(_incidents(spark, sf_dir))).select("incident_key", "confidence", "decision", "owner")


def incident_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.proposals(triage.decide(triage.confidence(_incidents(spark, sf_dir))))


def incident_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings, matched with the stored incidents of their entities."""
    found = graph.save(_findings(spark, sf_dir), "findings")
    return incidents.merge_targets(incidents.save_incidents(found), found)


def _status(risk: Column) -> Column:
    return F.when(risk >= 70, "open").when(risk >= 40, "investigating").otherwise("closed")


def incident_merge_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings sent to incidents of which those below a risk of 40 were closed meanwhile: these findings become incidents of their own."""
    found = graph.save(_findings(spark, sf_dir), "findings")
    stored = incidents.save_incidents(found)
    current = stored.select("incident_key", _status(F.col("risk_score")).alias("status"))
    return incidents.settled(incidents.merge_targets(stored, found), current, found).select("finding_id", "incident_key", "fate")


def incident_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each incident in order of time."""
    return incidents.members(_members(spark, sf_dir)).select("incident_key", "finding_id", "place")


def incident_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.summarized(_incidents(spark, sf_dir), _matrix_table(spark)).select("incident_key", "summary")


def incident_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.ranked(_incidents(spark, sf_dir)).select("incident_key", "risk_score", "place")


def duplicate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.duplicate_clusters(_findings(spark, sf_dir))


_TESTS = {
    "SEED-AUTH-1": "category = 'authentication' AND outcome = 'failure'",
    "SEED-EXEC-1": "category = 'process' AND contains(lower(coalesce(command_line, '')), ' -enc ')",
    "SEED-EXEC-2": "process_name IN ('powershell.exe', 'pwsh.exe') AND contains(lower(command_line), '/c') AND contains(lower(command_line), 'step1') AND NOT (ends_with(command_line, 'step1') OR ends_with(command_line, 'step12'))",
    "SEED-CLOUD-1": "action = 'AssumeRole' AND cloud_account IS NOT NULL AND src_ip IS NOT NULL AND NOT starts_with(src_ip, '203.')",
    "SEED-RARE-1": "regexp_matches(action, '_rare[0-4]$')",
    "SEED-WEB-1": "(action = 'http_request' AND host IS NULL) OR starts_with(action, 'http_request_') OR starts_with(action, 'AssumeRole_')",
    "SEED-EXT-1": "starts_with(coalesce(src_ip, ''), '203.0.113.') AND outcome = 'failure'",
    "SEED-HOST-1": "host IS NULL AND NOT (coalesce(user_name, '') IN ('u1', 'u2')) AND category <> 'network'",
}
_rule_rows = ", ".join(f"('{r['rule_id']}', '{r['name']}', {r['severity']}, {r['risk_points']}, {json.dumps(r['techniques']).replace(chr(34), chr(39))}::VARCHAR[])" for r in RULES)
RULE_CTE = f"rules(rule_id, name, severity, risk_points, techniques) AS (VALUES {_rule_rows})"
_fired = ", ".join(f"CASE WHEN {t} THEN '{r}' END" for r, t in _TESTS.items())
FOUND = f"""{X}, {RULE_CTE}, hits AS (SELECT *, unnest(list_filter([{_fired}], lambda r: r IS NOT NULL)) AS rule_id FROM ve),
found AS (SELECT sha256(rule_id || ':' || event_id) AS finding_id, event_id, rule_id, severity, risk_points, techniques, entities, seq, us FROM hits JOIN rules USING (rule_id))"""
_matrix = ", ".join(f"('{t}', {json.dumps(x).replace(chr(34), chr(39))})" for t, _, x in TECHNIQUES)
_exceptions = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (bool, int)) else f"'{v}'" for v in e) + ")" for e in EXCEPTIONS)
_FEEDBACK = f"""fb AS (SELECT ([{", ".join(f"'{r['rule_id']}'" for r in RULES)}])[doc_id % {len(RULES)} + 1] AS rule_id, 'user:u' || (doc_id % 50) AS entity,
  CASE WHEN quality = 1 THEN 'approve' WHEN toxic = 1 THEN 'reject' ELSE 'defer' END AS decision FROM labels),
w AS (SELECT rule_id, greatest(least(10 + count(*) FILTER (decision = 'approve') - 2 * count(*) FILTER (decision = 'reject'), 30), 1) / 10 AS weight FROM fb GROUP BY 1)"""
#: From findings sf to incidents inc and what is decided about them, dec.
CORRELATED = f"""fe AS (SELECT finding_id, us, risk_points, unnest(CASE WHEN len(entities) = 0 THEN ['global:unknown'] ELSE entities END) AS entity FROM sf),
gaps AS (SELECT *, us - lag(us) OVER (PARTITION BY entity ORDER BY us) AS gap FROM (SELECT DISTINCT entity, us FROM fe)),
eps AS (SELECT entity, us, sum(CASE WHEN gap IS NULL OR gap > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY us) AS ep FROM gaps),
mem AS (SELECT finding_id, entity, ep FROM fe JOIN eps USING (entity, us)),
edge AS (SELECT finding_id AS a, min(finding_id) OVER (PARTITION BY entity, ep) AS b FROM mem),
e2 AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
lab(a, b) USING KEY (a) AS (SELECT finding_id, finding_id FROM sf UNION
  SELECT e2.a, min(lab.b) FROM lab JOIN e2 ON e2.b = lab.a JOIN recurring.lab AS old ON old.a = e2.a WHERE lab.b < old.b GROUP BY 1),
key AS (SELECT a AS finding_id, b AS incident_key FROM lab),
inc0 AS (SELECT incident_key, CAST(least(sum(risk_points), 1000) AS BIGINT) AS risk_score, max(severity) AS severity, count(*) AS findings, count(*) FILTER (starts_with(rule_id, 'builtin-anomaly')) AS anomalies, min(us) AS first_us, max(us) AS last_us FROM sf JOIN key USING (finding_id) GROUP BY 1),
own AS (SELECT incident_key, entity, sum(risk_points) AS risk FROM fe JOIN key USING (finding_id) GROUP BY 1, 2),
ent AS (SELECT incident_key, list(entity ORDER BY entity) AS entities, arg_min(entity, {{'r': -risk, 'e': entity}}) AS primary_entity FROM own GROUP BY 1),
kc AS (SELECT incident_key, list(t ORDER BY f) AS kill_chain FROM (SELECT incident_key, t, min({{'us': us, 'seq': seq, 'r': rule_id, 'p': p}}) AS f
  FROM (SELECT incident_key, us, seq, rule_id, unnest(techniques) AS t, unnest(range(len(techniques))) AS p FROM sf JOIN key USING (finding_id)) GROUP BY 1, 2) GROUP BY 1),
inc AS (SELECT *, coalesce(kill_chain, []) AS chain, len(entities) - 1 AS others FROM inc0 JOIN ent USING (incident_key) LEFT JOIN kc USING (incident_key)),
dec AS (SELECT *, least(20 + CASE WHEN risk_score >= 200 THEN 25 WHEN risk_score >= 100 THEN 15 ELSE 0 END + CASE WHEN severity >= 75 THEN 20 ELSE 0 END + CASE WHEN len(chain) > 0 THEN 15 ELSE 0 END
  + CASE WHEN findings >= 3 THEN 10 ELSE 0 END + CASE WHEN anomalies > 0 THEN 10 ELSE 0 END, 99) / 100 AS confidence,
  CASE WHEN severity >= 75 AND risk_score >= 200 THEN 'containment_proposed' WHEN risk_score >= 100 OR severity >= 50 THEN 'escalate' WHEN risk_score >= 30 THEN 'suspicious_monitor' ELSE 'likely_benign' END AS decision,
  CASE WHEN severity >= 75 AND risk_score >= 200 THEN 'tier-2-incident-responder' WHEN risk_score >= 100 OR severity >= 50 THEN 'tier-2-analyst' ELSE 'tier-1-queue' END AS owner FROM inc)"""
INCIDENTS = f"{FOUND}, sf AS (SELECT * FROM found), {CORRELATED}"

SUMMARY = f"""m(technique, tactics) AS (VALUES {_matrix}), k AS (SELECT incident_key, unnest(chain) AS t, unnest(range(len(chain))) AS p FROM inc),
tt AS (SELECT incident_key, coalesce(a.tactics, b.tactics)[1] AS tactic, min(p) AS p FROM k LEFT JOIN m a ON a.technique = k.t LEFT JOIN m b ON b.technique = split_part(k.t, '.', 1) GROUP BY 1, 2),
g AS (SELECT incident_key, string_agg(tactic, ' → ' ORDER BY p) AS path FROM tt WHERE tactic IS NOT NULL GROUP BY 1),
s AS (SELECT *, (last_us - first_us) / 1e6 AS sec FROM inc LEFT JOIN g USING (incident_key)),
summ AS (SELECT incident_key, findings || ' correlated finding(s) across ' || len(entities) || ' entit' || CASE WHEN len(entities) = 1 THEN 'y' ELSE 'ies' END || ', risk ' || risk_score || '.' || coalesce(' Attack progression: ' || path || '.', '')
  || CASE WHEN sec > 0 THEN ' Spanning ' || CASE WHEN sec < 60 THEN CAST(floor(sec) AS BIGINT) || 's' WHEN sec < 3600 THEN CAST(floor(sec / 60) AS BIGINT) || 'm' WHEN sec < 86400 THEN printf('%.1fh', sec / 3600) ELSE printf('%.1fd', sec / 86400) END || ' from first to last finding.' ELSE '' END
  || ' Highest-risk entity: ' || primary_entity || '.' AS summary FROM s)"""

QUERIES = [detect_findings, rule_backtest, rule_state_overlay, rule_applicability, technique_coverage, exceptions_applied, repeat_suppression, feedback_weights, feedback_reweighted, feedback_rejected, entity_risk, incident_rollup, incident_triage, incident_proposals, incident_merge, incident_merge_closed, incident_members, incident_summaries, incident_ranking, duplicate_alerts]
SQL = {
    "detect_findings": f"WITH {FOUND} SELECT finding_id, event_id, rule_id, severity, risk_points, array_to_string(entities, ',') AS entities, array_to_string(techniques, ',') AS techniques FROM found",
    "rule_backtest": f"WITH {FOUND} SELECT rule_id, count(*) AS hits, count(*) FILTER (outcome = 'failure') AS tp, count(*) FILTER (outcome <> 'failure') AS fp FROM hits GROUP BY 1",
    "rule_state_overlay": f"""WITH {V}, {RULE_CTE}, c AS (SELECT ([{", ".join(f"'{r['rule_id']}'" for r in RULES)}])[event_id % {len(RULES) - 1} + 1] AS rule_id, value > 50 AS enabled, us, seq FROM v WHERE action LIKE 'login_success%'),
l AS (SELECT rule_id, arg_max(enabled, {{'u': us, 's': seq}}) AS saved FROM c GROUP BY 1) SELECT rule_id, name, severity, coalesce(saved, true) AS enabled FROM rules LEFT JOIN l USING (rule_id)""",
    "rule_applicability": "SELECT * FROM (VALUES ('SEED-AUTH-1', 2, 0, 'imported'), ('SEED-EXEC-1', 2, 0, 'imported'), ('SEED-EXEC-2', 2, 0, 'imported'), ('SEED-CLOUD-1', 3, 0, 'imported'), ('SEED-RARE-1', 1, 0, 'imported'), ('SEED-WEB-1', 2, 0, 'imported'), ('SEED-EXT-1', 2, 0, 'imported'), ('SEED-HOST-1', 3, 0, 'imported'), ('SEED-DNS-1', 2, 1, 'not_applicable')) t(rule_id, fields, missing_fields, status)",
    "technique_coverage": f"""WITH {FOUND}, m(technique, tactics) AS (VALUES {_matrix}), used AS (SELECT finding_id, unnest(techniques) AS technique FROM found),
seen AS (SELECT DISTINCT technique FROM used UNION SELECT DISTINCT split_part(technique, '.', 1) FROM used), mt AS (SELECT technique, unnest(tactics) AS tactic FROM m),
per AS (SELECT tactic, count(*) AS techniques, count(*) FILTER (technique IN (SELECT technique FROM seen)) AS covered FROM mt GROUP BY 1),
f AS (SELECT unnest(coalesce(a.tactics, b.tactics)) AS tactic FROM used u LEFT JOIN m a USING (technique) LEFT JOIN m b ON b.technique = split_part(u.technique, '.', 1)),
n AS (SELECT tactic, count(*) AS findings FROM f GROUP BY 1) SELECT tactic, techniques, covered, coalesce(findings, 0) AS findings FROM per LEFT JOIN n USING (tactic)""",
    "exceptions_applied": f"""WITH {FOUND}, x0(suppression_id, position, xr, xe, xaction, downgrade_to, expires_us, enabled) AS (VALUES {_exceptions}),
m AS (SELECT finding_id, arg_min(suppression_id, position) AS suppression_id FROM found, x0 WHERE enabled AND (expires_us IS NULL OR expires_us >= {NOW_US}) AND (xr = '*' OR xr = rule_id) AND (xe IS NULL OR list_contains(entities, xe)) GROUP BY 1)
SELECT finding_id, rule_id, suppression_id, CASE WHEN xaction = 'suppress' THEN 'suppressed' WHEN xaction = 'downgrade' AND severity > downgrade_to THEN 'downgraded' ELSE 'kept' END AS outcome,
  CASE WHEN xaction = 'downgrade' AND severity > downgrade_to THEN downgrade_to ELSE severity END AS severity FROM found LEFT JOIN m USING (finding_id) LEFT JOIN x0 USING (suppression_id)""",
    "repeat_suppression": f"""WITH {V}, n AS (SELECT event_id, row_number() OVER (PARTITION BY outcome, user_name ORDER BY us, seq)
  - count(*) OVER (PARTITION BY outcome, user_name ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY + 1} PRECEDING) AS repeat_count FROM v WHERE user_name IS NOT NULL)
SELECT event_id, repeat_count, repeat_count > 5 AS repeated FROM n""",
    "feedback_weights": f"WITH {_FEEDBACK} SELECT * FROM w",
    "feedback_reweighted": f"WITH {FOUND}, {_FEEDBACK} SELECT rule_id, CAST(sum(CASE WHEN weight < 1 THEN CAST(round_even(risk_points * weight, 0) AS BIGINT) ELSE risk_points END) AS BIGINT) AS risk, count(*) AS n FROM found LEFT JOIN w USING (rule_id) GROUP BY 1",
    "feedback_rejected": f"WITH {_FEEDBACK} SELECT DISTINCT rule_id, entity, weight FROM fb JOIN w USING (rule_id) WHERE decision = 'reject'",
    "entity_risk": f"""WITH {FOUND}, fe AS (SELECT rule_id, risk_points, unnest(CASE WHEN len(entities) = 0 THEN ['global:unknown'] ELSE entities END) AS entity FROM found)
SELECT entity, CAST(least(sum(risk_points), 1000) AS BIGINT) AS risk, count(*) AS findings, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS reasons FROM fe GROUP BY 1""",
    "incident_rollup": f"""WITH RECURSIVE {INCIDENTS} SELECT incident_key, risk_score, severity, findings, primary_entity, CASE WHEN others <= 0 THEN 'Suspicious activity involving ' || primary_entity
  ELSE 'Correlated activity involving ' || primary_entity || ' and ' || others || ' related entit' || CASE WHEN others = 1 THEN 'y' ELSE 'ies' END END AS title,
  array_to_string(entities, ',') AS entities, array_to_string(chain, ',') AS kill_chain, first_us, last_us FROM inc""",
    "incident_triage": f"WITH RECURSIVE {INCIDENTS} SELECT incident_key, confidence, decision, owner FROM dec",
    "incident_proposals": f"""WITH RECURSIVE {INCIDENTS}, t AS (SELECT incident_key, confidence, unnest(entities) AS target FROM dec WHERE decision = 'containment_proposed')
SELECT incident_key, CASE split_part(target, ':', 1) WHEN 'user' THEN 'disable_user' WHEN 'host' THEN 'isolate_host' ELSE 'block_indicator' END AS action, target, confidence, false AS executable_now, true AS approval_required
FROM t WHERE split_part(target, ':', 1) IN ('user', 'host', 'ip') UNION ALL SELECT incident_key, 'notify_channel', 'channel:soc-escalations', confidence, true, false FROM dec WHERE decision = 'escalate'""",
    "incident_merge": f"""WITH RECURSIVE {INCIDENTS}, low AS (SELECT finding_id, us, unnest(entities) AS entity FROM found), ie AS (SELECT incident_key, risk_score, first_us, last_us, unnest(entities) AS entity FROM inc)
SELECT finding_id, arg_min(incident_key, {{'r': -risk_score, 'f': first_us, 'k': incident_key}}) AS incident_key FROM low JOIN ie USING (entity)
WHERE us >= first_us - {DAY} AND us <= last_us + {DAY} GROUP BY 1""",
    "incident_merge_closed": f"""WITH RECURSIVE {INCIDENTS}, low AS (SELECT finding_id, us, unnest(entities) AS entity FROM found), ie AS (SELECT incident_key, risk_score, first_us, last_us, unnest(entities) AS entity FROM inc),
t AS (SELECT finding_id, arg_min(incident_key, {{'r': -risk_score, 'f': first_us, 'k': incident_key}}) AS incident_key, arg_min(risk_score, {{'r': -risk_score, 'f': first_us, 'k': incident_key}}) AS risk FROM low JOIN ie USING (entity)
  WHERE us >= first_us - {DAY} AND us <= last_us + {DAY} GROUP BY 1),
rest AS (SELECT * FROM found ANTI JOIN (SELECT finding_id FROM t WHERE risk >= 40) USING (finding_id)),
re AS (SELECT finding_id, us, unnest(CASE WHEN len(entities) = 0 THEN ['global:unknown'] ELSE entities END) AS entity FROM rest),
rg AS (SELECT *, us - lag(us) OVER (PARTITION BY entity ORDER BY us) AS gap FROM (SELECT DISTINCT entity, us FROM re)),
rp AS (SELECT entity, us, sum(CASE WHEN gap IS NULL OR gap > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY us) AS ep FROM rg),
r1 AS (SELECT finding_id AS a, min(finding_id) OVER (PARTITION BY entity, ep) AS b FROM re JOIN rp USING (entity, us)),
r2 AS (SELECT a, b FROM r1 WHERE a <> b UNION SELECT b, a FROM r1 WHERE a <> b),
lab2(a, b) USING KEY (a) AS (SELECT finding_id, finding_id FROM rest UNION
  SELECT r2.a, min(lab2.b) FROM lab2 JOIN r2 ON r2.b = lab2.a JOIN recurring.lab2 AS old ON old.a = r2.a WHERE lab2.b < old.b GROUP BY 1)
SELECT finding_id, incident_key, 'merged' AS fate FROM t WHERE risk >= 40 UNION ALL SELECT a, b, 'fresh' FROM lab2""",
    "incident_members": f"WITH RECURSIVE {INCIDENTS} SELECT incident_key, finding_id, row_number() OVER (PARTITION BY incident_key ORDER BY us, seq, rule_id) AS place FROM sf JOIN key USING (finding_id)",
    "incident_summaries": f"WITH RECURSIVE {INCIDENTS}, {SUMMARY} SELECT * FROM summ",
    "incident_ranking": f"WITH RECURSIVE {INCIDENTS} SELECT incident_key, risk_score, row_number() OVER (ORDER BY risk_score DESC, first_us, incident_key) AS place FROM inc",
    "duplicate_alerts": f"WITH {FOUND} SELECT rule_id, coalesce(entities[1], 'global:unknown') AS entity, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM found GROUP BY 1, 2 HAVING count(*) > 1",
}
