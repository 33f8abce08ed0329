"""Registered queries of tenants whose ids repeat, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RULES
from ..operators import detection, incidents, suppression, tenants, triage
from ..sources.events import X, security_events
from .detection import _TESTS, CORRELATED, DAY, EXCEPTIONS, RULE_CTE

#: Exceptions by position, dealt to the tenants in turn.
OWN = [(*e, f"t{e[1] % 3}") for e in EXCEPTIONS]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of three tenants, which number them alike and share users, hosts and addresses."""
    events = security_events(spark, sf_dir).withColumn("tenant", F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")))
    return events.withColumn("event_id", F.floor(F.col("event_id") / 3))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    content = F.broadcast(detection.rule_table(spark, RULES).select("rule_id", "severity", "risk_points", "techniques"))  # the rules given
    rows = detection.hits(events, RULES).join(content, "rule_id")
    return rows.select("tenant", detection.finding_id("rule_id", "event_id").alias("finding_id"), "event_id", "rule_id", "severity", "risk_points", "techniques", "entities", "seq", "us")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(r["rule_id"]) for r in RULES])
    return _events(spark, sf_dir).where("action LIKE 'login_success%'").select("tenant", F.element_at(names, (F.col("seq") % len(RULES) + 1).cast("int")).alias("rule_id"), (F.col("value") > 50).alias("enabled"), F.col("us").alias("updated_at"), "seq")


def tenant_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules that their own tenant has on."""
    return tenants.switched(_findings(spark, sf_dir), _changes(spark, sf_dir)).select("tenant", "finding_id", "event_id", "rule_id")


def tenant_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of the finding's own tenant, and repeats among its own findings; those that an exception fits are not counted."""
    own = F.broadcast(spark.createDataFrame(OWN, "suppression_id string, position int, rule_id string, entity string, action string, downgrade_to int, expires_us long, enabled boolean, tenant string"))
    rows = suppression.apply_exceptions(suppression.matched(_findings(spark, sf_dir), own, F.lit(0), ("tenant",)))
    counted = suppression.repeats(rows.where("suppression_id IS NULL"), DAY, by=("tenant",)).select("tenant", "finding_id", "rule_id", "suppression_id", "outcome", "repeat_count")
    return counted.unionByName(rows.where("suppression_id IS NOT NULL").select("tenant", "finding_id", "rule_id", "suppression_id", "outcome", F.lit(0).cast("long").alias("repeat_count")))


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents under keys of their tenant's own; events too, as findings are linked by them."""
    return incidents.save_incidents(tenants.scoped(_findings(spark, sf_dir), "finding_id", "event_id"))


def tenant_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tenants.unscoped(_incidents(spark, sf_dir), "incident_key")
    return rows.select("tenant", "incident_key", "risk_score", "severity", "findings", "primary_entity", "title", F.concat_ws(",", "entities").alias("entities"), "first_us", "last_us")


def tenant_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triage.proposals(triage.decide(triage.confidence(_incidents(spark, sf_dir))))
    return tenants.unscoped(rows, "incident_key")


def tenant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, findings, incidents, pending proposals and exceptions of each tenant."""
    found = _incidents(spark, sf_dir)
    pending = triage.proposals(triage.decide(triage.confidence(found))).where("approval_required")
    own = spark.createDataFrame([(e[-1],) for e in OWN], "tenant string")
    own_key = lambda rows: tenants.unscoped(rows.select("incident_key"), "incident_key")
    return tenants.counts(events=_events(spark, sf_dir), findings=_findings(spark, sf_dir), incidents=own_key(found), proposals_pending=own_key(pending), suppressions=own)


_fired = ", ".join(f"CASE WHEN {t} THEN '{r}' END" for r, t in _TESTS.items())
_TENANTS = f"""{X}, {RULE_CTE}, vt AS (SELECT * REPLACE (event_id // 3 AS event_id), 't' || (event_id % 3) AS tenant FROM ve),
th AS (SELECT *, unnest(list_filter([{_fired}], lambda r: r IS NOT NULL)) AS rule_id FROM vt),
tf AS (SELECT tenant, sha256(rule_id || ':' || event_id) AS finding_id, event_id, rule_id, severity, risk_points, techniques, entities, seq, us FROM th JOIN rules USING (rule_id))"""
_EXCEPTIONS = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (bool, int)) else f"'{v}'" for v in e) + ")" for e in OWN)
#: CORRELATED reads sf: here its ids and entities name their tenant.
_APART = f"""{_TENANTS}, sf AS (SELECT finding_id || '@' || tenant AS finding_id, rule_id, severity, risk_points, techniques, seq, us,
  list_transform(CASE WHEN len(entities) = 0 THEN ['global:unknown'] ELSE entities END, lambda e: e || chr(31) || tenant) AS entities FROM tf), {CORRELATED}"""
_KEY = "split_part(incident_key, '@', 2) AS tenant, split_part(incident_key, '@', 1) AS incident_key"
_bare = lambda c: f"split_part({c}, chr(31), 1)"
_PROPOSED = f"""tg AS (SELECT incident_key, confidence, unnest(entities) AS target FROM dec WHERE decision = 'containment_proposed'),
pr AS (SELECT {_KEY}, CASE split_part(target, ':', 1) WHEN 'user' THEN 'disable_user' WHEN 'host' THEN 'isolate_host' ELSE 'block_indicator' END AS action, {_bare("target")} AS target, confidence, false AS executable_now, true AS approval_required
  FROM tg WHERE split_part(target, ':', 1) IN ('user', 'host', 'ip') UNION ALL SELECT {_KEY}, 'notify_channel', 'channel:soc-escalations', confidence, true, false FROM dec WHERE decision = 'escalate')"""

QUERIES = [tenant_findings, tenant_exceptions, tenant_incidents, tenant_proposals, tenant_counts]
SQL = {
    "tenant_findings": f"""WITH {_TENANTS}, c AS (SELECT tenant, ([{", ".join(f"'{r['rule_id']}'" for r in RULES)}])[seq % {len(RULES)} + 1] AS rule_id, value > 50 AS enabled, us, seq FROM vt WHERE action LIKE 'login_success%'),
l AS (SELECT tenant, rule_id FROM c GROUP BY ALL HAVING NOT arg_max(enabled, {{'u': us, 's': seq}})) SELECT tenant, finding_id, event_id, rule_id FROM tf ANTI JOIN l USING (tenant, rule_id)""",
    "tenant_exceptions": f"""WITH {_TENANTS}, x0(suppression_id, position, xr, xe, xaction, downgrade_to, expires_us, enabled, xt) AS (VALUES {_EXCEPTIONS}),
m AS (SELECT tenant, finding_id, arg_min(suppression_id, position) AS suppression_id FROM tf, x0 WHERE xt = tenant AND enabled AND (expires_us IS NULL OR expires_us >= 0) AND (xr = '*' OR xr = rule_id) AND (xe IS NULL OR list_contains(entities, xe)) GROUP BY ALL),
j AS (SELECT tf.*, coalesce(entities[1], '') AS e, suppression_id, CASE WHEN xaction = 'suppress' THEN 'suppressed' WHEN xaction = 'downgrade' AND severity > x0.downgrade_to THEN 'downgraded' ELSE 'kept' END AS outcome
  FROM tf LEFT JOIN m USING (tenant, finding_id) LEFT JOIN x0 USING (suppression_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant, rule_id, e ORDER BY us, seq) - count(*) OVER (PARTITION BY tenant, rule_id, e ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY + 1} PRECEDING) AS repeat_count FROM j WHERE suppression_id IS NULL)
SELECT tenant, finding_id, rule_id, suppression_id, outcome, repeat_count FROM n UNION ALL SELECT tenant, finding_id, rule_id, suppression_id, outcome, 0 FROM j WHERE suppression_id IS NOT NULL""",
    "tenant_incidents": f"""WITH RECURSIVE {_APART} SELECT {_KEY}, risk_score, severity, findings, {_bare("primary_entity")} AS primary_entity, CASE WHEN others <= 0 THEN 'Suspicious activity involving ' || {_bare("primary_entity")}
  ELSE 'Correlated activity involving ' || {_bare("primary_entity")} || ' and ' || others || ' related entit' || CASE WHEN others = 1 THEN 'y' ELSE 'ies' END END AS title,
  array_to_string(list_transform(entities, lambda e: {_bare("e")}), ',') AS entities, first_us, last_us FROM inc""",
    "tenant_proposals": f"WITH RECURSIVE {_APART}, {_PROPOSED} SELECT * FROM pr",
    "tenant_counts": f"""WITH RECURSIVE {_APART}, {_PROPOSED}, x1(tenant) AS (VALUES {", ".join(f"('{e[-1]}')" for e in OWN)}) SELECT 'events' AS name, tenant, count(*) AS n FROM vt GROUP BY ALL UNION ALL SELECT 'findings', tenant, count(*) FROM tf GROUP BY ALL
UNION ALL SELECT 'incidents', split_part(incident_key, '@', 2), count(*) FROM inc GROUP BY ALL UNION ALL SELECT 'proposals_pending', tenant, count(*) FROM pr WHERE approval_required GROUP BY ALL UNION ALL SELECT 'suppressions', tenant, count(*) FROM x1 GROUP BY ALL""",
}
