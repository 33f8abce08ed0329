"""Recommendations for incidents: confidence, decision, proposed actions and their policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The action for each kind of entity; targets that give context; and (action, risk, needs approval, kinds of target).
ACTIONS = [("user", "disable_user"), ("host", "isolate_host"), ("ip", "block_indicator")]
CONTEXT = ["technique", "incident", "user", "host", "indicator", "cloud_account"]
POLICIES = [
    ("search_related_events", "read", False, CONTEXT),
    ("enrich_entities", "read", False, CONTEXT),
    ("create_case_note", "low", False, CONTEXT),
    ("link_duplicate_alerts", "low", False, CONTEXT),
    ("notify_channel", "reversible", False, ["channel", "technique", "incident"]),
    ("disable_user", "high", True, ["user"]),
    ("isolate_host", "high", True, ["host"]),
    ("block_indicator", "high", True, ["indicator"]),
    ("close_incident", "critical", True, ["incident"]),
]
#: Levels of autonomy, and the confidence that lets the highest act alone on high risk.
OBSERVE, LOW_RISK, REVERSIBLE, APPROVAL_GATED, POLICY_BOUNDED = range(5)
BOUNDED_CONFIDENCE = 0.98
#: Target prefixes and what they name; a technique id is one of its own.
PREFIXES = {"user": "user", "host": "host", "ip": "indicator", "domain": "indicator", "url": "indicator", "hash": "indicator", "md5": "indicator", "sha1": "indicator", "sha256": "indicator", "file_hash": "indicator", "cloud_account": "cloud_account", "channel": "channel", "incident": "incident"}
SHARED = "vpn"
CHANNEL = "channel:soc-escalations"


def confidence(incidents: DataFrame) -> DataFrame:
    """Confidence in hundredths summed, then divided: bands of risk, severity, techniques, findings, and whether there are anomalies."""
    points = (
        F.lit(20)
        + F.when(F.col("risk_score") >= 200, 25).when(F.col("risk_score") >= 100, 15).otherwise(0)
        + F.when(F.col("severity") >= 75, 20).otherwise(0)
        + F.when(F.size("kill_chain") > 0, 15).otherwise(0)
        + F.when(F.col("findings") >= 3, 10).otherwise(0)
        + F.when(F.col("anomalies") > 0 if "anomalies" in incidents.columns else F.lit(False), 10).otherwise(0)
    )
    return incidents.withColumn("confidence", F.least(points, F.lit(99)) / 100)


def decide(incidents: DataFrame) -> DataFrame:
    high = (F.col("severity") >= 75) & (F.col("risk_score") >= 200)
    middle = (F.col("risk_score") >= 100) | (F.col("severity") >= 50)
    kind = F.when(high, "containment_proposed").when(middle, "escalate").when(F.col("risk_score") >= 30, "suspicious_monitor").otherwise("likely_benign")
    owner = F.when(high, "tier-2-incident-responder").when(middle, "tier-2-analyst").otherwise("tier-1-queue")
    return incidents.withColumn("decision", kind).withColumn("owner", owner)


def target_kind(target: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])
    named = target.contains(":") & (F.trim(F.regexp_replace(target, "^[^:]*:", "")) != "")
    return F.when(F.trim(target).rlike(r"^T\d{4}(\.\d{3})?$"), "technique").when(named, kinds[F.lower(F.trim(F.substring_index(target, ":", 1)))])


def gate(autonomy: int, risk: Column, confidence: Column, by_model: Column | None = None) -> Column:
    """What policy says of an action: executable_now, approval_required and reason. risk null is an unknown action; by_model: whether a model gave the confidence, which never lets high risk act alone."""
    by_model = F.lit(False) if by_model is None else F.coalesce(by_model, F.lit(False))
    say = lambda run, ask, why: F.struct(F.lit(run).alias("executable_now"), F.lit(ask).alias("approval_required"), F.lit(why).alias("reason"))
    high = say(False, True, "proposal only" if autonomy < APPROVAL_GATED else "human approval")
    if autonomy >= POLICY_BOUNDED:
        sure = confidence >= BOUNDED_CONFIDENCE
        high = F.when(sure & by_model, say(False, True, "a model's confidence authorizes nothing")).when(sure, say(True, False, "policy-bounded")).otherwise(high)
    step = lambda name, level: F.when(risk == name, say(autonomy >= level, False, "allowed" if autonomy >= level else "disabled"))
    return F.coalesce(step("read", OBSERVE), step("low", LOW_RISK), step("reversible", REVERSIBLE), F.when(risk == "high", high), F.when(risk == "critical", say(False, True, "always human approval")), say(False, True, "unknown action"))


def allowed(rows: DataFrame, autonomy: int = REVERSIBLE, by_model: Column | None = None) -> DataFrame:
    """Rows (action, target, confidence) whose target is of a kind that the action takes, with executable_now, approval_required and reason; shared infrastructure is never isolated."""
    policies = F.broadcast(rows.sparkSession.createDataFrame(POLICIES, "action string, _risk string, _asks boolean, _kinds array<string>"))  # the table above
    shared = (F.col("action") == "isolate_host") & F.lower("target").contains(SHARED)
    known = rows.join(policies, "action").where(F.array_contains("_kinds", target_kind(F.col("target"))) & ~shared)
    return known.withColumn("_gate", gate(autonomy, F.col("_risk"), F.col("confidence"), by_model)).select(*rows.columns, "_gate.*")


def proposals(decided: DataFrame, autonomy: int = REVERSIBLE) -> DataFrame:
    """Actions for decided incidents: action, target, whether it may run now and whether it needs approval."""
    acts = F.broadcast(decided.sparkSession.createDataFrame(ACTIONS, "kind string, action string"))
    contain = decided.where("decision = 'containment_proposed'").select("incident_key", "confidence", F.explode("entities").alias("target"))
    contain = contain.withColumn("kind", F.substring_index("target", ":", 1)).join(acts, "kind").select("incident_key", "confidence", "action", "target")
    notify = decided.where("decision = 'escalate'").select("incident_key", "confidence", F.lit("notify_channel").alias("action"), F.lit(CHANNEL).alias("target"))
    return allowed(contain.unionByName(notify), autonomy).select("incident_key", "action", "target", "confidence", "executable_now", "approval_required")


def without_live(proposed: DataFrame, log: DataFrame) -> DataFrame:
    """Proposals that aren't pending or approved already (rejected ones may come back)."""
    live = log.where(F.col("status").isin("pending", "approved")).select("incident_key", "action", "target")
    return proposed.join(live, ["incident_key", "action", "target"], "left_anti")


def duplicate_clusters(findings: DataFrame) -> DataFrame:
    """(rule, first entity) with more than one finding: count, first and last time."""
    first = F.coalesce(F.try_element_at("entities", F.lit(1)), F.lit("global:unknown")).alias("entity")
    return findings.groupBy("rule_id", first).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).where("n > 1")
