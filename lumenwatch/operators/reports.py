"""Reports over incidents, decisions and stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .incidents import ANOMALY
from .windows import newest_of

#: Techniques in text, and names of severities.
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
SEVERITIES = {0: "informational", 25: "low", 50: "medium", 75: "high", 100: "critical"}


def related_events(members: DataFrame, rows: DataFrame, newest: int = 25) -> DataFrame:
    """Per incident, the newest events of its entities that aren't its own: an event once, with how many entities led to it.

    members: incident_key, event_id and entity; rows: a row for each event and entity.
    """
    last = newest_of(rows, ["entity"], [F.desc("us"), F.desc("seq")], newest)
    pairs = members.select("incident_key", "entity").distinct().join(last.select("entity", "event_id"), "entity")
    pairs = pairs.join(members.select("incident_key", "event_id").distinct(), ["incident_key", "event_id"], "left_anti")
    return pairs.groupBy("incident_key", "event_id").agg(F.count("*").alias("entities"))


#: What every report recommends.
NEXT_STEPS = [
    "Validate whether the user/session/source IP is expected.",
    "Pull surrounding events for the same user, host, and source IP for +/- 24 hours.",
    "Check asset criticality, recent vulnerabilities, and identity privilege level.",
    "Look for lateral movement, credential access, persistence, and exfiltration signals.",
    "If confidence is high, preserve evidence and use approval-gated containment playbooks.",
]


def severity_name(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])[severity]


def report_text(incidents: DataFrame, members: DataFrame, first: int = 10) -> DataFrame:
    """A plain report of each summarized incident: what it is, why it matters, its first findings by time (with rule_name and their event's action, user_name, host and src_ip), and steps."""
    told = lambda c: F.coalesce(F.col(c), F.lit("None"))
    line = F.concat(F.lit("- "), "rule_name", F.lit(": action="), told("action"), F.lit(" user="), told("user_name"), F.lit(" host="), told("host"), F.lit(" src_ip="), told("src_ip"), F.lit(" severity="), severity_name(F.col("severity")))
    ranked = newest_of(members.withColumn("_line", line), ["incident_key"], [F.col("us"), F.col("seq"), F.col("rule_id")], first)
    evidence = ranked.groupBy("incident_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_line"))), lambda x: x["_line"]).alias("_lines"))  # `first` lines at most
    text = [
        F.concat(F.lit("Incident: "), "title"),
        F.concat(F.lit("Severity: "), severity_name(F.col("severity")), F.lit(" | Risk: "), F.col("risk_score").cast("string")),
        F.concat(F.lit("Entities: "), F.array_join("entities", ", ")),
        F.concat(F.lit("MITRE ATT&CK: "), F.when(F.size("kill_chain") > 0, F.array_join("kill_chain", ", ")).otherwise("not mapped")),
        *map(F.lit, ("", "Why it matters:")), F.col("summary"), *map(F.lit, ("", "Key evidence:")), F.array_join("_lines", "\n"),
        *map(F.lit, ("", "Recommended next steps:", *(f"{i}. {step}" for i, step in enumerate(NEXT_STEPS, 1)))),
    ]
    return incidents.join(evidence, "incident_key").select("incident_key", F.concat_ws("\n", *text).alias("report"))


def repeated_pairs(members: DataFrame) -> DataFrame:
    """Per incident, the pairs of a rule and a first entity with several findings, and how many findings they collapse."""
    first = F.coalesce(F.try_element_at("entities", F.lit(1)), F.lit("global:unknown")).alias("entity")
    pairs = members.groupBy("incident_key", "rule_id", first).agg(F.count("*").alias("n")).where("n > 1")
    return pairs.groupBy("incident_key").agg(F.count("*").alias("pairs"), (F.sum("n") - F.count("*")).alias("collapsed"))


def case_notes(incidents: DataFrame, members: DataFrame, listed: int = 5, signals: DataFrame | None = None, repeats: DataFrame | None = None) -> DataFrame:
    """A triage note for each incident: risk, techniques, the first rules by name, entities and, if given, its behaviour signals (signal_names) and repeated_pairs()."""
    rules = members.where(~F.col("rule_id").startswith(ANOMALY)).groupBy("incident_key").agg(F.slice(F.array_sort(F.collect_set("rule_name")), 1, listed).alias("rules"))
    rows = incidents.join(rules, "incident_key", "left")
    n = F.size("entities")
    told, context = [], []
    if signals is not None:
        rows = rows.join(signals.select("incident_key", "signal_names"), "incident_key", "left")
        told = [F.when(F.size("signal_names") > 0, F.concat(F.lit("Behavioral signals: "), F.array_join("signal_names", ", "), F.lit(".")))]
    if repeats is not None:
        rows = rows.join(repeats, "incident_key", "left")
        context = [F.concat(F.lit("Context: "), F.col("pairs").cast("string"), F.lit(" repeated rule/entity pair(s) collapsing "), F.col("collapsed").cast("string"), F.lit(" finding(s)."))]
    lines = [
        F.concat(F.lit("AI triage note for "), "title"),
        F.lit(""),
        F.concat(F.lit("Risk "), F.col("risk_score").cast("string"), F.lit(" / severity "), severity_name(F.col("severity")), F.lit(" from "), F.col("findings").cast("string"), F.lit(" finding(s) across "), n.cast("string"), F.lit(" entit"), F.when(n == 1, "y").otherwise("ies"), F.lit(".")),
        F.when(F.size("kill_chain") > 0, F.concat(F.lit("ATT&CK progression: "), F.array_join("kill_chain", " -> "), F.lit("."))),
        F.when(F.size("rules") > 0, F.concat(F.lit("Detections: "), F.array_join("rules", "; "), F.lit("."))),
        *told,
        *context,
        F.concat(F.lit("Entities: "), F.array_join("entities", ", "), F.lit(".")),
    ]
    return rows.select("incident_key", F.concat_ws("\n", *lines).alias("note"))


def current_state(changes: DataFrame, key: str, *fields: str) -> DataFrame:
    """The latest value of each field of a change log (order column at); a null leaves the field as it was."""
    return changes.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields])


def decision_stats(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("fallback").alias("fallbacks"), F.count_if("escalated").alias("escalations"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))


#: Certainties from which an answer is accepted, and reviewed.
ACCEPT, REVIEW = 0.75, 0.5


def disposition(malicious: Column, severity: Column) -> Column:
    """accepted, review or ignored, by the weaker of two answers' certainties (null: not answered); unavailable without either."""
    weaker = F.least(malicious, severity)
    return F.when(weaker >= ACCEPT, "accepted").when(weaker >= REVIEW, "review").when(weaker.isNotNull(), "ignored").otherwise("unavailable")


def technique_codes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TECHNIQUE), F.lit(0)))


def features(members: DataFrame, listed: int = 20) -> DataFrame:
    """Per incident: kinds of entities, distinct rules (the first `listed` by name), top risk and time span."""
    rows = members.withColumn("entity", F.explode_outer("entities")).withColumn("kind", F.substring_index("entity", ":", 1))
    return rows.groupBy("incident_key").agg(
        F.countDistinct(F.when(F.col("kind") == "user", F.col("entity"))).alias("users"),
        F.countDistinct(F.when(F.col("kind") == "host", F.col("entity"))).alias("hosts"),
        F.countDistinct(F.when(F.col("kind") == "ip", F.col("entity"))).alias("addresses"),
        F.countDistinct("rule_id").alias("rules"),
        F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, listed), ",").alias("rule_list"),
        F.max("risk_points").alias("top_risk"),
        (F.max("us") - F.min("us")).alias("span_us"),
    )


def runbook_steps(incidents: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Steps (runbook, technique, action, kind) for incidents whose techniques, or their parents, match: a target of the kind each, or why there is none."""
    used = incidents.select("incident_key", "entities", F.explode("kill_chain").alias("t"))
    used = used.select("incident_key", "entities", F.explode(F.array_distinct(F.array(F.col("t"), F.substring_index("t", ".", 1)))).alias("technique"))
    rows = used.join(F.broadcast(runbooks), "technique").withColumn("targets", F.filter("entities", lambda e: F.substring_index(e, ":", 1) == F.col("kind")))
    rows = rows.select("incident_key", "action", F.explode_outer("targets").alias("target"), F.when(F.size("targets") == 0, F.concat(F.lit("no "), "kind", F.lit(" in scope"))).alias("dropped"))
    return rows.distinct()


def step_confidence(severity: Column, findings: Column) -> Column:
    """How well a runbook fits: half, a quarter by severity, and 0.05 for each of up to three findings; 0.90 at most, to two places."""
    return F.least(F.rint(F.lit(50) + severity / 4 + F.least(findings, F.lit(3)) * 5), F.lit(90.0)) / 100


def runbook_additions(steps: DataFrame, incidents: DataFrame, proposed: DataFrame) -> DataFrame:
    """Steps of runbook_steps() that have a target and aren't proposed for the incident yet, with their confidence. A sub-technique as target is its parent."""
    same = F.when(F.col("target").rlike(r"^T\d{4}\.\d{3}$"), F.substring_index("target", ".", 1)).otherwise(F.col("target"))
    wanted = steps.where("target IS NOT NULL").select("incident_key", "action", same.alias("target")).distinct()
    fresh = wanted.join(proposed.select("incident_key", "action", same.alias("target")), ["incident_key", "action", "target"], "left_anti")
    return fresh.join(incidents.select("incident_key", step_confidence(F.col("severity"), F.col("findings")).alias("confidence")), "incident_key")


def exposition(rows: DataFrame, name: str, value: str, limits: list[float], *labels: str) -> DataFrame:
    """metric, labels and value of a histogram by label set: cumulative buckets with their upper limits (+Inf last), sum and count."""
    counts = [F.count_if(F.col(value) <= x) for x in limits] + [F.count(value)]
    per = rows.groupBy(*labels).agg(F.array(*[c.cast("double") for c in counts]).alias("_buckets"), F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("_sum"))
    told = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    names = [f"{x:g}" for x in limits] + ["+Inf"]
    row = lambda metric, text, number: F.struct(F.lit(f"{name}_{metric}").alias("metric"), text.alias("labels"), number.alias("value"))
    buckets = [row("bucket", F.concat_ws(",", F.nullif(told, F.lit("")), F.lit(f'le="{n}"')), F.col("_buckets")[i]) for i, n in enumerate(names)]
    return per.select(F.explode(F.array(*buckets, row("sum", told, F.round("_sum", 6)), row("count", told, F.col("_buckets")[len(limits)]))).alias("m")).select("m.*")
