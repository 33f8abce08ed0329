"""Rule detection: one scan of the events for all rules, rule state, applicability and coverage."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import Documents, compile_selection, fields_of

#: Rules in one array expression, so that a large rule set stays within generated code's limits.
GROUP = 50
RULE_SCHEMA = "rule_id string, name string, severity int, risk_points int, techniques array<string>, selection string, enabled boolean"


def rule_table(spark: SparkSession, rules: list[dict[str, Any]]) -> DataFrame:
    """Rules with defaults: risk is the severity's value, enabled is true."""
    rows = [(r["rule_id"], r.get("name", r["rule_id"]), r.get("severity", 0), r.get("risk_points", r.get("severity", 0)), r.get("techniques", []), json.dumps(r["selection"]), r.get("enabled", True)) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def merge_rules(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Both rule sets; the primary's rule wins where ids collide."""
    return primary.unionByName(extra.join(primary, "rule_id", "left_anti"))


def overlay_state(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with the latest saved enabled flag (rule_id, enabled, updated_at, event order in seq)."""
    latest = changes.groupBy("rule_id").agg(F.max_by("enabled", F.struct("updated_at", "seq")).alias("saved"))
    return rules.join(latest, "rule_id", "left").withColumn("enabled", F.coalesce("saved", "enabled")).drop("saved")


def resolver(events: DataFrame) -> Callable[[str], Column]:
    """How rules name fields of events: also by paths into their raw document, if they carry one."""
    return Documents(events.columns) if "raw" in events.columns else F.col


def fired(events: DataFrame, rules: list[dict[str, Any]]) -> Column:
    """The ids of the rules that fire on an event."""
    resolve = resolver(events)
    active = [r for r in rules if r.get("enabled", True)]
    groups = [active[i : i + GROUP] for i in range(0, len(active), GROUP)]
    found = [F.array(*[F.when(compile_selection(r["selection"], resolve), F.lit(r["rule_id"])) for r in g]) for g in groups]
    return F.array_compact(F.concat(*found)) if found else F.array().cast("array<string>")


def hits(events: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """events with rule_id, a row for each rule that fires."""
    return events.withColumn("rule_id", F.explode(fired(events, rules)))


def finding_id(*parts: str) -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256)


def evaluate(events: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Findings: finding_id, event_id, rule_id, severity, risk_points, techniques, entities, seq, us."""
    content = rule_table(events.sparkSession, rules).select("rule_id", "severity", "risk_points", "techniques")  # the rules given
    rows = hits(events, rules).select("event_id", "rule_id", "entities", "seq", "us").join(F.broadcast(content), "rule_id")
    return rows.select(finding_id("rule_id", "event_id").alias("finding_id"), "event_id", "rule_id", "severity", "risk_points", "techniques", "entities", "seq", "us")


def backtest(events: DataFrame, rules: list[dict[str, Any]], truth: Column) -> DataFrame:
    """Per rule: hits, true and false positives against a label of the events."""
    rows = hits(events.withColumn("_truth", truth), rules)
    return rows.groupBy("rule_id").agg(F.count("*").alias("hits"), F.count_if(F.col("_truth")).alias("tp"), F.count_if(~F.col("_truth")).alias("fp"))


def case_counts(events: DataFrame, rules: list[dict[str, Any]], meant: str, fires: str) -> DataFrame:
    """Per rule: true and false positives and negatives on events that are written for one rule (column meant), to fire it or not (column fires).

    A rule that no event is written for has no row; hits of a rule on events meant for another aren't judged.
    """
    key = F.struct(meant, F.coalesce(F.col(fires), F.lit(False)).alias("fires"))
    resolve = resolver(events)
    chosen = F.lit(False)
    for r in rules:
        chosen = F.when(F.col(meant) == r["rule_id"], compile_selection(r["selection"], resolve)).otherwise(chosen)
    judged = events.where(F.col(meant).isin([r["rule_id"] for r in rules])).select(key.alias("k"), chosen.alias("hit"))
    want, hit = F.col("k.fires"), F.col("hit")
    counts = {"tp": want & hit, "fp": ~want & hit, "fn": want & ~hit, "tn": ~want & ~hit}
    return judged.groupBy(F.col(f"k.{meant}").alias("rule_id")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def rule_fields(spark: SparkSession, rules: list[dict[str, Any]]) -> DataFrame:
    """A row for each rule and field that it reads."""
    return spark.createDataFrame([(r["rule_id"], f) for r in rules for f in sorted(fields_of(r["selection"]))], "rule_id string, field string")


def missing_fields(events: DataFrame, rules: list[dict[str, Any]], top: int = 15) -> DataFrame:
    """The fields that keep most rules from firing: absent from the events or empty in all of them, paths into raw documents included.

    field, rules (how many read it), place; ties by name, the first `top` of them.
    """
    wanted = rule_fields(events.sparkSession, rules)
    names = sorted({f for r in rules for f in fields_of(r["selection"])})
    resolve = resolver(events)
    have = [n for n in names if n in events.columns or ("raw" in events.columns and n.startswith("raw."))]
    if have:
        filled = events.agg(*[F.count(resolve(n)).alias(f"n{i}") for i, n in enumerate(have)])
        seen = filled.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"n{i}").alias("n")) for i, n in enumerate(have)])).alias("f"))
        wanted = wanted.join(F.broadcast(seen.where("f.n > 0").select("f.field")), "field", "left_anti")
    counts = wanted.groupBy("field").agg(F.count("*").alias("rules")).orderBy(F.desc("rules"), "field").limit(top)
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rules"), "field")))


def applicability(events: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Each rule with the fields it reads that are missing from the events or empty in all of them."""
    spark = events.sparkSession
    wanted = rule_fields(spark, rules)
    have = [c for c in events.columns if not c.startswith("_")]
    filled = events.agg(*[F.count(F.col(c)).alias(c) for c in have])
    filled = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in have])).alias("f")).select("f.field", "f.n")
    rows = wanted.join(filled, "field", "left").withColumn("missing", F.coalesce("n", F.lit(0)) == 0)
    return rows.groupBy("rule_id").agg(F.count("*").alias("fields"), F.count_if("missing").alias("missing_fields"), F.when(F.max("missing"), "not_applicable").otherwise("imported").alias("status"))


def parent_of(technique: Column) -> Column:
    return F.substring_index(technique, ".", 1)


def tactics_of(rows: DataFrame, matrix: DataFrame, technique: str = "technique") -> DataFrame:
    """rows with tactics of the technique, or else of its parent."""
    own = matrix.select(F.col("technique").alias("_own"), F.col("tactics").alias("_t"))
    parent = matrix.select(F.col("technique").alias("_parent"), F.col("tactics").alias("_pt"))
    joined = rows.join(F.broadcast(own), F.col(technique) == F.col("_own"), "left").join(F.broadcast(parent), parent_of(F.col(technique)) == F.col("_parent"), "left")
    return joined.withColumn("tactics", F.coalesce("_t", "_pt")).drop("_own", "_t", "_parent", "_pt")


def coverage(found: DataFrame, matrix: DataFrame) -> DataFrame:
    """Per tactic: techniques of the matrix, those that findings used (or a sub-technique of theirs), and the findings."""
    used = found.select("finding_id", F.explode("techniques").alias("technique"))
    seen = used.select("technique").distinct()
    seen = seen.union(seen.select(parent_of(F.col("technique")))).distinct().withColumn("seen", F.lit(True))
    per = matrix.join(seen, "technique", "left").select("technique", F.explode("tactics").alias("tactic"), F.coalesce("seen", F.lit(False)).alias("seen"))
    per = per.groupBy("tactic").agg(F.count("*").alias("techniques"), F.count_if("seen").alias("covered"))
    counts = tactics_of(used, matrix).select(F.explode("tactics").alias("tactic"), "finding_id").groupBy("tactic").agg(F.count("*").alias("findings"))
    return per.join(counts, "tactic", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, 1))


def reach(found: DataFrame, matrix: DataFrame, watchlist: list[str]) -> DataFrame:
    """One row: how much of the matrix the techniques of findings reach, at the level of techniques and of parents.

    A parent counts as reached by itself or any sub-technique that the matrix holds. unknown_ids are techniques of
    findings that the matrix lacks, gaps those of the watchlist without a finding; both are sorted lists. Techniques
    are trimmed and upper-cased; rows without any give none.
    """
    used = found.select(F.explode("techniques").alias("t")).select(F.upper(F.trim("t")).alias("technique")).where("technique <> ''").distinct()
    known = matrix.select("technique").distinct().withColumn("listed", F.lit(True))
    both = used.withColumn("used", F.lit(True)).join(known, "technique", "full")
    none = F.lit(False)
    both = both.select("technique", F.coalesce("used", none).alias("used"), F.coalesce("listed", none).alias("listed"))
    parent = parent_of(F.col("technique"))
    watched = F.array(*[F.lit(w) for w in watchlist]).cast("array<string>")
    counts = both.agg(
        F.count_if("listed").alias("technique_total"),
        F.count_if(F.col("listed") & F.col("used")).alias("technique_covered"),
        F.array_sort(F.collect_list(F.when(F.col("used") & ~F.col("listed"), F.col("technique")))).alias("unknown_ids"),
        F.collect_list(F.when(F.col("used") & F.col("technique").isin(watchlist), F.col("technique"))).alias("_met"),
        F.collect_set(F.when(F.col("listed") & (F.col("technique") == parent), parent)).alias("_parents"),
        F.collect_set(F.when(F.col("listed") & F.col("used"), parent)).alias("_reached"),
    )
    counts = counts.withColumns({"gaps": F.array_sort(F.array_except(watched, "_met")), "parent_total": F.size("_parents").cast("long"), "parent_covered": F.size(F.array_intersect("_parents", "_reached")).cast("long")}).drop("_met", "_parents", "_reached")
    return counts.withColumns({"technique_percent": _percent(F.col("technique_covered"), F.col("technique_total")), "parent_percent": _percent(F.col("parent_covered"), F.col("parent_total"))})
