"""Exceptions, repeat suppression and analyst feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Repeats allowed in the window, and the window.
REPEATS, WINDOW_US = 5, 15 * 60 * 1_000_000
#: Windows in a slot of time within which repeats are counted.
SLOT = 4


def current(changes: DataFrame, *key: str) -> DataFrame:
    """The latest row of each key in a change table (updated_at, deleted)."""
    rest = [c for c in changes.columns if c not in key]
    latest = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "updated_at").alias("row"))
    return latest.select(*key, "row.*").where(~F.coalesce("deleted", F.lit(False))).drop("deleted")


#: Exceptions that are tried on each finding where it lies; more of them meet findings by key.
FEW = 100


def matched(findings: DataFrame, exceptions: DataFrame, now_us: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """findings with the first matching exception in list order: suppression_id, exception_action, downgrade_to.

    An exception fits if it is enabled, not expired, of the rule or '*', and of one of the finding's
    entities or of none. More than FEW candidates meet on (rule, entity) keys, so the join is an equi-join. With `by`, a tenant for
    example, exceptions are of equal values only, and finding_id needs be unique only among these; null fits nothing.
    """
    live = exceptions.where(F.col("enabled") & (F.col("expires_us").isNull() | (F.col("expires_us") >= now_us)))
    if not by and live.limit(FEW + 1).count() <= FEW:
        given = live.select("position", "suppression_id", F.col("action").alias("exception_action"), "downgrade_to", F.col("rule_id").alias("rule"), "entity")
        listed = given.agg(F.collect_list(F.struct(*given.columns)).alias("_few"))  # one row
        fits = lambda x: ((x["rule"] == "*") | (x["rule"] == F.col("rule_id"))) & F.col("entities").isNotNull() & (x["entity"].isNull() | (x["entity"] == "*") | F.array_contains("entities", x["entity"]))
        first = F.array_min(F.transform(F.filter("_few", fits), lambda x: F.struct(*[x[c].alias(c) for c in given.columns[:4]])))
        return findings.crossJoin(F.broadcast(listed)).withColumn("_m", first).select(*findings.columns, *[F.col(f"_m.{c}").alias(c) for c in given.columns[1:4]])
    keyed = live.select(*by, F.col("rule_id").alias("_rule"), F.coalesce("entity", F.lit("*")).alias("_entity"), "position", "suppression_id", F.col("action").alias("exception_action"), "downgrade_to")
    rows = findings.select("finding_id", *by, F.explode(F.array(F.col("rule_id"), F.lit("*"))).alias("_rule"), F.concat("entities", F.array(F.lit("*"))).alias("_all"))
    rows = rows.select("finding_id", *by, "_rule", F.explode("_all").alias("_entity"))
    first = rows.join(keyed, ["_rule", "_entity", *by]).groupBy("finding_id", *by).agg(F.min(F.struct("position", "suppression_id", "exception_action", "downgrade_to")).alias("m"))
    return findings.join(first.select("finding_id", *by, "m.suppression_id", "m.exception_action", "m.downgrade_to"), ["finding_id", *by], "left")


def apply_exceptions(rows: DataFrame) -> DataFrame:
    """What exceptions do: outcome suppressed, downgraded or kept, and the severity after it."""
    down = (F.col("exception_action") == "downgrade") & (F.col("severity") > F.col("downgrade_to"))
    outcome = F.when(F.col("exception_action") == "suppress", "suppressed").when(down, "downgraded").otherwise("kept")
    return rows.withColumn("outcome", outcome).withColumn("severity", F.when(down, F.col("downgrade_to")).otherwise(F.col("severity")))


def repeats(findings: DataFrame, window_us: int = WINDOW_US, allowed: int = REPEATS, rule: str = "rule_id", entity: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """findings with repeat_count: those of the rule and first entity in the window up to it (both ends in), itself included; and repeated.

    Rows are dealt by (rule, entity, slot of SLOT windows), and the times of a slot's last window are sent to the next slot
    too, so a busy pair is spread over time instead of meeting in one task.
    """
    rest = [c for c in findings.columns if c not in (*by, rule, "us", "seq")]
    size = SLOT * window_us
    own = F.floor(F.col("us") / size)
    first = entity if entity is not None else F.coalesce(F.try_element_at("entities", F.lit(1)), F.lit(""))
    rows = findings.select(*by, rule, "us", "seq", first.alias("_entity"), own.alias("_own"), F.struct(*rest).alias("_row"))
    late = F.col("us") >= (F.col("_own") + 1) * size - window_us
    sent = F.struct(F.col("_own").alias("slot"), F.col("_row").alias("row"))
    sent = F.when(late, F.array(sent, F.struct((F.col("_own") + 1).alias("slot"), F.when(F.lit(False), F.col("_row")).alias("row")))).otherwise(F.array(sent))  # a copy is a time, no more
    spread = rows.select(*by, rule, "us", "seq", "_entity", F.explode(sent).alias("_s")).select(*by, rule, "us", "seq", "_entity", F.col("_s.slot").alias("_slot"), F.col("_s.row").alias("_row"))
    keys = [*by, rule, "_entity", "_slot"]
    before = F.count("*").over(Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, -(window_us + 1)))
    counted = spread.withColumn("repeat_count", F.row_number().over(Window.partitionBy(*keys).orderBy("us", "seq")) - before).where("_row IS NOT NULL")
    out = counted.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in findings.columns], F.col("repeat_count").cast("long").alias("repeat_count"))
    return out.withColumn("repeated", F.col("repeat_count") > allowed)


def settled(findings: DataFrame, exceptions: DataFrame, now_us: Column, window_us: int = WINDOW_US, allowed: int = REPEATS) -> DataFrame:
    """findings with outcome (kept, downgraded, suppressed or repeated) and the severity after it: the first matching exception decides; findings that none matches are counted as repeats."""
    judged = apply_exceptions(matched(findings, exceptions, now_us))
    counted = repeats(judged.where("suppression_id IS NULL"), window_us, allowed).withColumn("outcome", F.when(F.col("repeated"), "repeated").otherwise("kept")).drop("repeat_count", "repeated")
    return counted.unionByName(judged.where("suppression_id IS NOT NULL")).drop("exception_action", "downgrade_to")


def trust(feedback: DataFrame) -> DataFrame:
    """Rule weights: 1 + 0.1 for each approval - 0.2 for each rejection, between 0.1 and 3."""
    raw = F.lit(10) + F.count_if(F.col("decision") == "approve") - F.lit(2) * F.count_if(F.col("decision") == "reject")
    return feedback.groupBy("rule_id").agg((F.greatest(F.least(raw, F.lit(30)), F.lit(1)) / 10).cast("double").alias("weight"))


def reweight(findings: DataFrame, weights: DataFrame) -> DataFrame:
    """Risk scaled by weights below 1, rounded half to even."""
    joined = findings.join(weights, "rule_id", "left")
    return joined.withColumn("risk_points", F.when(F.col("weight") < 1, F.rint(F.col("risk_points") * F.col("weight")).cast("int")).otherwise(F.col("risk_points")))


def rejected_pairs(feedback: DataFrame) -> DataFrame:
    return feedback.where("decision = 'reject'").select("rule_id", "entity").distinct().join(trust(feedback), "rule_id")
