"""Decision quality: accuracy, confusion, Brier score, calibration, latency and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dollars for a million input and output tokens.
PRICES = (0.042, 0.0)


def accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    same = (F.lower(F.col("expected").cast("string")) == F.lower(F.col("predicted").cast("string"))).cast("double")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(same).alias("accuracy"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate"))


def usage(rows: DataFrame, *keys: str, prices: tuple[float, float] = PRICES) -> DataFrame:
    """Cases, rates of errors and fallbacks, token sums, and their cost in dollars (null where no tokens are reported)."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    tokens = [F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("input_tokens", "output_tokens")]
    out = rows.groupBy(*keys).agg(F.count("*").alias("cases"), rate(F.col("error")).alias("error_rate"), rate(F.col("fallback")).alias("fallback_rate"), tokens[0].alias("input_tokens"), tokens[1].alias("output_tokens"))
    cost = F.col("input_tokens") / 1e6 * prices[0] + F.col("output_tokens") / 1e6 * prices[1]
    return out.withColumn("cost_usd", F.when(F.col("input_tokens") + F.col("output_tokens") > 0, cost))


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, F.col("expected").cast("string").alias("expected"), F.col("predicted").cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def brier(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col("probability") - F.col("expected").cast("double"), 2)).alias("brier"))


def calibration(rows: DataFrame, bins: int, *keys: str) -> DataFrame:
    """Expected calibration error over equal bins of confidence, weighted by their rows."""
    right = (F.col("expected") == F.col("predicted")).cast("double")
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)))
    per = rows.withColumn("bin", place).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(right).alias("a"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, and the values at ranks rint(f * (n - 1)) for the half and the 95th hundredth.

    Ranks come from counts of equal values, so a key with any number of rows is summed before it is ordered.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("m"))
    ordered = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("m").over(ordered)).withColumn("n", F.sum("m").over(Window.partitionBy(*keys)))
    at = lambda f: F.min(F.when(F.col("upto") > F.rint(F.lit(f) * (F.col("n") - 1)), F.col(value)))
    return ranked.groupBy(*keys).agg((F.sum(F.col(value) * F.col("m")) / F.sum("m")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


#: The action for each severity from the highest down.
BASELINE_ACTIONS = {100: "escalate", 75: "investigate", 50: "investigate", 25: "monitor", 0: "suppress"}


def baseline_decision(incidents: DataFrame, signals: Column | None = None) -> DataFrame:
    """The deterministic path's four answers: malicious with its probability, severity and action with a confidence, and whether a narrative is needed. signals: the number of behaviour signals (none if left out)."""
    risk, severity = F.col("risk_score"), F.col("severity")
    share = F.greatest(F.lit(0.02), F.least(F.lit(0.98), risk / 500.0))
    probability = F.when(severity >= 75, F.greatest(share, F.lit(0.9))).when(risk >= 100, F.greatest(share, F.lit(0.6))).otherwise(share)
    action = F.lit("suppress")
    for level, name in sorted(BASELINE_ACTIONS.items()):
        action = F.when(severity >= level, name).otherwise(action)
    narrative = F.when((severity >= 50) & (severity < 100) & ((F.lit(0) if signals is None else signals) > 1), 0.7).otherwise(0.2)
    return incidents.select("incident_key", probability.alias("probability"), (probability >= 0.5).alias("malicious"), "severity", action.alias("action"), share.alias("confidence"), narrative.alias("narrative"), (narrative >= 0.5).alias("needs_narrative"))
