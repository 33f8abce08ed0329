"""Running sums and newest rows by key that no single key can overload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the arrival order in one bucket.
BUCKET = 1 << 16


def sum_before(rows: DataFrame, keys: list[str], value: str, name: str, order: str = "seq", bucket: int = BUCKET, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with `name`: the sum of `value` over rows of the same keys that come before in `order` and `ties` (0 for the first).

    Two levels: totals for each key and bucket of the order run in a small window; within a bucket, which gets one row more with
    the sum up to it, a window of at most `bucket` orders adds the rest. A key with any share of the rows is dealt over many tasks, and rows move once.
    """
    rows = rows.withColumn("_sum_bucket", F.floor(F.col(order) / bucket))  # names of its own: rows keep all their columns
    totals = rows.groupBy(*keys, "_sum_bucket").agg(F.sum(value).alias("_sum_n"))
    before = F.sum("_sum_n").over(Window.partitionBy(*keys).orderBy("_sum_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.withColumn("_sum_n", before).where("_sum_n <> 0").withColumn("_sum_row", F.lit(False))
    dealt = rows.withColumn("_sum_n", F.col(value)).withColumn("_sum_row", F.lit(True)).unionByName(carried, allowMissingColumns=True)
    earlier = Window.partitionBy(*keys, "_sum_bucket").orderBy("_sum_row", order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn(name, F.coalesce(F.sum("_sum_n").over(earlier), F.lit(0))).where("_sum_row").drop("_sum_bucket", "_sum_n", "_sum_row")


def sums_before(rows: DataFrame, sums: list[tuple[str, list[str], DataFrame | None, DataFrame | None]], order: str = "seq", bucket: int = BUCKET >> 2) -> DataFrame:
    """rows with several such sums, each a (name, keys, added, saved): of n over the rows of `added` (keys, order, n) that come strictly before.

    Without added, the rows themselves are counted. saved (keys, n) comes before all. Every bucket of the order gets, besides its rows
    and what is added in it, one row a key with the sum up to it, and is dealt once for all sums: a task holds whole buckets, whatever their keys.
    """
    at = F.floor(F.col(order) / bucket)
    base = rows.withColumns({"_bucket": at, "_turn": F.lit(0)})
    parts = [base.withColumns({f"_{name}": F.lit(1).cast("long") for name, _, added, _ in sums if added is None})]
    for name, keys, added, saved in sums:
        n = f"_{name}"
        totals = base.groupBy(*keys, "_bucket").agg(F.count("*" if added is None else F.lit(None)).alias(n))
        if added is not None:
            steps = added.select(*keys, order, F.col("n").cast("long").alias(n)).withColumns({"_bucket": at, "_turn": F.lit(1)})
            totals = totals.unionByName(steps.groupBy(*keys, "_bucket").agg(F.sum(n).alias(n)))
            parts.append(steps)
        if saved is not None:
            totals = totals.unionByName(saved.select(*keys, F.lit(None).cast("long").alias("_bucket"), F.col("n").cast("long").alias(n)))
        totals = totals.groupBy(*keys, "_bucket").agg(F.sum(n).alias(n))
        before = F.sum(n).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
        parts.append(totals.withColumn(n, before).where((F.col(n) > 0) & F.col("_bucket").isNotNull()).withColumn("_turn", F.lit(-1)))
    dealt = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), parts).repartition("_bucket")
    for name, keys, _, _ in sums:
        earlier = Window.partitionBy("_bucket", *keys).orderBy(F.asc_nulls_first(order), "_turn").rowsBetween(Window.unboundedPreceding, -1)
        dealt = dealt.withColumn(name, F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)))
    return dealt.where("_turn = 0").select(*rows.columns, *[name for name, _, _, _ in sums])


def newest_of(rows: DataFrame, keys: list[str], order: list[Column], newest: int, salts: int = 32) -> DataFrame:
    """The first `newest` rows of each key in the given order, with place (from 1): a busy key is first cut in salted parts."""
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    few = salted.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("place") <= newest)
    return few.drop("_salt").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= newest)
