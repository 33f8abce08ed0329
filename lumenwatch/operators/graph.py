"""Saved tables in the shared folder, and connected components over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where it is unset and all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this part of the rows is hot.
SHARE = 1000


def looked_up(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of unique, which has a row a key (none: null). Keys of more than 1 / SHARE of the rows (fewer than SHARE) are broadcast, so no task gathers them."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all")))).where(F.col("_n") * SHARE > F.col("_all")).select(key)  # one row
    hot = save(hot, "hot")
    few = unique.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot), key, "left_anti").join(unique, key, "left")
    return rows.join(F.broadcast(hot), key).join(F.broadcast(few), key, "left").unionByName(rest)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the
    longest path, and a hub costs one minimum and one join row per neighbour, never a pair of neighbours.
    A hub's rows stay where they are: the minimum of a node with more than 1 / SHARE of the rows is broadcast.
    """
    spark = edges.sparkSession

    def least_of(rows: DataFrame, name: str) -> DataFrame:
        return save(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), name)

    def with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
        hot = F.col("n") * SHARE > n
        marked = rows.join(F.broadcast(least.where(hot).select("u", "m")), "u", "left")
        return marked.where("m IS NOT NULL").unionByName(marked.where("m IS NULL").drop("m").join(least.where(~hot).select("u", "m"), "u"))

    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u")).toDF("u", "v")
        large = with_least(both.where("v > u"), least_of(both, "least"), mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(large, "large")
        least = least_of(large, "least")
        small = with_least(large, least, mark[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        now = save(small.distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(roots)
