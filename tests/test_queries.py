"""Every registered query that has SQL gives the same rows as DuckDB, whatever the number of shuffle partitions."""

import glob
import math
import os

import duckdb
import pytest

from lumenwatch.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v != v or str(v) == "NaT":
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isinf(v) else v


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(repr([plain(v) for v in r]) for r in frame[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert rows_of(got) == rows_of(oracle.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["behaviour_signals", "repeat_suppression"])
def test_results_do_not_depend_on_partitions(spark, name):
    want = None
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = rows_of(registry.queries()[name](spark, SF).toPandas())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = want or got
        assert got == want


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
