"""Tables filled exactly once, with deliveries that come again, and the archive's partitions."""

import datetime
import uuid

from pyspark.sql import functions as F

from lumenwatch.operators.graph import scratch
from lumenwatch.streaming.tables import Archive, KeyedTable, Lines


def at(spark, kind):
    return kind(spark, f"{scratch(spark)}/t-{uuid.uuid4().hex}")


def test_keys_of_two_tenants_and_batches_that_run_again(spark):
    table = at(spark, KeyedTable)
    first = spark.createDataFrame([("a", "1", 1, "x"), ("b", "1", 2, "y"), ("a", "2", 3, "p"), ("a", "2", 4, "p"), ("a", "2", 5, "q")], "tenant string, id string, seq long, content string")
    told = lambda: sorted((r.version, r.seq, r.status) for r in table.report().collect())
    want = [(1, 1, "new"), (1, 2, "new"), (1, 3, "new"), (1, 4, "same"), (1, 5, "conflict")]
    for _ in range(2):
        assert table.put("s", 0, first) == 1 and told() == want
    again = spark.createDataFrame([("b", "1", 6, "y"), ("b", "2", 7, "p"), ("a", "1", 8, "y")], first.schema)
    assert table.put("s", 1, again) == 2
    assert told() == [*want, (2, 6, "same"), (2, 7, "new"), (2, 8, "conflict")]
    assert sorted((r.tenant, r.id, r.content) for r in table.rows().collect()) == [("a", "1", "x"), ("a", "2", "p"), ("b", "1", "y"), ("b", "2", "p")]
    table.write("rows", 9, again.withColumn("hash", F.lit("h")))  # written, but lost before its row of the log
    assert table.rows().count() == 4


def test_lines_set_aside_are_taken_back_once(spark):
    lines, good = at(spark, Lines), F.col("line") != "bad"
    lines.put("s", 0, spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "seq long, line string"), good)
    for _ in range(2):
        lines.requeue("r", 0, F.lit("ok"), good & (F.col("seq") == 2))
    lines.requeue("r", 1, F.lit("bad"), good)
    assert sorted(map(tuple, lines.main().collect())) == [(1, "ok"), (2, "ok")] and [tuple(r) for r in lines.aside().collect()] == [(3, None)]


def test_replays_read_the_days_that_hold_them(spark):
    archive, day = at(spark, Archive), lambda n: datetime.date(2024, 1, 1 + n)
    rows = lambda *r: spark.createDataFrame([(n, f"l{n}", day(d)) for n, d in r], "seq long, line string, ingest_date date")
    assert archive.last(5).collect() == [] and archive.since(0).collect() == []
    archive.append("s", 0, rows(*((n, n // 10) for n in range(40))))
    archive.append("s", 1, rows((40, 0), (41, 4), (42, 4)))
    assert sorted(r.seq for r in archive.since(35).collect()) == list(range(35, 43))
    assert [r.seq for r in archive.last(5).collect()] == [42, 41, 40, 39, 38]
    assert [r.seq for r in archive.last(100).collect()] == list(range(42, -1, -1))
    plan = archive.since(41)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-01-05" in plan and "2024-01-02" not in plan
