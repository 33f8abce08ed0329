"""Tenants with equal ids, users and hosts: each gets what it would get alone."""

import uuid

import pytest
from pyspark.sql import functions as F

from lumenwatch.operators import incidents, suppression, tenants
from lumenwatch.operators.graph import save, scratch
from lumenwatch.plans import tenants as plans
from lumenwatch.streaming.tables import Projection

FOUND = "tenant string, finding_id string, rule_id string, severity int, risk_points int, techniques array<string>, entities array<string>, seq long, us long"
HOUR = 3_600_000_000
SF = "/root/testdata/sf0.001"


def rows_of_two(spark):
    rows = [("a", "f1", "r", 75, 40, ["T1"], ["user:u1", "host:h1"], 1, 0), ("a", "f2", "r", 50, 10, [], ["host:h1"], 2, HOUR), ("a", "f3", "q", 25, 5, [], [], 3, 0)]
    other = [("vpn é", "f1", "r", 25, 7, ["T2"], ["user:u1"], 4, 0), ("vpn é", "f2", "r", 25, 7, [], ["host:h1"], 5, 0), ("vpn é", "f3", "q", 25, 5, [], [], 6, 0), (None, "f3", "q", 25, 5, [], ["user:u1"], 7, 0)]
    return spark.createDataFrame([*rows, *other], FOUND)


def test_incidents_are_those_of_each_tenant_alone(spark):
    found = rows_of_two(spark)
    columns = ["incident_key", "risk_score", "severity", "findings", "entities", "primary_entity", "title", "kill_chain", "first_us", "last_us"]
    got = tenants.unscoped(incidents.roll_up(incidents.correlate(tenants.scoped(found, "finding_id"))), "incident_key").select("tenant", *columns)
    want = []
    for t in ("a", "vpn é", None):
        alone = found.where(F.col("tenant").eqNullSafe(F.lit(t)))
        alone = alone.withColumn("entities", F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array(F.lit("global:unknown"))))
        want += [(t, *r) for r in incidents.roll_up(incidents.correlate(alone)).select(columns).collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert tenants.unscoped(tenants.scoped(found.limit(0), "finding_id"), "finding_id").count() == 0


@pytest.fixture(scope="module")
def of_events(spark):
    """Incidents of the registered queries, whose tenants number their events alike: found by events, as they are, and by findings."""
    found = tenants.scoped(plans._findings(spark, SF), "finding_id")
    return plans._incidents(spark, SF), save(incidents.roll_up(incidents.correlate(found)), "by-finding")


def test_events_of_equal_numbers_link_no_tenants_in_incidents(spark, of_events, monkeypatch):
    got = []
    for found in of_events:
        monkeypatch.setattr(plans, "_incidents", lambda *_: found)  # noqa: B023
        got.append(sorted(map(repr, plans.tenant_incidents(spark, SF).collect())))
    assert got[0] == got[1] and got[0]


def test_events_of_equal_numbers_link_no_tenants_in_proposals(spark, of_events, monkeypatch):
    got = []
    for found in of_events:
        monkeypatch.setattr(plans, "_incidents", lambda *_: found)  # noqa: B023
        got.append(sorted(map(repr, plans.tenant_proposals(spark, SF).collect())))
    assert got[0] == got[1] and got[0]


def test_events_of_equal_numbers_link_no_tenants_in_counts(spark, of_events, monkeypatch):
    got = []
    for found in of_events:
        monkeypatch.setattr(plans, "_incidents", lambda *_: found)  # noqa: B023
        got.append({(r.name, r.tenant): r.n for r in plans.tenant_counts(spark, SF).collect()})
    assert got[0] == got[1] and {t for name, t in got[0] if name == "incidents"} == {"t0", "t1", "t2"}


def test_keys_come_back(spark):
    found = rows_of_two(spark).where("finding_id <> 'f3'").select(FOUND.split()[0], "finding_id", "entities", "seq")
    back = tenants.unscoped(tenants.scoped(found, "finding_id"), "finding_id").select(*found.columns)
    assert sorted(back.collect(), key=lambda r: r.seq) == sorted(found.collect(), key=lambda r: r.seq)


def test_exceptions_repeats_and_switches_of_the_own_tenant(spark):
    found = rows_of_two(spark)
    own = spark.createDataFrame([("s1", 1, "*", "host:h1", "suppress", None, None, True, "a"), ("s2", 2, "r", None, "suppress", None, None, True, "vpn é")], "suppression_id string, position int, rule_id string, entity string, action string, downgrade_to int, expires_us long, enabled boolean, tenant string")
    got = suppression.matched(found, own, F.lit(0), ("tenant",))
    assert sorted((r.seq, r.suppression_id) for r in got.collect()) == [(1, "s1"), (2, "s1"), (3, None), (4, "s2"), (5, "s2"), (6, None), (7, None)]
    one = found.withColumn("entities", F.array(F.lit("user:u1"))).withColumn("rule_id", F.lit("r"))
    assert sorted((r.seq, r.repeat_count) for r in suppression.repeats(one, 24 * HOUR, by=("tenant",)).where("us = 0").collect()) == [(1, 1), (3, 2), (4, 1), (5, 2), (6, 3), (7, 1)]
    changes = spark.createDataFrame([("a", "r", False, 1, 1), ("a", "r", True, 2, 2), ("a", "q", False, 1, 1), (None, "q", False, 1, 1), ("vpn é", "r", False, 3, 1)], "tenant string, rule_id string, enabled boolean, updated_at long, seq long")
    assert sorted(r.seq for r in tenants.switched(found, changes).collect()) == [1, 2, 6]


def test_destinations_get_each_key_once(spark):
    path = f"{scratch(spark)}/t-{uuid.uuid4().hex}"
    feed, schema = Projection(spark, path), "tenant string, id string, seq long, content string"
    assert feed.delivered("s").count() == 0 and feed.backlog("s").count() == 0
    feed.put("e", 0, spark.createDataFrame([("a", "1", 1, "x"), ("b", "1", 2, "y"), ("a", "1", 3, "z")], schema))
    feed.deliver("s", 0, limit=1)
    feed.write("delivered-s", 9, feed.pending("s"))  # delivered, but lost before its row of the log
    feed = Projection(spark, path)
    feed.put("e", 1, spark.createDataFrame([("a", "1", 4, "again"), ("a", "2", 5, "new")], schema))
    for _ in range(2):
        feed.deliver("s", 1)
    assert sorted((r.tenant, r.id, r.seq, r.content) for r in feed.delivered("s").collect()) == [("a", "1", 1, "x"), ("a", "2", 5, "new"), ("b", "1", 2, "y")]
    feed.deliver("s", 2)
    assert feed.delivered("s").count() == 3
    assert sorted(map(tuple, feed.backlog("s", "w").collect())) == [("w", "a", 2, 1), ("w", "b", 1, 2)]
    assert feed.pending("w").where("tenant = 'a' AND id = '1'").first().key == "1d48e4958ca56ea7ec8502862be0c1db6acd6cc6fd4f91c4ecab0386105b066a"
