"""Incident queries over all findings against brute force."""

from itertools import pairwise

from lumenwatch.functions.rules import RULES
from lumenwatch.operators import detection
from lumenwatch.plans import registry
from lumenwatch.sources.events import security_events


def test_incidents_of_all_findings_equal_brute_force(spark):
    sf, queries = "/root/testdata/sf0.001", registry.queries()
    found = detection.evaluate(security_events(spark, sf), RULES).select("finding_id", "severity", "risk_points", "us", "entities").collect()
    parent = {r.finding_id: r.finding_id for r in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for r in found:
        for e in r.entities or ["global:unknown"]:
            by.setdefault(e, []).append((r.us, r.finding_id))
    for places in by.values():
        for (t, a), (u, b) in pairwise(sorted(places)):
            if u - t <= 24 * 3600 * 1_000_000:
                a, b = sorted((root(a), root(b)))
                parent[b] = a
    want = {}
    for r in found:
        want.setdefault(root(r.finding_id), []).append(r)
    got = {r.incident_key: r for r in queries["incident_rollup"](spark, sf).collect()}
    assert set(got) == set(want) and min(r.severity for r in found) < 75
    for k, own in want.items():
        entities = sorted({e for r in own for e in r.entities or ["global:unknown"]})
        assert (got[k].findings, got[k].risk_score, got[k].severity, got[k].entities) == (len(own), min(1000, sum(r.risk_points for r in own)), max(r.severity for r in own), ",".join(entities))
    counts = [r.n for r in queries["table_counts"](spark, sf).collect() if r.name == "findings"]
    assert sum(counts) == len(found)
    sql = registry.oracle_sql()
