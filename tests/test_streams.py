"""Streams over several micro-batches: merged incidents, signals, resumption; each against plain loops or the batch form."""

import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenwatch.operators import incidents
from lumenwatch.operators.graph import scratch
from lumenwatch.streaming.store import IncidentStore

HOUR = 3_600_000_000
DAY = 24 * HOUR
FINDING = "finding_id string, event_id long, rule_id string, severity int, risk_points int, techniques array<string>, entities array<string>, seq long, us long"


def finding(n, entities, us=0, rule="R1", risk=10, severity=50, techniques=(), event=None):
    return (f"f{n:05d}", n if event is None else event, rule, severity, risk, list(techniques), list(entities), n, us)


def store_of(spark):
    return IncidentStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")


def held_by(store):
    out = defaultdict(set)
    for r in store.findings().where("fate <> 'redelivered'").collect():
        out[r.incident_key].add(r.finding_id)
    return {k: sorted(v) for k, v in out.items()}


class Plain:
    """The same rules in plain loops."""

    def __init__(self, limit):
        self.limit, self.found, self.status, self.made, self.version = limit, {}, {}, {}, 0

    def put(self, batch):
        self.version += 1
        batch = list({f[0]: f for f in batch}.values())
        parent = {f[0]: f[0] for f in batch}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        places = defaultdict(list)
        for f in batch:
            for e in f[6] or ["global:unknown"]:
                places[e].append((f[8], f[0]))
        for times in places.values():
            times.sort()
            for (t, a), (u, b) in zip(times, times[1:]):
                if u - t <= DAY:
                    a, b = sorted((root(a), root(b)))
                    parent[b] = a
        clusters = defaultdict(list)
        for f in batch:
            clusters[root(f[0])].append(f)
        before = {k: list(v) for k, v in self.found.items()}
        for key, own in clusters.items():
            able = [k for k, v in before.items() if self.status[k] in ("open", "investigating") and len(v) < self.limit]
            able.sort(key=lambda k: (-min(1000, sum(f[4] for f in before[k])), self.made[k], k))
            near = lambda k: any(e != "global:unknown" and e in g[6] and abs(f[8] - g[8]) <= DAY for f in own for e in f[6] for g in before[k])  # noqa: E731, B023
            target = next(filter(near, able), None)
            if target is None:
                target = key if key not in before else f"{key}~{self.version}"
                self.found[target], self.status[target], self.made[target] = [], "open", min(f[8] for f in own)
            has = {(f[2], f[1]) for f in before.get(target, [])}
            self.found[target] += [f for f in own if (f[2], f[1]) not in has]

    def keys(self):
        return {k: sorted(f[0] for f in v) for k, v in self.found.items()}


def test_batches_merge_into_stored_incidents_as_plain_loops_do(spark):
    import random

    rng = random.Random(4)
    rows = []
    for n in range(160):
        entities = rng.sample([f"user:u{i}" for i in range(9)] + [f"host:h{i}" for i in range(9)], rng.choice([0, 1, 1, 2]))
        rows.append(finding(n, entities, rng.randrange(30) * 9 * HOUR, rng.choice(["R1", "R2"]), rng.choice([0, 10, 40])))
    batches = [rows[:60], rows[60:100] + rows[20:30], rows[100:] + rows[95:99] + rows[:5]]
    store, plain = store_of(spark), Plain(12)
    for i, batch in enumerate(batches):
        found = spark.createDataFrame(batch, FINDING)
        assert store.put("s", i, found, limit=12) == i + 1
        plain.put(batch)
        assert held_by(store) == plain.keys()
    assert store.put("s", 2, found, limit=12) == 3 and held_by(store) == plain.keys()  # the last batch again
    state = {r.incident_key: r for r in store.incidents().collect()}
    assert set(state) == set(plain.found)
    for key, own in plain.found.items():
        assert (state[key].findings, state[key].risk_score, state[key].created_us) == (len(own), min(1000, sum(f[4] for f in own)), plain.made[key])
    assert store.incidents(1).count() == len(set(store.findings(1).toPandas()["incident_key"]))


@pytest.mark.parametrize(("gap", "joins"), [(DAY, True), (DAY + 1, False), (-DAY, True), (-DAY - 1, False)])
def test_window_boundary(spark, gap, joins):
    store = store_of(spark)
    store.put("s", 0, spark.createDataFrame([finding(1, ["user:a"], 5 * DAY)], FINDING))
    store.put("s", 1, spark.createDataFrame([finding(2, ["user:a"], 5 * DAY + gap)], FINDING))
    assert (store.incidents().count() == 1) is joins


def test_full_closed_and_redelivered(spark):
    store = store_of(spark)
    store.put("s", 0, spark.createDataFrame([finding(n, ["user:a"], n) for n in range(2000)] + [finding(5000, ["user:b"], 0, severity=25)], FINDING))
    store.put("s", 1, spark.createDataFrame([finding(3000, ["user:a"], 9), finding(5001, ["user:b"], 5, event=5000), finding(5002, ["user:b"], 6, severity=75)], FINDING))
    got = {r.incident_key: r for r in store.incidents().collect()}
    assert {k: (r.findings, r.material) for k, r in got.items()} == {"f00000": (2000, False), "f03000": (1, True), "f05000": (2, True)}
    assert [r.finding_id for r in store.findings().where("fate = 'redelivered'").collect()] == ["f05001"]
    store.close(spark.createDataFrame([("f05000",)], "incident_key string"))
    store.put("s", 2, spark.createDataFrame([finding(5000, ["user:b"], 0), finding(6000, ["user:b"], 7)], FINDING))
    got = {r.incident_key: r.findings for r in store.incidents().collect()}
    assert got["f05000"] == 2 and got["f05000~4"] == 2  # a closed incident takes nothing, and its key stays its own
    assert incidents.MAX_FINDINGS == 2000 and store.findings().where(F.col("incident_key") == "f05000").count() == 3


def test_a_stopped_stream_goes_on_without_loss_or_repeat(spark, tmp_path):
    from lumenwatch.streaming import jobs

    source, where = f"file://{tmp_path}/in", jobs.folder(spark, "resumed")
    part = lambda i: spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{source}/{i}")
    part(0)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    assert jobs.drained(stream(), where=where).count() == 10
    part(1)
    done = jobs.BatchLog.done

    def lost(self, *args):
        raise RuntimeError("driver lost before the log was written")

    jobs.BatchLog.done = lost
    try:
        with pytest.raises(Exception, match="driver lost"):
            jobs.drained(stream(), where=where)
    finally:
        jobs.BatchLog.done = done
    part(2)
    assert sorted(r.id for r in jobs.drained(stream(), where=where).collect()) == list(range(30))


def test_signals_forget_idle_entities(spark, tmp_path):
    import time

    from lumenwatch.streaming import jobs

    rows = lambda *r: spark.createDataFrame(r, "event_id long, seq long, us long, ts timestamp_ntz, entities array<string>, action string, src_ip string, host string")
    import datetime

    at = datetime.datetime(2024, 1, 1, 5)
    source = f"file://{tmp_path}/in"
    for idle, want in ((3_600_000, ["novel_action", "novel_src_ip"]), (1, [])):
        where, path = jobs.folder(spark, "idle"), f"{source}{idle}"
        rows((1, 1, 0, at, ["user:a"], "x", "1.1.1.1", None)).coalesce(1).write.parquet(f"{path}/0")
        stream = lambda: jobs.signals(spark.readStream.schema(rows().schema).parquet(f"{path}/*"), idle=idle)  # noqa: E731, B023
        assert jobs.drained(stream(), where=where).count() == 0
        time.sleep(0.1)
        rows((2, 2, 9, at, ["user:a", "ip:2.2.2.2"], "y", "2.2.2.2", None)).coalesce(1).write.parquet(f"{path}/1")
        assert sorted(r.signal for r in jobs.drained(stream(), where=where).collect()) == want


class State:
    """Value or list state of one key that counts its calls."""

    def __init__(self, calls, many):
        self.calls, self.many, self.held = calls, many, [] if many else None

    def get(self):
        self.calls.append("get")
        return iter(list(self.held)) if self.many else self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def appendList(self, values):
        self.calls.append("append")
        self.held += values


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *args):
        return State(self.calls, False)

    def getListState(self, *args):
        return State(self.calls, True)


def test_signals_and_novelty_call_the_state_four_times_a_batch_whatever_its_rows():
    from pyspark.sql import Row

    from lumenwatch.streaming import jobs

    rows = [Row(event_id=n, seq=n, us=n, action=f"a{n % 50}", value=f"a{n % 50}", hour=n % 24, src_ip=f"i{n}", host="") for n in range(600)]
    got = {}
    for processor in (jobs.Signals(5, 1000), jobs.Novelty(1000)):
        handle, out = Handle(), []
        processor.init(handle)
        for batch in (rows[:100], rows[100:], rows[:100]):
            handle.calls.clear()
            out += processor.handleInputRows(("user:a",), iter(batch[::-1]), None)
            assert len(handle.calls) <= 4
        got[type(processor).__name__] = out
    assert [r.value for r in got["Novelty"]] == [f"a{n}" for n in range(1, 50)]
    kinds = {k: sum(r.signal == k for r in got["Signals"]) for k in ("novel_action", "novel_src_ip", "off_hours", "burst")}
    near = sum(len([t for t in ([r.us for r in rows] + [r.us for r in rows[:100]])[max(0, i - 256) : i] if t >= r.us - 5]) >= 7 for i, r in enumerate(rows + rows[:100]))
    assert kinds == {"novel_action": 49, "novel_src_ip": 599, "off_hours": 19, "burst": near}


class Entries(State):
    """Map state of one key that counts its calls."""

    def __init__(self, calls):
        super().__init__(calls, False)
        self.held = {}

    def getValue(self, key):
        self.calls.append("get")
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls.append("update")
        self.held[key] = value


def test_packed_signals_equal_those_of_rows_with_few_rows_and_calls(monkeypatch):
    import random

    import pyarrow as pa
    from pyspark.sql import Row

    from lumenwatch.streaming import jobs

    rng = random.Random(5)
    monkeypatch.setattr(jobs, "PACK", 700)
    monkeypatch.setattr(jobs, "SOME", 50)
    names = ["entity", "event_id", "seq", "us", "action", "hour", "src_ip", "host"]
    rows, us = [], 0
    for n in range(6000):
        us += rng.choice([1, 5, 40, -3])
        entity = rng.choice(["user:a", "user:b", "user:c", f"host:{n // 300}"])
        rows.append((entity, n + 7, n, us, rng.choice(["x", "y", "", f"z{n // 900}"]), str(rng.randrange(24)), rng.choice(["", f"i{rng.randrange(40)}"]) if n > 50 else "", f"h{n // 500}" if n % 3 else ""))
    plain, many, handles = [], [], {}
    whole = Handle()
    whole.getMapState = lambda *_: whole.state
    whole.state, together = Entries(whole.calls), jobs.PackedSignals(60, 1000)
    together.init(whole)
    for batch in (rows[:2500], rows[2500:2600], rows[2600:]):
        entities = {r[0] for r in batch}
        for e in entities:
            if e not in handles:
                handles[e] = jobs.Signals(60, 1000)
                handles[e].init(Handle())
            plain += handles[e].handleInputRows((e,), iter([Row(**dict(zip(names, r, strict=True))) for r in batch if r[0] == e]), None)
        rng.shuffle(batch)
        parts = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in batch[i : i + 300]]) for i in range(0, len(batch), 300)]
        packs = [Row(**p) for part in jobs.packed(iter(parts)) for p in part.to_pylist()]
        assert len(packs) <= len(entities) * -(-len(batch) // 700)
        whole.calls.clear()
        many += together.handleInputRows((0,), iter(packs), None)
        assert len(whole.calls) == 2 * len(entities)
    got = [(e, s, r.entity, jobs.NAMES[n]) for r in many for e, s, n in zip(r.event_id, r.seq, r.signal, strict=True)]
    assert sorted(got) == sorted((r.event_id, r.seq, r.entity, r.signal) for r in plain) and len(got) > 5 * len(many) and {g[3] for g in got} == set(jobs.NAMES)
    assert max(len(r.signal) for r in many) == 50 and list(jobs.packed(iter([]))) == []
