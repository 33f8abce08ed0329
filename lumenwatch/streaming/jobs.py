"""Structured Streaming jobs over arriving events: health windows, duplicates, sessions, signals and stored incidents.

What a query writes is named by its batch and counts once the batch log holds it, so a query that was
stopped, or lost its driver, goes on where it was. Per-entity state lies in list, value and map state, and
entries that nothing touches for IDLE are forgotten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import behaviour
from ..operators.graph import scratch
from .store import BatchLog, IncidentStore

#: Milliseconds for which state that nothing touches is kept.
IDLE = 90 * 86_400_000


def arriving(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A stream of the parquet files at a path (a folder or one file, hence the pattern), `files` of them in a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", where: str | None = None, every: str | None = None) -> DataFrame:
    """Run a stream over what is there now, and return what it has written so far. `where` is its folder: given again, the stream goes on.

    Each micro-batch writes a folder named by its number and then its row of the batch log, so a batch that
    runs again replaces its own output. In complete mode the last batch holds the result. `every`: run until
    stopped with a batch that often, instead of draining once.
    """
    spark = stream.sparkSession
    where = where or folder(spark, "stream")
    log = BatchLog(spark, where)

    def put(batch: DataFrame, number: int) -> None:
        version = log.begin("out", number)
        batch.write.mode("overwrite").parquet(f"{where}/out/version={version}")
        log.done("out", number, version)

    started(stream, put, where, mode, every)
    done = log.versions()
    if not done:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{where}/out/version={v}" for v in (done[-1:] if mode == "complete" else done)])


#: Whether batches without data are run; keyed state with a lifetime asks for them without end, so draining has none.
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def started(stream: DataFrame, put: Callable[[DataFrame, int], Any], where: str, mode: str = "append", every: str | None = None) -> None:
    """Start a stream with its checkpoint in the folder, and wait until it has drained what is there or, with a time between batches, until it is stopped."""
    conf = stream.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    conf.set(EMPTY_BATCHES, "true" if every else "false")
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{where}/checkpoint").trigger(**trigger).start()
    finally:
        conf.set(EMPTY_BATCHES, before)
    query.awaitTermination()


def health(stream: DataFrame, size: str = "1 day") -> DataFrame:
    """Events by source and tumbling window of event time (at); late events still count while their window is open."""
    rows = stream.withWatermark("at", "2 days").groupBy(F.window("at", size), F.coalesce("source", F.lit("unknown")).alias("source"))
    return rows.agg(F.count("*").alias("n"), F.max("us").alias("last_us")).select(F.unix_micros("window.start").alias("start_us"), "source", "n", "last_us")


def without_duplicates(stream: DataFrame, key: str, horizon: str = "40 days") -> DataFrame:
    """Re-deliveries of a key within the horizon are dropped; the state forgets keys past it."""
    return stream.withWatermark("at", horizon).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, gap: str = "24 hours") -> DataFrame:
    """Runs of a key's events with gaps of at most the given length."""
    rows = stream.withWatermark("at", "2 days").groupBy(F.session_window("at", gap), key)
    return rows.agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")).select(key, "n", "first_us", "last_us")


def stored_incidents(stream: DataFrame, where: str | None = None, limit: int | None = None) -> IncidentStore:
    """Findings of each micro-batch, late and re-delivered ones too, merged into the incidents that the batches before stored; the store afterwards."""
    spark = stream.sparkSession
    where = where or folder(spark, "incidents")
    store = IncidentStore(spark, f"{where}/store")
    more = {} if limit is None else {"limit": limit}
    started(stream, lambda batch, number: store.put("findings", number, batch, **more), where)
    return store


#: Keeps state of many entries on disk; state of this kind needs it.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(*keys).transformWithState(processor, output, "Append", "ProcessingTime")


#: Columns whose first showing of a value is a signal, and its name.
FIRSTS = {"action": "novel_action", "hour": "off_hours", "src_ip": "novel_src_ip", "host": "novel_host"}
#: The signals by their number in a row of many, and their points.
NAMES = (*FIRSTS.values(), "burst")
#: What is kept of an entity: how many events it had, how many of them with a source and with a host, its last times (64-bit integers), and the values seen, as kind:value.
PAST = "events long, sources long, hosts long, recent binary, seen array<string>"


def _told(past: tuple | None, us: np.ndarray, firsts: dict[str, int], sources: int, hosts: int, burst_us: int) -> tuple[list[int], list[int], tuple]:
    """Places and numbers of the signals of an entity's events, and its past after them.

    us: their times in order of arrival; firsts: the place where each kind:value comes first; sources and hosts: how many events have one.
    """
    events, old_sources, old_hosts, recent, seen = past or (0, 0, 0, b"", [])
    known, had = set(seen), {"src_ip": old_sources > 0, "host": old_hosts > 0}
    fresh, places, names = [], [], []
    for pair, place in sorted(firsts.items(), key=lambda f: f[1]):
        kind = pair.partition(":")[0]
        if kind in had:
            before, had[kind] = had[kind], True
        else:
            before = events + place >= (behaviour.WARM_ENTITY if kind == "hour" else 1)
        if pair not in known:
            fresh.append(pair)
            if before:
                places.append(place)
                names.append(NAMES.index(FIRSTS[kind]))
    times = np.concatenate([np.frombuffer(recent, np.int64), us])
    if len(times) >= behaviour.BURST:
        bursts = np.flatnonzero(_in_window(times, len(times) - len(us), burst_us) >= behaviour.BURST).tolist()
        places += bursts
        names += [len(NAMES) - 1] * len(bursts)
    return places, names, (events + len(us), old_sources + sources, old_hosts + hosts, times[-behaviour.REMEMBERED :].tobytes(), [*seen, *fresh])


class Signals(StatefulProcessor):
    """Signals of one entity against its own past, from a row an event. Its state is read once and written once a micro-batch."""

    def __init__(self, burst_us: int, idle: int):
        self.burst_us, self.idle = burst_us, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getValueState("past", PAST, self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: r.seq)
        firsts: dict[str, int] = {}
        for place, r in enumerate(batch):
            for kind in FIRSTS:
                if kind in ("action", "hour") or r[kind]:
                    firsts.setdefault(f"{kind}:{r[kind]}", place)
        places, names, past = _told(self.past.get(), np.array([r.us for r in batch], np.int64), firsts, sum(bool(r.src_ip) for r in batch), sum(bool(r.host) for r in batch), self.burst_us)
        self.past.update(past)
        for place, name in zip(places, names, strict=True):
            yield Row(event_id=batch[place].event_id, seq=batch[place].seq, entity=key[0], signal=NAMES[name], points=behaviour.POINTS[NAMES[name]])

    def close(self) -> None:
        pass


class PackedSignals(StatefulProcessor):
    """The same for all entities of a bucket, from packs of their events (packed()); gives rows of at most SOME signals.

    A call to the state or a row in and out costs far more than an event: an entity takes two calls, what goes around a key is shared by its bucket.
    """

    def __init__(self, burst_us: int, idle: int):
        self.burst_us, self.idle = burst_us, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getMapState("past", "entity string", PAST, self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        packs: dict[str, list[Row]] = {}
        for r in rows:
            packs.setdefault(r.entity, []).append(r)
        for entity, own in packs.items():
            event_id, seq, us = (np.concatenate([np.frombuffer(p[c], np.int64) for p in own]) for c in ("event_id", "seq", "us"))
            if len(own) > 1:
                order = np.argsort(seq, kind="stable")
                event_id, seq, us = event_id[order], seq[order], us[order]
            firsts: dict[str, int] = {}
            for p in own:
                for pair, place in zip(p.seen, np.searchsorted(seq, np.frombuffer(p.firsts, np.int64)).tolist(), strict=True):
                    firsts[pair] = min(place, firsts.get(pair, place))
            places, names, past = _told(self.past.getValue((entity,)), us, firsts, sum(p.sources for p in own), sum(p.hosts for p in own), self.burst_us)
            self.past.updateValue((entity,), past)
            for i in range(0, len(places), SOME):
                at = places[i : i + SOME]
                yield Row(entity=entity, event_id=event_id[at].tolist(), seq=seq[at].tolist(), signal=names[i : i + SOME])

    def close(self) -> None:
        pass


def _in_window(times: np.ndarray, old: int, window_us: int, block: int = 4096) -> np.ndarray:
    """For each time from place `old` on: how many of it and the REMEMBERED before it lie within the window up to it."""
    if len(times) <= behaviour.REMEMBERED:
        near = times[None, :] >= times[old:, None] - window_us
        return (near & (np.arange(len(times))[None, :] < np.arange(old, len(times))[:, None])).sum(1) + 1
    padded = np.concatenate([np.full(behaviour.REMEMBERED, np.iinfo(np.int64).min), times])
    before = np.lib.stride_tricks.sliding_window_view(padded, behaviour.REMEMBERED)
    return np.concatenate([np.zeros(0, np.int64), *[(before[i : min(i + block, len(times))] >= times[i : i + block, None] - window_us).sum(1) + 1 for i in range(old, len(times), block)]])


#: Rows, and their bytes, that a task packs together; signals in one row of many; buckets of entities, fixed for a stream's life.
PACK, PACK_BYTES, SOME, BUCKETS = 1 << 19, 1 << 27, 10_000, 4096
PACKS = "entity string, event_id binary, seq binary, us binary, seen array<string>, firsts binary, sources long, hosts long"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKS of rows (entity, event_id, seq, us and FIRSTS): a row for each entity in each PACK rows, with its events in order and each value where it comes first.

    Numbers are 64-bit integers in machine order. An entity's packs meet at its state.
    """
    some, rows, size = [], 0, 0
    for batch in batches:
        some.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= PACK or size >= PACK_BYTES:
            yield _pack(pa.Table.from_batches(some))
            some, rows, size = [], 0, 0
    if rows:
        yield _pack(pa.Table.from_batches(some))


def _pack(table: pa.Table) -> pa.RecordBatch:
    column = lambda name: table[name].combine_chunks()
    longs = lambda name: column(name).to_numpy(zero_copy_only=True)  # noqa: E731  a null is refused
    owner = column("entity").dictionary_encode()
    order = np.lexsort((longs("seq"), owner.indices.to_numpy()))
    code = owner.indices.to_numpy()[order].astype(np.int64)
    n, lengths = len(owner.dictionary), np.bincount(code)

    def cut(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(lengths * values.itemsize)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])

    seq, found, having = longs("seq")[order], [], {}
    for kind in FIRSTS:
        coded = column(kind).dictionary_encode()
        value, words = coded.indices.to_numpy()[order], coded.dictionary.to_pylist()
        at = np.arange(len(code)) if kind in ("action", "hour") else np.flatnonzero(np.array([w != "" for w in words], bool)[value])
        having[kind] = np.bincount(code[at], minlength=n)
        first = at[np.unique(code[at] * len(words) + value[at], return_index=True)[1]]  # the first in order of seq
        found.append((code[first], seq[first], pa.array([f"{kind}:{w}" for w in words], pa.string()).take(pa.array(value[first]))))
    owners, firsts = (np.concatenate([f[i] for f in found]) for i in range(2))
    by, shown = np.argsort(owners, kind="stable"), np.bincount(owners, minlength=n)
    seen = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shown)]).astype(np.int32)), pa.concat_arrays([f[2] for f in found]).take(pa.array(by)))
    columns = [owner.dictionary, cut(longs("event_id")[order], lengths), cut(seq, lengths), cut(longs("us")[order], lengths), seen, cut(firsts[by], shown), pa.array(having["src_ip"]), pa.array(having["host"])]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PACKS.split(", ")])


def signals(stream: DataFrame, burst_us: int = 120_000_000, idle: int = IDLE) -> DataFrame:
    """event_id, seq, entity, signal and points of the five signals that rest on an entity's own past, as in the batch form.

    Rows are packed by entity in the tasks that read them, and signals leave a key in rows of many: a row through the
    state's worker costs as much as a pack.
    """
    rows = stream.withColumn("entity", F.explode("entities"))
    user = F.col("entity").startswith("user:")
    own = lambda c: F.when(user, F.coalesce(c, F.lit(""))).otherwise("").alias(c)
    hour = F.coalesce(F.hour("ts").cast("string"), F.lit("None")).alias("hour")
    rows = rows.select("event_id", "seq", "us", "entity", F.coalesce("action", F.lit("")).alias("action"), hour, own("src_ip"), own("host"))
    packs = rows.mapInArrow(packed, PACKS).withColumn("bucket", F.pmod(F.hash("entity"), F.lit(BUCKETS)))
    many = _stateful(packs, ["bucket"], PackedSignals(burst_us, idle), "entity string, event_id array<long>, seq array<long>, signal array<int>")
    each = many.select("entity", F.explode(F.arrays_zip("event_id", "seq", "signal")).alias("s"))
    told = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("s.signal") + 1)
    return each.select("s.event_id", "s.seq", "entity", told(NAMES).alias("signal"), told([behaviour.POINTS[n] for n in NAMES]).cast("long").alias("points"))


class Repeats(StatefulProcessor):
    """Repeats of one key: its times within the window."""

    def __init__(self, window_us: int, allowed: int, idle: int):
        self.window_us, self.allowed, self.idle = window_us, allowed, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "us long", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: (r.us, r.seq))
        recent, first = [r[0] for r in self.recent.get()], 0
        for r in batch:
            recent.append(r.us)
            while recent[first] < r.us - self.window_us:
                first += 1
            n = len(recent) - first
            yield Row(event_id=r.event_id, repeat_count=n, repeated=n > self.allowed)
        self.recent.put([(t,) for t in recent[first:]])

    def close(self) -> None:
        pass


def repeats(stream: DataFrame, keys: list[str], window_us: int, allowed: int, idle: int = IDLE) -> DataFrame:
    """event_id, repeat_count and repeated, as in the batch form for a key's events that come in order of time."""
    return _stateful(stream.select("event_id", "us", "seq", *keys), keys, Repeats(window_us, allowed, idle), "event_id long, repeat_count long, repeated boolean")


class Novelty(StatefulProcessor):
    """Values that one key shows for the first time; its state is read once and written once a micro-batch."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "value string", self.idle)
        self.any = handle.getValueState("any", "seen boolean", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        batch = sorted(rows, key=lambda r: r.seq)
        began = self.any.get() is not None
        known, added = {v[0] for v in self.seen.get()} if began else set(), []
        for r in batch:
            if r.value not in known:
                known.add(r.value)
                added.append((r.value,))
                if began or len(added) > 1:
                    yield Row(event_id=r.event_id, key=key[0], value=r.value)
        self.any.update((True,))
        if added:
            self.seen.appendList(added)

    def close(self) -> None:
        pass


def novelty(stream: DataFrame, key: str, value: str, idle: int = IDLE) -> DataFrame:
    """event_id, the key and a value that the key shows for the first time, other than its very first."""
    rows = stream.select("event_id", "seq", F.col(key).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL AND value IS NOT NULL")
    return _stateful(rows, ["key"], Novelty(idle), "event_id long, key string, value string")
