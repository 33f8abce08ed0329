"""Substring deduplication: windows of words that also start in a document with a smaller doc_id go.

Routing. Equal windows share their smallest hashed GRAM-gram (their anchor), so a document is cut into
segments: the runs of windows with one anchor occurrence. Only segments whose anchor occurs in several
documents go on. Segments of equal content are one class: all but the class's smallest document lose them
whole, and what that document loses of one it loses of all that it has. Classes that share an anchor but
differ are sorted by anchor into shards.

Shards. A task takes its classes in chunks of at most SHARD_WORDS words and builds an FM-index of each. The
classes are then streamed against it: backward search over the wavelet ranks extends a match to the left
as long as its suffix interval holds a smaller document (a range minimum), which gives the matching
statistic at that end; matches of WINDOW words and more are reported. A range sort may put one frequent
anchor into several chunks: of an anchor whose classes aren't all in a chunk, the windows that nothing
smaller in the chunk covers go on, packed by buckets of their hash, and meet their equals there, so no
anchor is ever gathered whole.

Window and class hashes have 128 bits over words' hashes of 64 bits. Defined cases: null, empty or short
texts lose nothing; a window repeated within one document only stays; a null doc_id is smaller than none
and loses nothing; rows that repeat a doc_id are one document, so a window that starts in several of them
only stays in each, but every row loses its own places alone (rows are told apart by their text's hash);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, Rolling, WordHashes, columns, partitions, save, texts
from .fmindex import FMIndex

WINDOW, GRAM, SHARD_WORDS, HEAVY = 50, 8, 300_000, 1000
SECOND = 0xD1342543DE82EF95  # the other hash's multiplier


class Spans:
    """Two hashes of any spans of one text."""

    def __init__(self):
        self.rolling = Rolling(BASE), Rolling(SECOND)

    def of(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((r.of(r.sums(words), starts, ends) ^ (ends - starts).astype(np.uint64)).view(np.int64) for r in self.rolling)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and t, which tells rows of one doc_id apart."""
    return texts(docs).withColumn("t", F.xxhash64("text"))


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, h1, h2 (of the content), doc_id, t (its text's hash), start and windows of each segment: windows start at start, start + 1, ..."""
    docs = hashed(docs.where("doc_id IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spans = WordHashes(), Spans()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[tuple[np.ndarray, ...]] = []
                for i, text in enumerate(columns(batch, "text")[0]):
                    words = text.split()
                    if len(words) < window:
                        continue
                    words = hashes.of(words)
                    grams = spans.rolling[0].grams(words, gram)
                    view = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
                    place = np.arange(len(view)) + view.argmin(1)
                    start = np.flatnonzero(np.diff(place, prepend=-1))
                    n = np.diff(start, append=len(view))
                    out.append((grams[place[start]].view(np.int64), *spans.of(words, start, start + n + window - 1), np.full(len(start), i), start, n))
                anchor, h1, h2, doc, start, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 6
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(h1), pa.array(h2), batch.column(0).take(pa.array(doc)), batch.column(2).take(pa.array(doc)), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["anchor", "h1", "h2", "doc_id", "t", "start", "windows"])

    return docs.mapInArrow(run, f"anchor long, h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, start int, windows int")


class RangeMinimum:
    """Minima of ranges: of blocks by a sparse table over blocks, of a block's ends by running minima."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        n = -(-max(1, len(values)) // self.BLOCK) * self.BLOCK
        self.values = np.full(n, np.iinfo(values.dtype).max, values.dtype)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, self.BLOCK)
        self.up, self.down = (np.ascontiguousarray(np.minimum.accumulate(b, axis=1)) for b in (blocks, blocks[:, ::-1]))
        self.up, self.down = self.up.ravel(), np.ascontiguousarray(self.down[:, ::-1]).ravel()
        levels, step = [blocks.min(1)], 1
        while 2 * step <= len(blocks):
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
            step *= 2
        self.width = len(blocks)
        self.flat = np.concatenate([np.append(x, np.zeros(self.width - len(x), x.dtype)) for x in levels])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of values[lo:hi], each range with one value at least."""
        a, b = lo // self.BLOCK, (hi - 1) // self.BLOCK
        out = np.minimum(self.down[lo], self.up[hi - 1])
        far = np.flatnonzero(b - a > 1)
        first, last = a[far] + 1, b[far]
        level = np.frexp((last - first).astype(np.float64))[1] - 1
        out[far] = np.minimum(out[far], np.minimum(self.flat[level * self.width + first], self.flat[level * self.width + last - (1 << level)]))
        same = np.flatnonzero(a == b)
        if len(same):
            place = lo[same, None] + np.arange(self.BLOCK)
            inside = place < hi[same, None]
            out[same] = np.where(inside, self.values[np.where(inside, place, lo[same, None])], np.iinfo(self.values.dtype).max).min(1)
        return out


def covered(words: list[np.ndarray], doc: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each class (its words, its smallest document): whether each of its windows occurs in a smaller document's class.

    Matching statistics by backward search: a match that ends at e reaches back to some x; windows inside it are
    covered. Windows that all hold a part for which there is no match are ruled out together.
    """
    n = np.array([len(w) for w in words])
    _, dense = np.unique(np.concatenate(words), return_inverse=True)
    base = np.cumsum(n + 1) - n - 1
    text = np.zeros(int((n + 1).sum()), np.int64)
    text[np.arange(len(dense)) + np.repeat(np.arange(len(n)), n)] = dense + 1
    rank = np.unique(doc, return_inverse=True)[1].astype(np.int32)
    owner = rank[np.repeat(np.arange(len(n)), n + 1)]
    index = FMIndex(text, owner)
    least = RangeMinimum(index.carried)

    def back(cls: np.ndarray, end: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How far left each match that ends before `end` reaches, `stop` at the furthest."""
        at, (lo, hi) = end.copy(), index.whole(len(end))
        live = np.flatnonzero(at > stop)
        while len(live):
            a, b = index.step(text[base[cls[live]] + at[live] - 1], lo[live], hi[live])
            good = a < b
            good[good] = least.of(a[good], b[good]) < rank[cls[live[good]]]
            live, a, b = live[good], a[good], b[good]
            lo[live], hi[live] = a, b
            at[live] -= 1
            live = live[at[live] > stop[live]]
        return at

    out = [np.zeros(max(0, k - window + 1), bool) for k in n.tolist()]
    cls, first, last = np.arange(len(n)), np.zeros(len(n), np.int64), n - window
    while len(cls):
        reach = back(cls, last + window, first)
        good = reach <= last
        for c, a, b in zip(cls[good].tolist(), reach[good].tolist(), last[good].tolist(), strict=True):
            out[c][a : b + 1] = True
        left = good & (reach > first)
        bad = ~good & (first < last)
        half = (first + last - 1) // 2
        cls, first, last = (
            np.concatenate([cls[left], cls[bad], cls[bad]]),
            np.concatenate([first[left], first[bad], half[bad] + 1]),
            np.concatenate([reach[left] - 1, half[bad], last[bad] - 1]),
        )
        some = first <= last
        cls, first, last = cls[some], first[some], last[some]
        # what all windows of a task share: from the last one's start to the first one's end
        common = last < first + window
        core = back(cls[common], first[common] + window, last[common])
        dead = np.zeros(len(cls), bool)
        dead[np.flatnonzero(common)[core > last[common]]] = True
        cls, first, last = cls[~dead], first[~dead], last[~dead]
    return out


def _judged(classes: DataFrame, window: int) -> DataFrame:
    """Rows (doc_id, t, start, windows) that are covered, and rows (bucket, docs, ts, starts, g1, g2) of windows still to compare."""
    spark, kind = classes.sparkSession, classes.schema["doc_id"].dataType.simpleString()
    ids = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    buckets = partitions(spark)
    names = ["doc_id", "t", "start", "windows", "bucket", "docs", "ts", "starts", "g1", "g2"]
    types = (ids, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(ids), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        words = [np.frombuffer(r[4], np.int64).view(np.uint64) for r in rows]
        docs = np.array([r[1] for r in rows])
        here, spans, out, rest = Counter(r[0] for r in rows), Spans(), [], []
        for i, ((anchor, doc_id, ts, starts, _, whole, *_), w, gone) in enumerate(zip(rows, words, covered(words, docs, window), strict=True)):
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
            out += [(doc_id, t, start + a, b - a, *[None] * 6) for t, start in zip(ts, starts, strict=True) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            if here[anchor] < whole:
                own = np.flatnonzero(~gone)
                h = spans.of(w, own, own + window)
                rest += [(np.full(len(own), i), np.full(len(own), t), start + own, *h) for t, start in zip(ts, starts, strict=True)]
        if rest:
            row, t, start, g1, g2 = (np.concatenate(c) for c in zip(*rest, strict=True))
            bucket = g1 % buckets
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                out.append((*[None] * 4, int(bucket[part[0]]), docs[row[part]].tolist(), t[part].tolist(), start[part].tolist(), g1[part].tolist(), g2[part].tolist()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*columns(batch, "anchor", "doc_id", "ts", "starts", "words", "k", "h1", "h2"), strict=True):
                if (row[0], *row[6:]) == last:  # a repeated row's: once
                    continue
                last = (row[0], *row[6:])
                rows.append(row)
                size += len(row[4]) // 8
                if size >= SHARD_WORDS:
                    yield chunk(rows)
                    rows, size = [], 0
        if rows:
            yield chunk(rows)

    ordered = classes.repartitionByRange(partitions(spark), "anchor", "h1", "h2").sortWithinPartitions("anchor", "h1", "h2")
    return ordered.mapInArrow(run, f"doc_id {kind}, t long, start int, windows int, bucket int, docs array<{kind}>, ts array<long>, starts array<int>, g1 array<long>, g2 array<long>")


def _met(judged: DataFrame) -> DataFrame:
    """Windows whose equal in another chunk belongs to a smaller document."""
    kind = judged.schema["doc_id"].dataType.simpleString()

    def meet(group: pa.Table) -> pa.Table:
        docs, ts, starts, g1, g2 = (group.column(c).combine_chunks().flatten() for c in ("docs", "ts", "starts", "g1", "g2"))
        rank = np.unique(np.array(docs.to_pylist()), return_inverse=True)[1] if len(docs) else np.zeros(0, np.int64)
        a, b = g1.to_numpy(), g2.to_numpy()
        order = np.lexsort((rank, b, a))
        fresh = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])[: len(order)]
        least = rank[order][np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))] if len(order) else rank
        late = pa.array(order[rank[order] > least])
        return pa.table({"doc_id": docs.take(late), "t": ts.take(late), "start": starts.take(late), "windows": pa.array(np.ones(len(late), np.int32))})

    return judged.where("bucket IS NOT NULL").select("bucket", "docs", "ts", "starts", "g1", "g2").groupBy("bucket").applyInArrow(meet, f"doc_id {kind}, t long, start int, windows int")


def _fetched(docs: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """The classes (anchor, h1, h2, doc_id, its places as ts and starts, windows, and k, the anchor's number of classes) with their words' hashes."""
    one = classes.withColumn("t", F.col("ts")[0])
    wanted = one.groupBy("doc_id", "t").agg(F.collect_list(F.struct("anchor", "h1", "h2", "ts", "starts", "windows", "k")).alias("own"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                out, batch = [], whole.slice(at, 128)
                for doc_id, text, own in zip(*columns(batch, "doc_id", "text", "own"), strict=True):
                    words = hashes.of(text.split())
                    out += [(s["anchor"], s["h1"], s["h2"], doc_id, s["ts"], s["starts"], words[s["starts"][0] : s["starts"][0] + s["windows"] + window - 1].tobytes(), s["k"]) for s in own]
                types = (pa.int64(), pa.int64(), pa.int64(), batch.schema.field("doc_id").type, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["anchor", "h1", "h2", "doc_id", "ts", "starts", "words", "k"])

    return hashed(docs).join(wanted, ["doc_id", "t"]).mapInArrow(run, f"anchor long, h1 long, h2 long, doc_id {kind}, ts array<long>, starts array<int>, words binary, k long")


def _with(rows: DataFrame, keys: DataFrame, total: Column, *on: str) -> DataFrame:
    """rows joined with keys (with their numbers of rows): those of more than 1 / HEAVY of the total, HEAVY at most, are broadcast."""
    heavy = F.broadcast(keys.where(F.col("rows") * HEAVY > total).drop("rows"))
    return rows.join(heavy, list(on)).unionByName(rows.join(heavy, list(on), "left_anti").join(keys.drop("rows"), list(on)))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, start, windows): runs of windows that a smaller document holds; word places start .. start + windows + window - 2."""
    every = save(segments(docs, window), "segments")
    total = F.lit(every.count())
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").drop("lo", "hi")
    some = save(_with(every, save(shared, "anchors"), total, "anchor"), "shared")
    first = F.min(F.struct("doc_id", "start", "t", "windows")).alias("m")
    far = F.min(F.struct("doc_id", (-F.col("start")).alias("back"), F.bitwise_not("t").alias("not_t"))).alias("f")  # its last place in its smallest document
    classes = some.groupBy("h1", "h2").agg(first, far, F.max("doc_id").alias("last"), F.first("anchor").alias("anchor"), F.count("*").alias("rows"))
    once = ((F.col("f.back") == -F.col("m.start")) & (F.col("f.not_t") == F.bitwise_not("m.t"))).alias("once")
    classes = save(classes.select("anchor", "h1", "h2", "m.doc_id", "m.t", "m.start", "m.windows", once, "last", "rows"), "classes")
    copied = classes.where("doc_id < last").select("h1", "h2", F.col("doc_id").alias("first_id"), "rows")
    whole = _with(some, copied, total, "h1", "h2").where("doc_id > first_id").select("doc_id", "t", "start", "windows")
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("k > 1 AND lo < hi").select("anchor", "k")
    open_ = classes.drop("last", "rows").join(mixed, "anchor")
    single = open_.where("once").select("anchor", "h1", "h2", "doc_id", "windows", "k", F.array("t").alias("ts"), F.array("start").alias("starts"))
    again = some.select("h1", "h2", "doc_id", "t", "start").join(open_.where("NOT once").drop("t", "start", "once"), ["h1", "h2", "doc_id"])
    places = F.sort_array(F.collect_set(F.struct("t", "start")))
    again = again.groupBy("anchor", "h1", "h2", "doc_id", "windows", "k").agg(places.alias("p")).select("anchor", "h1", "h2", "doc_id", "windows", "k", F.col("p.t").alias("ts"), F.col("p.start").alias("starts"))
    fetched = save(_fetched(docs, single.unionByName(again), window), "fetched")
    judged = save(_judged(fetched, window), "judged")
    return whole.unionByName(judged.where("bucket IS NULL").select("doc_id", "t", "start", "windows")).unionByName(_met(judged))


def deduplicate(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with_text, kept: the words that stay, joined by one space."""
    spans = repeats(docs, window).groupBy("doc_id", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("runs"))
    rows = hashed(docs).join(spans, ["doc_id", "t"], "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                for text, starts, runs in zip(*columns(batch, "text", "starts", "runs"), strict=True):
                    words, n = text.split(), 0
                    kept = words
                    if starts:
                        change = np.zeros(len(words) + 1, np.int64)
                        begin = np.minimum(starts, len(words))
                        np.add.at(change, begin, 1)
                        np.add.at(change, np.minimum(np.add(starts, runs) + window - 1, len(words)), -1)
                        gone = np.cumsum(change[:-1]) > 0
                        n = int(gone.sum())
                        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    kept = b" ".join(kept)
                    out.append((len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    out = rows.select("doc_id", "text", "starts", "runs").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM g JOIN m USING (h) WHERE doc_id > lo), unnest(range(i, i + 50)) AS t(p)),
k AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) d
  ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.p = d.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
