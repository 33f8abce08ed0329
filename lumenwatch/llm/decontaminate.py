"""Benchmark decontamination: windows of benchmark items searched in an FM-index of each shard of documents.

A shard is what one task has gathered of its partition, up to SHARD_WORDS words; no shuffle is needed, and
a passage that many documents share is found shard by shard. A shard's index holds every run of words
that the benchmark also uses and that is as long as the shortest window: no other place can hold an
occurrence. Windows are searched backwards through wavelet ranks, occurrences are located from sampled
suffix positions, and overlapping occurrences merge into removal spans.

The benchmark is taken in blocks of about BLOCK_BYTES of text, one after the other: a block's items pass
through the driver to every task, and its spans are saved before the next block is read, so neither the
driver nor a task ever holds two. What several blocks found of a document is merged at the end.

Defined cases: null, empty or wordless texts have no words, spans or items; items without words match
nothing; a null item_id counts as 'null'; repeated rows are judged each; item rows with one item_id
count once; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, columns, mixed, save, texts, words_of
from .fmindex import FIRST, SEPARATOR, FMIndex

SHARD_WORDS, BLOCK_BYTES = 3_000_000, 32 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Windows:
    """The distinct windows of a block of benchmark items, by length: a place in the items' word numbers each, and its items.

    All in arrays, about 30 bytes a window; windows are told apart by hashes of 128 bits.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.numbers: dict[bytes, int] = {}
        parts = []
        for _, text in items:
            w = words_of(text)
            parts.append(np.fromiter((self.numbers.setdefault(x, len(self.numbers) + FIRST) for x in w), np.int32, len(w)))
        n = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(n) - n
        self.flat = np.concatenate([*parts, np.zeros(0, np.int32)])
        self.names, name = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else (np.zeros(0, object), np.zeros(0, np.int64))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(n[n > 0], size)).tolist():
            own = np.flatnonzero(np.minimum(n, size) == k)
            each = n[own] - k + 1
            at = np.arange(int(each.sum())) + np.repeat(begin[own] - (np.cumsum(each) - each), each)
            self.by_length[k] = self._distinct(at, np.repeat(name[own].astype(np.int32), each), k)
        self.shortest = min(self.by_length, default=0)

    def _distinct(self, at: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the distinct windows, where each one's owners begin, and the owners."""
        keys = np.zeros((2, len(at)), np.uint64)
        for i in range(k):
            word = self.flat[at + i].astype(np.uint64)
            keys[0] = mixed(keys[0] * np.uint64(BASE) + word)
            keys[1] = keys[1] * np.uint64(0xD1342543DE82EF95) + mixed(word)
        order = np.lexsort(keys)
        keys = keys[:, order]
        first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
        return at[order[first]], np.append(first, len(order)), owner[order]

    def chunks(self, k: int, size: int = 100_000) -> Iterator[tuple[int, np.ndarray]]:
        """The first number and the words of some windows of length k at a time."""
        at = self.by_length[k][0]
        for i in range(0, len(at), size):
            yield i, self.flat[at[i : i + size, None] + np.arange(k)].astype(np.int64)

    def owners(self, k: int, window: int) -> list[str]:
        _, first, owner = self.by_length[k]
        return self.names[owner[first[window] : first[window + 1]]].tolist()


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, merged; the spans come sorted by start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def search_shard(texts: list[bytes], windows: Windows) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]], list[set[str]]]:
    """For each text: its number of words, its merged word spans, and the items found."""
    number = windows.numbers.get
    parts, sizes = [], []
    for t in texts:
        w = words_of(t)
        sizes.append(len(w))
        parts.append(np.fromiter((number(x, SEPARATOR) for x in w), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
    flat = np.concatenate([*parts, np.zeros(1, np.int64)])
    spans = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    items: list[set[str]] = [set() for _ in texts]
    stops = np.flatnonzero(flat == SEPARATOR)
    length = np.diff(stops, prepend=-1) - 1
    long = length >= max(1, windows.shortest)
    if not windows.shortest or not long.any():
        return sizes, spans, items
    n, begin = length[long] + 1, stops[long] - length[long]
    places = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)  # where the index's text comes from
    index = FMIndex(flat[places])
    edges = np.cumsum([0, *(s + 1 for s in sizes)])
    at, reach, docs = [], [], []
    for k in windows.by_length:
        for base, patterns in windows.chunks(k):
            lo, hi = index.search(patterns)
            hit = np.flatnonzero(lo < hi)
            n = hi[hit] - lo[hit]
            rows = np.arange(int(n.sum())) + np.repeat(lo[hit] - (np.cumsum(n) - n), n)
            found = places[index.locate(rows)]
            doc = np.searchsorted(edges, found, side="right") - 1
            for d, w in set(zip(doc.tolist(), np.repeat(hit + base, n).tolist(), strict=True)):
                items[d].update(windows.owners(k, w))
            at.append(found)
            reach.append(found + k)
            docs.append(doc)
    at, reach, docs = np.concatenate(at), np.concatenate(reach), np.concatenate(docs)
    order = np.argsort(at, kind="stable")
    at, reach, docs = at[order], reach[order], docs[order]
    for d in np.unique(docs).tolist():
        own = slice(*np.searchsorted(docs, [d, d + 1]))
        spans[d] = merged(at[own] - edges[d], reach[own] - edges[d])
    return sizes, spans, items


def without(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the word spans: cut from each span's first word to its last."""
    place = [m.span() for m in _WORD.finditer(text)]
    at, out = 0, []
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : place[a][0]])
        at = place[b - 1][1]
    return b"".join([*out, text[at:]])


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, with_text: bool = False) -> DataFrame:
    """For each document: n_words, span_starts and span_ends (word places, end exclusive), item_ids, and with_text the text without its spans."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    blocks = max(1, -(-int(items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0))).first()[0]) // BLOCK_BYTES))
    docs, kind = texts(docs), docs.schema["doc_id"].dataType.simpleString()
    block = lambda b: [(r[0], bytes(r[1])) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toLocalIterator()]
    if blocks == 1:
        out = docs.mapInArrow(_searched(block(0), window, with_text), f"doc_id {kind}, {_RESULT}")
    else:
        keyed = save(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")  # numbered once, then read
        hits = [save(keyed.select(F.col("_row").alias("doc_id"), "text").mapInArrow(_searched(block(b), window, False, hits_only=True), f"doc_id long, {_RESULT}").drop("text", "n_words"), "spans") for b in range(blocks)]
        each = reduce(DataFrame.unionByName, hits).groupBy(F.col("doc_id").alias("_row")).agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("span_starts", "span_ends", "item_ids")])
        out = keyed.join(each, "_row", "left").drop("_row").mapInArrow(_merging(with_text), f"doc_id {kind}, {_RESULT}")
    return out.withColumn("text", F.col("text").cast("string")) if with_text else out.drop("text")


_RESULT = "text binary, n_words long, span_starts array<int>, span_ends array<int>, item_ids array<string>"
_TYPES = [pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
_NAMES = ["doc_id", "text", "n_words", "span_starts", "span_ends", "item_ids"]


def _batch(ids: pa.Array, *lists: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(lists, _TYPES, strict=True))], _NAMES)


def _searched(rows: list[tuple[str, bytes]], window: int, with_text: bool, hits_only: bool = False):
    """A task's search of its documents for a block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(rows, window)

        def shard(ids: list[pa.Array], held: list[bytes]) -> pa.RecordBatch:
            sizes, spans, found = search_shard(held, windows)
            starts, ends, items = [a.tolist() for a, _ in spans], [b.tolist() for _, b in spans], [sorted(f) for f in found]
            text = [without(t, a, b) if a else t for t, a, b in zip(held, starts, ends, strict=True)] if with_text else [None] * len(held)
            out = _batch(pa.concat_arrays(ids), text, sizes, starts, ends, items)
            return out.filter(pa.array([bool(a) for a in starts], pa.bool_())) if hits_only else out

        ids, held, size = [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text = columns(batch, "text")[0]
                ids.append(batch.column(0))
                held += text
                size += sum(map(len, text)) // 6
                if size >= SHARD_WORDS:
                    yield shard(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield shard(ids, held)

    return run


def _merging(with_text: bool):
    """Documents with all blocks' spans and items (null: none) to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                held, starts, ends, items = columns(batch, "text", "span_starts", "span_ends", "item_ids")
                spans = []
                for a, b in zip(starts, ends, strict=True):
                    order = np.argsort(np.array(a or [], np.int64), kind="stable")
                    a, b = merged(np.array(a or [], np.int64)[order], np.array(b or [], np.int64)[order])
                    spans.append((a.tolist(), b.tolist()))
                text = [without(t, *s) if s[0] else t for t, s in zip(held, spans, strict=True)] if with_text else [None] * len(held)
                yield _batch(batch.column(0), text, [len(words_of(t)) for t in held], [a for a, _ in spans], [b for _, b in spans], [sorted(set(i or [])) for i in items])

    return run


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find()'s spans and items."""
    hit = F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    items = F.array_join(F.array_sort("item_ids"), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("span_starts") > 0).alias("contaminated"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, i, k, item_id FROM dg JOIN bw USING (k, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS u(p) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""
