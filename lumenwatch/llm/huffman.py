"""Token-id files: canonical length-limited Huffman codes from global counts, in independent blocks.

Format. A file set has two tables. `code`: one row, `lengths` (one byte for each id: its code's length,
0 if unused; the canonical code follows from the lengths). `blocks`: one row for each block with
`shard` and `block` (ascending doc_id order), `n_docs`, `n_tokens` and `payload`:

    u32 n_docs, u32 interval, i64 doc_id[n_docs], u32 n_tokens[n_docs],
    u64 bit offset of each checkpoint (every `interval`-th id of each document, from its first),
    code bits, most significant bit first

A block decodes alone from the code table: all its checkpoints are decoded side by side, one table
look-up for an id. Documents are never split over blocks.

Defined cases: null or empty text holds the end id alone; null doc_ids come first and are written as
NULL_ID; rows that repeat a doc_id are all kept, next to each other, and may lie in several shards; doc_ids
that aren't integers are refused before any work; an empty table gives no blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, partitions, save, texts
from .tokens import default_path, tokenizer_of

LIMIT = 16  # longest code, in bits; the decoding table has 2**LIMIT entries
INTERVAL = 256  # ids between two checkpoints
BLOCK_TOKENS = 1 << 17  # a block is closed once it holds as many
NULL_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for each id that has a count (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n, rows, now = len(order), [], weights
    leaf = np.ones(n, bool)
    for _ in range(limit):
        rows.append(leaf)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        now, leaf = both[place], place < n
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: codes ascend by (length, id)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.uint64(1) << (np.uint64(LIMIT) - lengths[order].astype(np.uint64))
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = first >> (np.uint64(LIMIT) - lengths[order].astype(np.uint64))
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LIMIT-bit prefix, the id it starts with and that code's length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.int64)
    ids[: span.sum()], size[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, size


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of the ids, and the bit offset of each id (with the end's, last)."""
    n = lengths[ids].astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(n)])
    if not len(ids):
        return b"", offsets
    at = offsets[:-1]
    bits = codes[ids] << (64 - n - (at & 31)).astype(np.uint64)
    word = at >> 5
    starts = np.flatnonzero(np.diff(word, prepend=-1))  # codes are shorter than a word, so one starts in each
    out = np.zeros(len(starts) + 1, np.uint64)
    out[:-1] = np.add.reduceat(bits >> np.uint64(32), starts)
    out[1:] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), starts)
    return out.astype(">u4").tobytes()[: -(-int(offsets[-1]) // 8)], offsets


def decode(data: bytes, starts: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids from each checkpoint: n[i] of them from bit starts[i] on, all checkpoints side by side."""
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.int64)
    out = np.zeros(int(n.sum()), np.uint32)
    to = np.cumsum(n) - n
    lanes = np.argsort(-n, kind="stable")  # the longest first: those that end leave at the back
    at, to, n = starts[lanes].astype(np.int64), to[lanes], n[lanes]
    for step in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n, -step, side="left"))
        at, to = at[:live], to[:live]
        byte = at >> 3
        key = ((raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (8 - (at & 7))) & 0xFFFF
        out[to + step] = ids[key]
        at = at + size[key]
    return out


def _lanes(n: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Each checkpoint's first id (counted over all documents of n ids) and its number of ids."""
    parts = -(-n // interval)
    doc = np.repeat(np.arange(len(n)), parts)
    inner = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * interval
    return (np.cumsum(n) - n)[doc] + inner, np.minimum(interval, n[doc] - inner)


def _block(doc_ids: list[int], ids: np.ndarray, n: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    data, offsets = encode(ids, codes, lengths)
    starts, _ = _lanes(n, INTERVAL)
    return struct.pack("<II", len(n), INTERVAL) + np.array(doc_ids, "<i8").tobytes() + n.astype("<u4").tobytes() + offsets[starts].astype("<u8").tobytes() + data


def read_block(payload: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ids of one block."""
    docs, interval = struct.unpack_from("<II", payload)
    at = 8
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    n = np.frombuffer(payload, "<u4", docs, at + 8 * docs).astype(np.int64)
    at += 12 * docs
    _, size = _lanes(n, interval)
    starts = np.frombuffer(payload, "<u8", len(size), at)
    return doc_ids, n, decode(payload[at + 8 * len(size) :], starts, size, *table)


def tokenized(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """doc_id, n_tokens and the document's ids (little-endian u16, or u32 for larger vocabularies), end id last."""
    path = tokenizer or default_path()
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, n = coder.encode(columns(batch, "text")[0], end)
                raw, edges = memoryview(ids.astype("<u2" if coder.size <= 1 << 16 else "<u4").tobytes()), np.concatenate([[0], np.cumsum(n)])
                width = len(raw) // max(1, len(ids))
                cut = [bytes(raw[width * a : width * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(cut, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; the driver gets one row for each id of the vocabulary at most."""
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(columns(batch, "ids")[0]), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row[0]] = row[1]
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2) -> None:
    """Write all documents' ids to `path` (any folder Spark can write) in ascending doc_id order."""
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("the file format holds integer doc_ids")
    name = tokenizer or default_path()
    size = tokenizer_of(name).size
    tokens = save(tokenized(docs, name, end), "tokens")
    lengths = code_lengths(id_counts(tokens, size))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard, block = canonical(lengths), TaskContext.get().partitionId(), 0
        doc_ids, parts, held = [], [], 0

        def out() -> pa.RecordBatch:
            n = np.array([len(p) for p in parts], np.int64)
            payload = _block(doc_ids, np.concatenate(parts), n, codes, lengths)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (len(n), pa.int64()), (int(n.sum()), pa.int64()), (payload, pa.binary()))], ["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, ids in zip(*columns(batch, "doc_id", "ids"), strict=True):
                doc_ids.append(NULL_ID if doc_id is None else doc_id)
                parts.append(np.frombuffer(ids, kind))
                held += len(parts[-1])
                if held >= BLOCK_TOKENS:
                    yield out()
                    doc_ids, parts, held, block = [], [], 0, block + 1
        if parts:
            yield out()

    ordered = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/code").first()[0], np.uint8)
    blocks = spark.read.schema("shard int, block int, n_docs long, n_tokens long, payload binary").parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each written partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("shard", "block", "n_tokens").withColumn("_inner", inner).drop("n_tokens").join(shards.select("shard", before.alias("_before")), "shard")
    kind = [("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for shard, block, payload in zip(*columns(batch, "shard", "block", "payload"), strict=True):
                doc_ids, n, ids = read_block(payload, table)
                edges = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                out = [pa.array(np.full(len(n), shard, np.int32)), pa.array(np.full(len(n), block, np.int32)), pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(edges[:-1]), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema(kind))

    docs = blocks.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return docs.join(starts, ["shard", "block"]).select("doc_id", (F.col("_before") + F.col("_inner") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
