"""Importance resampling towards a target corpus by bit-sliced aggregation.

Features are the runs of 1 to `width` words; each falls into one of `buckets` by its crc32. The gain of a
bucket is 1000 times the logarithm of the ratio of its shares in the target and in the documents, rounded
down. A document's bucket counts become bit planes, one bit a bucket: plane i holds bit i of every
count. The gains, in two's complement, are bit planes too. A document's weight, the sum of gains over
its features, is then the sum over pairs of planes of 2 ** (i + j) times the bits that both have set
(the sign plane counts negatively): whole numbers throughout, so the order of work can't matter.

The crc32 of a run of words comes from those of its words: appending bytes maps a crc32 linearly, so one
table for each length of a word gives the crc32 of all runs at once. Words are not joined.

Documents with at least `least` words are drawn by weight plus a Gumbel number made of a hash of doc_id:
the highest scores, which is a weighted draw without replacement. Ranks come from a range partitioning
by score; no task sees all rows.

Defined cases: null, empty or wordless texts have no features and weight 0; rows without a doc_id have a
weight but no score and are never drawn nor counted; repeated rows count and are drawn each; an empty
target or empty table gives gains or rows as the formulas say; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, partitions, save, texts, words_of

#: Lengths with a table of their own; documents counted at once; runs hashed at once.
LENGTHS, SLICE, STEP = 256, 64, 1 << 19


def _table(n: int) -> np.ndarray:
    """What appending n bytes makes of each byte of a crc32."""
    zeros = bytes(n)
    none = zlib.crc32(zeros)
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        row, bit = out[i // 8], 1 << i % 8
        row[bit : 2 * bit] = row[:bit] ^ np.uint32(zlib.crc32(zeros, 1 << i) ^ none)
    return out


class Words(dict):
    """A word's crc32, and its length above bit 32; emptied when it holds too many."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = zlib.crc32(word) | len(word) << 32
        return value


class Hasher:
    def __init__(self, width: int, buckets: int):
        self.width, self.buckets, self.words = width, buckets, Words()
        self.tables = np.stack([_table(n) for n in range(LENGTHS)], axis=1)

    def after(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The part of crc32(a + b) that comes from a's: crc of a, length of b."""
        short = np.minimum(n, LENGTHS - 1)
        out = self.tables[0, short, crc & 255]
        for i in range(1, 4):
            out ^= self.tables[i, short, crc >> np.uint32(8 * i) & 255]
        for i in np.flatnonzero(n >= LENGTHS).tolist():
            zeros = bytes(int(n[i]))
            out[i] = zlib.crc32(zeros, int(crc[i])) ^ zlib.crc32(zeros)
        return out

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """Number of words of each text; and, some at a time, text numbers and buckets of all runs of words."""
        get = self.words.__getitem__
        parts = [np.fromiter(map(get, w), np.int64, len(w)) for w in map(words_of, texts)]
        n = np.array([len(p) for p in parts], np.int64)

        def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            flat = np.concatenate([*parts, np.zeros(0, np.int64)])
            crc, length = (flat & 0xFFFFFFFF).astype(np.uint32), flat >> 32
            owner = np.repeat(np.arange(len(n)), n)
            left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))
            blank, one = np.uint32(zlib.crc32(b" ")), np.ones(1, np.int64)
            for a in range(0, len(flat), STEP):
                b = min(a + STEP, len(flat))
                run = crc[a:b]
                yield owner[a:b], (run % self.buckets).astype(np.int64)
                at = np.arange(a, b)
                for k in range(1, self.width):
                    longer = left[at] > k
                    at, run = at[longer], run[longer]
                    run = self.after(self.after(run, np.broadcast_to(one, run.shape)) ^ blank, length[at + k]) ^ crc[at + k]
                    yield owner[at], (run % self.buckets).astype(np.int64)

        return n, runs()


def bucket_counts(docs: DataFrame, width: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all texts: one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(width, buckets), np.zeros(buckets, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                for _, b in hasher.of(columns(whole.slice(at, SLICE), "text")[0])[1]:
                    total += np.bincount(b, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    many, wanted, n = float(counts.sum()), float(target.sum()), float(len(counts))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (many + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(counts.tolist(), target.tolist(), strict=True)], np.int64)


def planes(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Bit i of each row's numbers, for i below bits, as one row of 64-bit words: shape (rows, bits, words)."""
    rows, n = numbers.shape
    out = np.zeros((rows, bits, -(-n // 64) * 8), np.uint8)
    for i in range(bits):
        out[:, i, : -(-n // 8)] = np.packbits((numbers >> i & 1).astype(bool), axis=1, bitorder="little")
    return out.view(np.uint64)


def signed_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gains' planes in two's complement, and what a bit of each is worth."""
    bits = int(np.abs(gain).max(initial=0)).bit_length() + 1
    worth = 1 << np.arange(bits, dtype=np.int64)
    worth[-1] *= -1
    return planes(gain[None, :], bits)[0], worth


def weights(counts: np.ndarray, gain_planes: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Each row's sum of counts times gains."""
    out = np.zeros(len(counts), np.int64)
    own = planes(counts, int(counts.max(initial=0)).bit_length())
    for i in range(own.shape[1]):
        for j, value in enumerate(worth.tolist()):
            out += np.bitwise_count(own[:, i] & gain_planes[j]).sum(1, dtype=np.int64) * (value << i)
    return out


def weigh(docs: DataFrame, gain: np.ndarray, width: int = 3) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    docs = texts(docs)
    kinds = ["n_words", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (sliced, worth) = Hasher(width, len(gain)), signed_planes(gain)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                n, runs = hasher.of(columns(batch, "text")[0])
                counts = np.zeros(len(n) * len(gain), np.int64)
                for owner, bucket in runs:
                    counts += np.bincount(owner * len(gain) + bucket, minlength=len(counts))
                counts = counts.reshape(len(n), len(gain))
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, counts.sum(1), weights(counts, sliced, worth)))], ["doc_id", *kinds])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{k} long' for k in kinds)}")


def gumbel(doc_id: str, seed: int) -> Column:
    """1000 times a Gumbel number made of a hash of seed and doc_id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank, 1 2 3 ... in the given order: numbered within ranges of it, then shifted by what lies before."""
    spark = rows.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            place = np.arange(n + 1, n + 1 + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(place)], [*batch.schema.names, "_part", "_place"])

    placed = save(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, _part long, _place long"), "ranges")
    sizes = dict(placed.groupBy("_part").count().collect())  # one number a range
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist(), strict=False))
    shift = F.broadcast(spark.createDataFrame(list(before.items()), "_part long, _before long"))
    return placed.join(shift, "_part").withColumn("rank", F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, seed: int = 42, least: int = 20, width: int = 3, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document; share per cent of those with enough words are drawn."""
    gain = gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    scored = save(weigh(docs, gain, width).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "scored")
    able = F.col("score").isNotNull() & (F.col("n_words") >= least)
    drawn = share * scored.where(able).count() // 100
    order = ranked(scored.where(able), [F.desc("score"), F.asc("doc_id")])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return order.withColumn("rank", rank).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The drawn documents themselves, with all their columns."""
    chosen = resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi")


#: The crc32 takes a feature's bytes as hexadecimal digits, low half first, with a table of 16 entries.
SQL = r"""
WITH RECURSIVE x AS (SELECT false AS target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT true, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT target, doc_id, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS n FROM x, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
u AS (SELECT g, hex(encode(g)) AS x FROM f GROUP BY g),
step AS (SELECT v, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS a FROM range(16) AS r(v)),
nibble AS (SELECT list(d ORDER BY v) AS t FROM (SELECT p.v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS d
  FROM (SELECT v, CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END AS c FROM (SELECT v, CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END AS b FROM step) q) p)),
crc AS (SELECT g, 1 AS i, 4294967295::BIGINT AS c, x FROM u
  UNION ALL SELECT g, i + 2, xor(e >> 4, t[(xor(e, instr('0123456789ABCDEF', x[i]) - 1) & 15) + 1]), x
    FROM (SELECT g, i, x, t, xor(c >> 4, t[(xor(c, instr('0123456789ABCDEF', x[i + 1]) - 1) & 15) + 1]) AS e FROM crc, nibble WHERE i < length(x)) y),
b AS (SELECT g, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE i > length(x)),
totals AS (SELECT bucket, sum(n) FILTER (WHERE NOT target) AS s, sum(n) FILTER (WHERE target) AS t FROM f JOIN b USING (g) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS s_, coalesce(sum(t), 0) AS t_ FROM totals),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_ + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_ + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals, sums),
weight AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (SELECT x.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || x.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM x LEFT JOIN weight USING (doc_id) WHERE NOT target),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN able USING (doc_id)"""
