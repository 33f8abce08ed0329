"""Best-fit packing of documents into token sequences.

Large-item matching: at most two pieces above one third of the capacity share a sequence, so these are
matched greedily, each with the largest partner that fits, which uses the fewest sequences for them.
Smaller pieces, longest first, go to the fullest sequence with room (best fit).

Pieces of one length are alike, so both steps run over the number of pieces of each length (at most
`capacity` numbers, whatever the corpus); the pieces then find their places by their rank within their
length in one shuffle. Hot lengths are ranked in salted parts.

Defined cases: null or empty text is one piece holding the end id; a null doc_id is kept; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, partitions, save, texts
from .tokens import default_path, tokenizer_of

#: Chunks a worker remembers where it also holds ids for its output, so that the executor's JVM has the rest.
KNOWN_WITH_IDS = 500_000


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end: int = 1, with_ids: bool = True) -> DataFrame:
    """Token pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    path = tokenizer or default_path()
    kind = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    sql = "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = texts(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_of(path, KNOWN_WITH_IDS) if with_ids else tokenizer_of(path)
        pa.default_memory_pool().release_unused()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                (text,) = columns(batch, "text")
                ids, n = coder.encode(text, end)
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                edges = np.concatenate([[0], np.cumsum(length)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                out = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([(batch.schema.names[0], batch.schema.types[0]), *kind]))

    return docs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {sql}")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for the pieces of each length: (length, rank_from, rank_to, first sequence, pieces a sequence, offset).

    histogram: number of pieces by length, 1 <= length <= capacity. The piece of rank r lies in sequence
    first + (r - rank_from) // a at offset + (r - rank_from) % a * length.
    """
    left, rank, out = dict(histogram), dict.fromkeys(histogram, 0), []
    gaps: list[int] = []
    rooms: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def room(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in rooms:
                insort(gaps, gap)
                rooms[gap] = []
            rooms[gap].append((first, n))

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, rank[length], rank[length] + n, first, each, offset))
        rank[length] += n
        left[length] -= n

    big = sorted(x for x in left if 3 * x > capacity)
    while big:
        a = big[-1]
        fits = bisect_left(big, capacity - a + 1)
        b = big[fits - 1] if fits and not (big[fits - 1] == a and left[a] == 1) else big[fits - 2] if fits > 1 else None
        if b is None:
            n = left[a]
            place(a, n, sequences, 1, 0)
            room(capacity - a, sequences, n)
        elif b == a:
            n = left[a] // 2
            place(a, 2 * n, sequences, 2, 0)
            room(capacity - 2 * a, sequences, n)
        else:
            n = min(left[a], left[b])
            place(a, n, sequences, 1, 0)
            place(b, n, sequences, 1, a)
            room(capacity - a - b, sequences, n)
        sequences += n
        big = [x for x in big if left[x]]
    for s in sorted((x for x in left if left[x]), reverse=True):
        while left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                n = -(-left[s] // (capacity // s))
                room(capacity, sequences, n)
                sequences += n
                continue
            gap = gaps[at]
            first, n = rooms[gap].pop()
            each = min(gap // s, left[s])
            used = min(n, left[s] // each)
            if used < n:
                rooms[gap].append((first + used, n - used))
            if not rooms[gap]:
                del rooms[gap], gaps[at]
            place(s, used * each, first, each, capacity - gap)
            room(gap - each * s, first, used)
    return out


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to items, which have doc_id, piece and length (1 to capacity).

    items is read twice, so pass a saved table if it is dear to make. The plan's size depends on
    capacity alone (its places are bounded by the distinct lengths and gaps), so it is broadcast.
    """
    spark = items.sparkSession
    salts = max(32, partitions(spark))
    told = [c for c in ("doc_id", "piece", "ids_crc32") if c in items.columns]  # the last tells rows without a doc_id apart
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*told), F.lit(salts)).cast("int"))
    counts = save(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    rows = plan(histogram, capacity)
    places = spark.createDataFrame(rows, "_length long, _from long, _to long, _first long, _each long, _offset long")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*told)) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    i = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(
        *items.columns,
        (F.col("_first") + F.floor(i / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(i, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places; with_ids carries the token ids along."""
    return pack(save(pieces(docs, tokenizer, capacity, end, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, doc_ids and ids (each at most `capacity` long)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))
