"""Line dedup: a line found in several documents stays in the one with the smallest doc_id.

Lines are exploded and normalised inside tasks (white space stripped at both ends, A-Z lower-cased), and
each document gives a 128-bit hash of each of its distinct keys. Hashes found in enough documents are
kept with the smallest doc_id; what the other documents lose goes back to them by doc_id, and texts are
put together again by position. Texts are shuffled once, to meet what they lose.

Hashes that hold more than 1 / HEAVY of all rows (at most HEAVY of them) are broadcast, so a line that a
third of the documents hold never meets its rows in one task; the count of all hashes combines before
its shuffle.

Defined cases: null or empty text is one empty line; keys shorter than `least` code points always stay;
rows that share a doc_id are one document, and all lose the same keys; rows without a doc_id lose
nothing and count as no document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, save, texts

SPACE = b" \t\n\x0b\x0c\r"
#: Most hashes that are broadcast (24 bytes each). Documents a worker turns into lines at a time.
HEAVY, SLICE = 100_000, 256


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def hashes_of(text: bytes, least: int) -> list[bytes | None]:
    """128 bits for each line's key; None for keys of fewer than `least` code points."""
    keys = map(key_of, text.split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if len(k) >= 4 * least or len(k) >= least and len(k.decode("utf-8", "replace")) >= least else None for k in keys]


def _pairs(hashes: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0]), pa.array(both[:, 1])


def keys(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id and hash (a, b) of every distinct key of each document."""
    docs = texts(docs.where("doc_id IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                owner, out = [], []
                for i, text in enumerate(columns(batch, "text")[0]):
                    found = set(hashes_of(text, least)) - {None}
                    owner += [i] * len(found)
                    out += found
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *_pairs(out)], ["doc_id", "a", "b"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, a long, b long")


def repeated(found: DataFrame, documents: int = 2) -> DataFrame:
    """a, b, the smallest doc_id and the rows of each hash that lies in at least so many documents."""
    many = F.min("doc_id") < F.max("doc_id") if documents == 2 else F.countDistinct("doc_id") >= documents
    counts = found.groupBy("a", "b").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"), many.alias("many"))
    return counts.where("many").drop("many")


def lost(found: DataFrame, documents: int = 2) -> DataFrame:
    """doc_id and the hashes that it loses; found is a saved table of keys()."""
    again = save(repeated(found, documents), "repeated")
    hot = F.broadcast(again.where(F.col("n") * HEAVY > F.lit(found.count())).drop("n"))
    cold = again.where(F.col("n") * HEAVY <= F.lit(found.count())).drop("n")
    both = found.join(hot, ["a", "b"]).unionByName(found.join(hot, ["a", "b"], "left_anti").join(cold, ["a", "b"]))
    return both.where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))


def deduplicate(docs: DataFrame, least: int = 10, documents: int = 2, with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if asked, the text that is left."""
    gone = lost(save(keys(docs, least), "lines"), documents)
    docs = texts(docs)
    named = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left")
    rest = docs.where("doc_id IS NULL").select("*", F.lit(None).cast("array<long>").alias("a"), F.lit(None).cast("array<long>").alias("b"))
    types = [pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                out = []
                for text, a, b in zip(*columns(batch, "text", "a", "b"), strict=True):
                    lines = kept = text.split(b"\n")
                    if a:
                        drop = {x.tobytes() for x in np.array([a, b], np.int64).T}
                        kept = [line for line, h in zip(lines, hashes_of(text, least), strict=True) if h not in drop]
                        text = b"\n".join(kept)
                    out.append((len(lines), len(lines) - len(kept), hashlib.sha256(text).hexdigest(), text)[: len(types)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names)

    sql = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string" + ", text binary" * with_text
    done = named.unionByName(rest).mapInArrow(run, sql)
    return done.withColumn("text", F.col("text").cast("string")) if with_text else done


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, i, w[i] AS s, translate(trim(w[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
r AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM l LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
