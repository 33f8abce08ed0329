"""Ranked lexical search with bag deduplication.

Each document is restricted to the items' vocabulary: a bag of (term, tf). Documents with an identical bag
and an identical length class m score alike for every item, so they are one class: classes are grouped by
hash, and the bags themselves are part of the grouping key, which verifies them. Each class is scored
once against all items; a task keeps the best classes of each item, ties by their smallest doc_id. The
best `top` documents of an item lie in its best `top` classes, since each class ahead holds a document
ahead. Those classes then give their members by ascending doc_id.

Items are taken in blocks with at most BLOCK_BYTES of distinct (item, term) rows and about ITEMS items, whatever
the benchmark: a block's vocabulary and term weights go to every task, and documents are read once a block. The
driver holds one block's terms with a document count each. At most ITEMS * top class hashes are broadcast. The
members of a hot class are cut to `top` in salted parts first; tasks keep `top` classes an item.

Defined cases: null or wordless texts have no terms, count in nothing and are never found; an item without
terms, or without an item_id, finds nothing; item rows with one item_id are one item with the terms of
all; a document without a doc_id counts in the statistics and is never returned; repeated rows are
documents each; no documents or no items give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, save, texts, words_of

BLOCK_BYTES, ITEMS, SALTS = 32 << 20, 10_000, 256
#: Numbers in a task's score matrix; classes scored at once at most; documents cut into terms at once.
MATRIX, MOST, SLICE = 4_000_000, 1024, 512


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    items = items.where("item_id IS NOT NULL").select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(words_of(t))) for t in columns(batch, "text")[0]]
            owner = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), pa.array([t for f in found for t in f], pa.binary())], ["item_id", "term"])

    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text) and bag of every document with terms: (term number, tf) pairs by number."""
    docs = texts(docs)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows, ns, out = [], [], []
                for i, text in enumerate(columns(batch, "text")[0]):
                    if w := words_of(text):
                        seen = Counter(map(number.get, w))
                        seen.pop(None, None)
                        rows.append(i)
                        ns.append(len(w))
                        out.append(np.array(sorted(seen.items()), np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(ns, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, bag binary")


def _entries(bag: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and tf of all entries of some bags."""
    both = np.frombuffer(b"".join(bag), np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(bag)), [len(b) // 8 for b in bag]), both[:, 0], both[:, 1].astype(np.int64)


def _holders(classes: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            docs, bag = columns(batch, "docs", "bag")
            row, term, _ = _entries(bag)
            np.add.at(total, term, np.array(docs, np.int64)[row])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "df"])

    rows = classes.select("docs", "bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


class Best:
    """The best `top` classes of each item so far: score, then smallest doc_id."""

    def __init__(self, items: list[np.ndarray], weight: np.ndarray, top: int):
        self.items, self.weight, self.top = items, weight, top
        self.size = max(16, min(MOST, MATRIX // max(1, len(weight))))
        self.scores, self.leasts, self.keys = ([np.zeros(0, t)] * len(items) for t in (np.int64, np.int64, object))

    def add(self, m: np.ndarray, least: np.ndarray, bag: list[bytes]) -> None:
        row, term, tf = _entries(bag)
        part = np.zeros((len(self.weight), len(bag)), np.int64)
        part[term, row] = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
        keys = np.empty(len(bag), object)
        keys[:] = bag
        for i, terms in enumerate(self.items):
            score = part[terms].sum(0)
            floor = self.scores[i][-1] if len(self.scores[i]) == self.top else 1
            new = np.flatnonzero(score >= floor)
            if not len(new):
                continue
            score, first = np.concatenate([self.scores[i], score[new]]), np.concatenate([self.leasts[i], least[new]])
            key = np.concatenate([self.keys[i], np.fromiter(zip(m[new].tolist(), keys[new].tolist(), strict=True), object, len(new))])
            order = np.lexsort((first, -score))[: self.top]
            self.scores[i], self.leasts[i], self.keys[i] = score[order], first[order], key[order]


def _best(classes: DataFrame, items: list[np.ndarray], weight: np.ndarray, top: int) -> DataFrame:
    """item (number), score, least, m, bag: the best classes of each item in each task."""
    given = classes.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*given.value, top)
        for whole in batches:
            for at in range(0, whole.num_rows, best.size):
                m, least, bag = columns(whole.slice(at, best.size), "m", "least", "bag")
                best.add(np.array(m, np.int64), np.array(least, np.int64), bag)
        for i, (score, least, key) in enumerate(zip(best.scores, best.leasts, best.keys, strict=True)):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(score), pa.array(least), *(pa.array([k[j] for k in key], t) for j, t in enumerate((pa.int64(), pa.binary())))], ["item", "score", "least", "m", "bag"])

    return classes.select("m", "least", "bag").mapInArrow(run, "item long, score long, least long, m long, bag binary")


def _first(rows: DataFrame, keys: list[str], order: list, top: int, salt: str) -> DataFrame:
    """The first `top` rows of each key, cut in salted parts first."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    few = salted.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_at") <= top)
    return few.drop("_salt").withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= top)


def _search_block(docs: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(bytes(r[0]) for r in rows.select("term").distinct().collect())
    number = {t: i for i, t in enumerate(vocabulary)}
    names, lists = [], []
    for item, terms in rows.groupBy("item_id").agg(F.collect_list("term")).orderBy("item_id").collect():
        names.append(item)
        lists.append(np.array(sorted(number[bytes(t)] for t in terms), np.int64))
    held = save(bags(docs, vocabulary), "bags")
    many, total = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.expr(f"50 + CAST(CAST(50 * n AS DECIMAL(20, 0)) * CAST({many} AS DECIMAL(18, 0)) div CAST({max(1, total)} AS DECIMAL(38, 0)) AS BIGINT)")
    held = held.where(F.length("bag") > 0).select("doc_id", m.alias("m"), "bag").withColumn("h", F.xxhash64("m", "bag"))
    classes = save(held.groupBy("h", "m", "bag").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least")), "classes")
    weight = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1))) for df in _holders(classes, len(vocabulary)).tolist()], np.int64)
    best = save(_best(classes.where("least IS NOT NULL"), lists, weight, top), "best")
    winners = save(_first(best, ["item"], [F.desc("score"), F.asc("least")], top, "bag").select("item", "score", "m", "bag", F.xxhash64("m", "bag").alias("h")), "winners")
    some = held.where("doc_id IS NOT NULL").join(F.broadcast(winners.select("h").distinct()), "h", "left_semi")
    members = _first(some, ["h", "m", "bag"], [F.asc("doc_id")], top, "doc_id").drop("_at")
    found = _first(winners.join(members, ["h", "m", "bag"]).select("item", "score", "doc_id"), ["item"], [F.desc("score"), F.asc("doc_id")], top, "doc_id")
    kinds = f"item long, item_id {rows.schema['item_id'].dataType.simpleString()}"
    return found.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), kinds)), "item").select("item_id", F.col("_at").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best `top` documents of each item."""
    terms = save(_item_terms(items), "terms")
    size, many = terms.agg(F.coalesce(F.sum(F.length("term") + 64), F.lit(0)), F.countDistinct("item_id")).first()
    blocks = max(1, -(-size // BLOCK_BYTES), -(-many // ITEMS))
    parts = [save(_search_block(docs, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), top), "found") for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM n),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, N_),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * N_) // L_))) AS part FROM tf JOIN n USING (doc_id) JOIN w USING (term), g),
s AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""
