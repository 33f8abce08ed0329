"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits recursively along random directions at a median; a vector within the spill margin of a
split goes down both sides, so close pairs rarely part. All rows are indexed; only the medians come from
a bounded sample (about SAMPLE vectors, by hash). The depth follows the number of vectors, so leaves hold
about LEAF of them. The number of trees follows the depth: PART is the chance that one split parts a pair
at a cosine of 0.9, so that MISSED at most of such pairs part in every tree (tests measure it); a forest
without splits is one leaf, compared once. Pairs are compared within leaves, in blocks of BLOCK rows for
leaves that are larger (so no leaf has a cap), and verified in double precision.

A pair may share several leaves. It counts in the first of them, which the task finds by sending the pair's
vectors down the forest again, so pairs never leave their task: each leaf passes on one row a vector, with
its number of links there and the smallest vector it reaches. Equal vectors are one class before any
comparison.

Defined cases: null, empty or zero vectors, and those that hold null or non-finite components, link with
nothing, and so does a row with a null vec_id; vectors of other lengths than another never link with it;
repeated rows are other vectors of the same class; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, components, save

SAMPLE, LEAF, BLOCK, TREES, SUPPORT = 20_000, 1024, 2048, 4, 64
#: Spill margin times the square root of the vectors' length; chance that a split parts a pair; pairs missed.
MARGIN, PART, MISSED = 0.16, 0.052, 0.01


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and key (the components as bytes) of the vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, v in zip(*columns(batch, "vec_id", "embedding"), strict=True):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, np.float64) + 0.0  # -0.0 and 0.0 are one
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    keys.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["vec_id", "key"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, key binary")


class Forest:
    """Directions for each tree and level, and medians for the paths that the sample reaches."""

    def __init__(self, sample: np.ndarray, size: int, leaf: int = LEAF):
        rng, d = np.random.default_rng(7), sample.shape[1]
        self.depth = max(0, int(np.ceil(np.log2(max(1, size / leaf)))))
        self.trees = max(TREES, int(np.ceil(np.log(MISSED) / np.log1p(-((1 - PART) ** self.depth))))) if self.depth else 1
        self.margin = MARGIN / d**0.5
        self.directions = rng.standard_normal((self.trees, self.depth, d))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts: list[list[dict[int, float]]] = []
        for t in range(self.trees):
            node, levels, values = np.zeros(len(sample), np.int64), [], self._values(sample, t)
            for level in range(self.depth):
                value = values[:, level]
                cut = {-1: float(np.median(value))}  # for paths with too few of the sample
                order = np.argsort(node, kind="stable")
                paths, first, n = np.unique(node[order], return_index=True, return_counts=True)
                for p, a, c in zip(paths.tolist(), first.tolist(), n.tolist(), strict=True):
                    if c >= SUPPORT:
                        cut[p] = float(np.median(value[order[a : a + c]]))
                levels.append(cut)
                node = node * 2 + (value > self._cuts(cut, node))
            self.cuts.append(levels)

    def _values(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Projections, the same for a vector whatever its neighbours in the array (a matrix product may round otherwise)."""
        return np.einsum("ij,kj->ik", x, self.directions[tree])

    @staticmethod
    def _cuts(cut: dict[int, float], node: np.ndarray) -> np.ndarray:
        paths, inverse = np.unique(node, return_inverse=True)
        return np.array([cut.get(p, cut[-1]) for p in paths.tolist()])[inverse]

    def leaves(self, x: np.ndarray, trees: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, leaf) of every leaf that each row reaches in the first `trees` trees (in all by default)."""
        out = []
        for t in range(trees or self.trees):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            values = self._values(x, t)
            for level in range(self.depth):
                away = values[row, level] - self._cuts(self.cuts[t][level], node)
                right, left = away > -self.margin, away <= self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
            out.append((row, np.full(len(row), t), node))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def close_pairs(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b whose cosine, in double precision, is at least `least`."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(a), 512):
        p, q = np.nonzero(a[at : at + 512] @ b.T >= least - 1e-12)
        sure = np.einsum("ij,ij->i", a[at + p], b[q]) >= least
        i.append(at + p[sure])
        j.append(q[sure])
    return np.concatenate(i), np.concatenate(j)


def first_shared(forest: Forest, x: np.ndarray, i: np.ndarray, j: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Whether (tree, leaf) is the first leaf that the rows i and j of x share."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    row, trees, leaves = forest.leaves(x[used], tree + 1)
    before = (trees < tree) | (leaves < leaf)
    row, code = row[before], np.unique(np.stack([trees[before], leaves[before]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(row, kind="stable")
    row, code = row[order], code[order]
    n = np.bincount(row, minlength=len(used))
    own = np.full((len(used), int(n.max(initial=0))), -1, np.int32)
    own[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = code
    other = np.where(own < 0, -2, own)
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        for column in range(own.shape[1]):
            out[at : at + len(a)] &= ~(other[b] == own[a, column, None]).any(1)
    return out


def smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near(classes: DataFrame, least: float = 0.9) -> DataFrame:
    """Rows (a, b, n) for classes (rep, key, n vectors): a links with n vectors of other classes and reaches b."""
    sizes = classes.groupBy(F.length("key").alias("w")).count().collect()  # a row for each length of vector
    rows = None
    for w, size in sizes:
        own = classes.where(F.length("key") == w).select("rep", "key", "n")
        share = min(1.0, SAMPLE / size)  # keys are distinct, so the hash deals them evenly
        picked = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("rep", "key").toPandas()
        if not len(picked):
            picked = own.select("rep", "key").limit(SUPPORT).toPandas()
        forest = Forest(unit([bytes(k) for k in picked.sort_values("rep")["key"]]), size)
        found = _near(own, forest, least)
        rows = found if rows is None else rows.union(found)
    return rows if rows is not None else classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "n").limit(0)


def _near(own: DataFrame, forest: Forest, least: float) -> DataFrame:
    def route(with_key: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    row, tree, leaf = forest.leaves(unit(columns(batch, "key")[0]))
                    out = [pa.array(tree, pa.int32()), pa.array(leaf)] + ([c.take(pa.array(row)) for c in batch.columns] if with_key else [])
                    yield pa.RecordBatch.from_arrays(out, ["tree", "leaf"] + (["rep", "key", "n"] if with_key else []))

        return run

    def compare(group: pa.Table) -> pa.Table:
        rep, n, side = (group.column(c).to_numpy() for c in ("rep", "n", "side"))
        order = np.argsort(rep, kind="stable")
        rep, n, side, x = rep[order], n[order], side[order], unit(group.column("key").to_pylist())[order]
        tree, leaf, bi, bj = (group.column(c)[0].as_py() for c in ("tree", "leaf", "bi", "bj"))
        one, two = (np.arange(len(x)),) * 2 if bi == bj else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        i, j = close_pairs(x[one], x[two], least)
        i, j = one[i], two[j]
        if bi == bj:
            i, j = i[i < j], j[i < j]
        if len(i) and forest.depth:
            first = first_shared(forest, x, i, j, tree, leaf)
            i, j = i[first], j[first]
        links = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        used = np.flatnonzero(links)
        return pa.table({"a": rep[used], "b": rep[smallest(len(x), i, j)[used]], "n": links[used].astype(np.int64)})

    counts = own.mapInArrow(route(False), "tree int, leaf long").groupBy("tree", "leaf").count()
    large = counts.where(F.col("count") > BLOCK).select("tree", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    rows = own.mapInArrow(route(True), "tree int, leaf long, rep long, key binary, n long").join(large, ["tree", "leaf"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block i meets block j in the unit (i, j), i <= j; a row of block i has side 0 there, one of block j side 1
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).select("tree", "leaf", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"), "rep", "key", "n")
    return rows.groupBy("tree", "leaf", "bi", "bj").applyInArrow(compare, "a long, b long, n long")


def cluster(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    keyed = save(usable(vectors), "vectors")
    classes = save(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    rows = save(near(classes, least), "near")
    found = components(rows.select("a", "b"))
    linked = rows.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("m"))
    known = classes.join(linked, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("key", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = keyed.join(known, "key").select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long")).exceptAll(keyed.select("vec_id")).select("vec_id", F.lit(0).cast("long"), "vec_id")
    out = good.union(rest).toDF("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
