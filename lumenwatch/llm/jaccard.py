"""N-gram Jaccard join with vertical partitioning.

All distinct shingles have one global order: those without a known high document frequency first, by
hash, then the frequent ones from rare to common. (Frequencies are counted over all documents, block by
block; they only order the shingles, so results never depend on them.) Two sets above the threshold share
a shingle among the first n - ceil(t*n) + 1 of each. The order is cut into fragments, each joined by
itself on those prefixes, so a fragment holds a bounded number of entries. A pair is a candidate if what
follows its shared entry in both sets can still reach the threshold, and if the parity bitmaps of the
two sets don't differ in more bits than similar sets can (both tests only drop pairs below it). For
candidates the whole sets are cut into PARTS vertical parts, and the partial overlaps are counted part by
part and summed per pair.

Documents with equal sets are one class before the join. Candidates come in two rounds, so that a large
group of near copies gives about one pair a member, not one for any two: first each class with the
leader of its length band for each shared shingle; then, once components are known, every pair that
shares a prefix shingle, fits in length and still lies in different components. Shingles that the same
classes hold, such as those of one shared passage, count as one there (the first of them in the global
order), and the parity test is part of the join, so texts that share some passages but aren't similar
are compared and leave no row. No link that could join two components is left out. Classes that hold more than 1 / HEAVY of the documents, or of the
pairs (at most HEAVY, or twice as many, whatever the corpus), don't meet their rows in one task: the first
are broadcast, the sets of the others go to SALTS places, and their pairs are dealt to these.

Defined cases: null, empty or wordless texts have an empty set and link with nothing; texts of fewer words
than a shingle are one shingle; repeated rows fall into one class; a row with a null doc_id takes the
component of named documents with an equal set, and is no component's smallest id; if no named document
has its set, it links with nothing and its component is null; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, columns, components, mixed, partitions, save, texts
from .tokens import tokenizer_of

#: Text bytes in a block whose frequencies are counted; least count in a block; most frequent shingles kept.
#: A shingle that b of B blocks hold twice is known, so one of frequency f is missed only while f * f is small beside 2 * B.
BLOCK_BYTES, FREQUENT, KEPT = 12 << 20, 2, 1_000_000
#: Prefix entries a fragment aims at; entries gathered before they are dealt to fragments.
FRAGMENT, HELD, PARTS, BITS = 250_000, 500_000, 4, 4096
#: Shares that make a class a hot key; places for its sets; classes whose parities a task remembers having sent.
HEAVY, SALTS, SENT = 1000, 32, 20_000
#: 64-bit words of the parities folded for the first test.
WORDS = 8


class Shingler:
    def __init__(self, width: int):
        tokenizer_of.cache_clear()  # a worker that did other work before gives its memory back
        pa.default_memory_pool().release_unused()
        self.width, self.words, self.rolling = width, WordHashes(), Rolling()

    def of(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingle hashes of one text."""
        w = self.words.of(text.lower().split())
        if len(w) >= self.width:
            return np.unique(self.rolling.grams(w, self.width))
        if not len(w):
            return w
        s = self.rolling.sums(w)
        return mixed(s[-1:] ^ np.uint64(0xA5A5 + len(w)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def class_key(u: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = u.sum(dtype=np.uint64), mixed(u ^ np.uint64(0x6A09E667F3BCC908)).sum(dtype=np.uint64)
    return int(signed(np.array([a]))[0]), int(signed(np.array([b]))[0])


def parity(u: np.ndarray) -> np.ndarray:
    """BITS parities of a set's hashes: two sets differ in at least as many shingles as their parities in bits."""
    odd = np.bincount((u >> np.uint64(52)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: doc_id, n, class key and parities (null if the task sent the class's before) of each document; kind 1: h1, n of shingles frequent in a block."""
    docs = texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, size, sent = Shingler(width), [], 0, set()
        names = ["kind", "doc_id", "n", "h1", "h2", "bits"]

        def frequent() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            u, n = u[n >= FREQUENT], n[n >= FREQUENT]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), ids), pa.array(n), pa.array(signed(u)), pa.array(np.zeros(len(u), np.int64)), pa.nulls(len(u), pa.list_(pa.int64()))], names)

        ids = pa.int64()
        for batch in batches:
            ids, text = batch.schema.types[0], columns(batch, "text")[0]
            rows, bits = [], []
            for t in text:
                u = shingles.of(t)
                rows.append((len(u), *(key := class_key(u))))
                bits.append(None if key in sent else parity(u))
                if key not in sent:  # copies are one class to the join, so they count once
                    held.append(u)
                    size += len(t)
                sent.add(key)
                if len(sent) > SENT:
                    sent.clear()
                if size >= BLOCK_BYTES:
                    yield frequent()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array(bits, pa.list_(pa.int64()))], names)
        if held:
            yield frequent()

    return docs.mapInArrow(run, f"kind int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, h1 long, h2 long, bits array<long>")


def prefix_of(u: np.ndarray, by_hash: np.ndarray, rank: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the global order, and each shingle's rank among the frequent ones (-1: none)."""
    own = np.full(len(u), -1)
    if len(by_hash):
        at = np.minimum(np.searchsorted(by_hash, u), len(by_hash) - 1)
        same = by_hash[at] == u
        own[same] = rank[at[same]]
    order = np.argsort(own, kind="stable")
    order = order[: len(u) - -(-share * len(u) // 100) + 1]
    return u[order], own[order]


def _entries(docs: DataFrame, width: int, share: int, frequent: np.ndarray, fragments: int) -> DataFrame:
    """Prefix entries, packed by fragment of the global order."""
    docs = texts(docs)
    common = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, late = Shingler(width), common.value
        order = np.argsort(late, kind="stable")
        by_hash, rank = late[order], order
        classes: dict[tuple[int, int], int] = {}
        sizes, parts, n = [], [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            h, doc, fragment, at = (np.concatenate(c) for c in zip(*parts, strict=True))
            place = np.argsort(fragment, kind="stable")
            h, doc, fragment, at = h[place], doc[place], fragment[place], at[place]
            keys = np.array([(*k, s) for k, s in zip(classes, sizes, strict=True)], np.int64)
            edges = np.flatnonzero(np.diff(fragment, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                used, local = np.unique(doc[a:b], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([int(fragment[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in (keys[used].tobytes(), signed(h[a:b]).tobytes(), local.astype(np.int32).tobytes(), at[a:b].astype(np.int32).tobytes()))], ["fragment", "classes", "shingles", "owners", "places"])

        for batch in batches:
            for t in columns(batch, "text")[0]:
                u = shingles.of(t)
                if not len(u) or (key := class_key(u)) in classes:
                    continue
                p, own = prefix_of(u, by_hash, rank, share)
                light = ((p >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
                fragment = np.where(own < 0, light, fragments + own * fragments // max(1, len(late)))
                parts.append((p, np.full(len(p), len(classes)), fragment, np.arange(len(p))))
                classes[key] = len(classes)
                sizes.append(len(u))
                n += len(p)
                if n >= HELD:
                    yield from dealt()
                    classes, sizes, parts, n = {}, [], [], 0
        if parts:
            yield from dealt()

    return docs.select("text").mapInArrow(run, "fragment int, classes binary, shingles binary, owners binary, places binary")


def _shared(entries: DataFrame, share: int, tasks: int) -> DataFrame:
    """(shingle, h1, h2, n, place, l1, l2, ln, lplace) of every prefix shingle that two classes share; l..: the leader of its length band, the class with the earliest place."""

    def joined(held: list[tuple[bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
        keys = [np.frombuffer(c, np.int64).reshape(-1, 3) for c, *_ in held]
        owner = np.concatenate([np.frombuffer(o, np.int32) + base for (_, _, o, _), base in zip(held, np.cumsum([0, *map(len, keys)])[:-1], strict=True)])
        shingle, keys = np.concatenate([np.frombuffer(h, np.int64) for _, h, *_ in held]), np.concatenate(keys)
        key = np.column_stack([keys[owner], np.concatenate([np.frombuffer(p, np.int32) for *_, p in held])])
        order = np.lexsort((key[:, 1], key[:, 0], key[:, 2], shingle))
        shingle, key = shingle[order], key[order]
        fresh = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (key[1:, :3] != key[:-1, :3]).any(1)])  # one class once
        shingle, key = shingle[fresh], key[fresh]
        start = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        n = np.diff(start, append=len(shingle))
        many = np.repeat(n > 1, n)
        shingle, key, n = shingle[many], key[many], n[n > 1]
        leader, at = np.zeros(len(shingle), np.int64), 0
        for end in np.cumsum(n).tolist():  # length bands: within one, all sizes fit with the smallest
            while at < end:
                stop = at + int(np.searchsorted(key[at:end, 2], key[at, 2] * 100 // share, side="right"))
                first = at + np.lexsort((key[at:stop, 1], key[at:stop, 0], key[at:stop, 3]))[0]
                leader[at:stop] = first
                at = stop
        return pa.RecordBatch.from_arrays([pa.array(shingle), *(pa.array(key[:, i]) for i in range(4)), *(pa.array(key[leader, i]) for i in range(4))], ["shingle", "h1", "h2", "n", "place", "l1", "l2", "ln", "lplace"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for fragment, *row in zip(*columns(batch, "fragment", "classes", "shingles", "owners", "places"), strict=True):
                if fragment != now and held:
                    yield joined(held)
                    held = []
                now = fragment
                held.append(tuple(row))
        if held:
            yield joined(held)

    return entries.repartition(tasks, "fragment").sortWithinPartitions("fragment").mapInArrow(run, "shingle long, h1 long, h2 long, n long, place long, l1 long, l2 long, ln long, lplace long")


def _parts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, part, n, shingles) of the wanted classes (rep, class): each set in PARTS vertical parts."""
    rows = texts(docs).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out = []
                for text, h1, h2 in zip(*columns(whole.slice(at, 256), "text", "h1", "h2"), strict=True):
                    u = shingles.of(text)
                    if class_key(u) == (h1, h2):  # else another row of the same doc_id
                        cut = np.searchsorted(u, np.array([i * (1 << 64) // PARTS for i in range(1, PARTS)], np.uint64))
                        out += [(h1, h2, i, len(u), signed(x)) for i, x in enumerate(np.split(u, cut))]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))))], ["h1", "h2", "part", "n", "shingles"])

    kinds = "h1 long, h2 long, part int, n long, shingles array<long>"
    return rows.select("text", "h1", "h2").mapInArrow(run, kinds).select(F.struct("h1", "h2").alias("c"), "part", "n", "shingles")


def _verified(pairs: DataFrame, parts: DataFrame, hot: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of classes whose similarity reaches the threshold: partial overlaps, summed per pair."""
    placed = _placed(parts, hot)
    left = placed.select(F.col("c").alias("a"), "part", "salt", F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = placed.select(F.col("c").alias("b"), "part", "salt", F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    each = _dealt(each, hot, "b", "a").join(right, ["b", "part", "salt"]).drop("salt")
    each = _dealt(each, hot, "a", "b").join(left, ["a", "part", "salt"])
    overlap = F.size(F.array_intersect("sa", "sb")).cast("long")
    once = each.select("a", "b", "part", "na", "nb", overlap.alias("o")).groupBy("a", "b", "part").agg(F.max("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    total = once.groupBy("a", "b").agg(F.sum("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(F.col("o") * 100 >= share * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _reaches(na: str, pa_: str, nb: str, pb: str, share: int) -> Column:
    """Whether sets whose first shared entry lies at these places can reach the threshold with all that follows."""
    return F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) * (100 + share) >= share * (F.col(na) + F.col(nb))


def _hot(pairs: DataFrame) -> DataFrame:
    """The classes c in more than 1 / HEAVY of the pairs (a, b): 2 * HEAVY at most."""
    counts = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).groupBy("c").count()
    return counts.where(F.col("count") * HEAVY > F.lit(pairs.count())).select("c")


def _dealt(pairs: DataFrame, hot: DataFrame, side: str, *columns: str) -> DataFrame:
    """pairs with salt: where to meet the class of that side, by the other columns; 0 if it isn't hot."""
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")).otherwise(0)
    return pairs.join(F.broadcast(hot.select(F.col("c").alias(side), F.lit(True).alias("_hot"))), side, "left").withColumn("salt", salt).drop("_hot")


def _placed(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """sets (c, ...) with salt: a row for each place where pairs of the class may be dealt to."""
    known = sets.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "c", "left")
    return known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))).drop("_hot")


def _near(a: Column, b: Column, total: Column, share: int) -> Column:
    """Whether parities differ in no more bits than sets of that total size that are similar can."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (total - differ) * (100 + share) >= 2 * share * total


def _alike(pairs: DataFrame, bitmaps: DataFrame, hot: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose parities differ in no more bits than similar sets can."""
    placed = _placed(bitmaps, hot)
    left, right = (placed.select(F.col("c").alias(x), "salt", F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}")) for x in "ab")
    both = _dealt(pairs, hot, "b", "a").join(right, ["b", "salt"]).drop("salt")
    both = _dealt(both, hot, "a", "b").join(left, ["a", "salt"])
    return both.where(_near(F.col("sa"), F.col("sb"), F.col("na") + F.col("nb"), share)).select("a", "b")


def _first_of_alike(placed: DataFrame) -> DataFrame:
    """The prefix shingles whose classes lie in several components; of those with the same classes, the first in the global order.

    A class counts its places in that order, so of two shingles with the same classes the earlier has the smaller places.
    """
    held = [F.bit_xor(F.xxhash64(F.lit(i), "c")).alias(f"x{i}") for i in range(2)]
    split = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.min("place").alias("place"), *held)
    return split.where("lo < hi").groupBy("m", "x0", "x1").agg(F.min(F.struct("place", "shingle")).alias("first")).select("first.shingle")


def _crossing(placed: DataFrame, bitmaps: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of classes in different components that share a prefix shingle, fit in length and place, and whose parities are near; the first WORDS words of folded parities are tested first."""
    fold = [F.expr("^".join(f"bits[{i}]" for i in range(w, BITS // 64, WORDS))).alias(f"w{w}") for w in range(WORDS)]
    rest = save(placed.join(_first_of_alike(placed), "shingle").join(bitmaps.select("c", "bits", *fold), "c"), "rest")
    one, two = (rest.select("shingle", *[F.col(x).alias(f"{y}{s}") for x, y in (("c", ""), ("n", "n"), ("place", "p"), ("component", "c"), ("bits", "s"), *((f"w{w}", f"w{w}") for w in range(WORDS)))]) for s in "ab")
    total = F.col("na") + F.col("nb")
    folded = F.expr(" + ".join(f"bit_count(w{w}a ^ w{w}b)" for w in range(WORDS)))
    fits = (F.col("ca") < F.col("cb")) & (F.least("na", "nb") * 100 >= share * F.greatest("na", "nb")) & _reaches("na", "pa", "nb", "pb", share)
    near = ((total - folded) * (100 + share) >= 2 * share * total) & _near(F.col("sa"), F.col("sb"), total, share)
    return one.join(two, (one["shingle"] == two["shingle"]) & fits & near).select("a", "b")


def groups(docs: DataFrame, width: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; two link at a Jaccard similarity of share per cent."""
    spark = docs.sparkSession
    sets = save(_sets(docs, width), "sets")
    known = sets.where("kind = 0").select("doc_id", "n", "h1", "h2")
    common = sets.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1").limit(KEPT).orderBy("n", "h1").select("h1").toArrow()
    frequent = common.column("h1").to_numpy().view(np.uint64)
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(1, total * (100 - share) // 100 // FRAGMENT)
    tasks = max(partitions(spark), 2 * fragments)
    shared = save(_shared(_entries(docs, width, share, frequent, fragments), share, tasks), "shared")
    classes = save(known.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")), "classes")
    bitmaps = sets.where("kind = 0 AND n > 0 AND bits IS NOT NULL").join(shared.select("h1", "h2").distinct(), ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    bitmaps = save(bitmaps.select(F.struct("h1", "h2").alias("c"), "n", "bits"), "bitmaps")

    def verified(pairs: DataFrame, near: bool = False) -> DataFrame:
        pairs = save(pairs.distinct(), "candidates")
        hot = save(_hot(pairs), "hot")
        pairs = pairs if near else save(_alike(pairs, bitmaps, hot, share), "pairs")
        wanted = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct().select("c.h1", "c.h2")
        parts = save(_parts(docs, wanted.join(classes.drop("docs"), ["h1", "h2"]).where("rep IS NOT NULL"), width), "parts")
        return save(_verified(pairs, parts, hot, share), "links")

    mine, leader = F.struct("h1", "h2"), F.struct(F.col("l1").alias("h1"), F.col("l2").alias("h2"))
    star = shared.where(_reaches("n", "place", "ln", "lplace", share)).select(F.least(mine, leader).alias("a"), F.greatest(mine, leader).alias("b"))
    links = verified(star.where("a <> b"))
    label = components(links)
    placed = shared.select("shingle", mine.alias("c"), "n", "place").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    links = links.unionByName(verified(_crossing(save(placed, "placed"), bitmaps, share), near=True))

    label = components(links).select("node.h1", "node.h2", "component")
    named = classes.join(label, ["h1", "h2"], "left")
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = save(named.join(smallest, "component", "left").select("h1", "h2", "docs", F.coalesce("least", "rep").alias("component_id")), "named")
    heavy = F.broadcast(named.where(F.col("docs") * HEAVY > F.lit(known.count())).select("h1", "h2", "component_id"))
    some = known.where("n > 0")
    linked = some.join(heavy, ["h1", "h2"]).unionByName(some.join(heavy, ["h1", "h2"], "left_anti").join(named.drop("docs"), ["h1", "h2"]))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(known.where("n = 0").select("doc_id", "n", "doc_id"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) c ON c.a = d.doc_id"""
