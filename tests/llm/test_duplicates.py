"""Substring dedup, Jaccard groups, decontamination and embeddings against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np

from lumenwatch.llm import decontaminate, jaccard, neighbours, substrings
from lumenwatch.llm.fmindex import FMIndex

SPACE = re.compile("[^\x20\x09-\x0d]+")


def smallest(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    text[rng.choice(400, 30, False)] = 0
    text[-1] = 0
    index = FMIndex(text)
    for k in (1, 2, 4):
        patterns = rng.integers(1, 7, (50, k))
        for p, lo, hi in zip(patterns, *index.search(patterns), strict=True):
            want = [i for i in range(401 - k) if (text[i : i + k] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def brute_windows(rows, window):
    first, words = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            words[d] = SPACE.findall(t or "")
            for i in range(len(words[d]) - window + 1):
                w = tuple(words[d][i : i + window])
                first[w] = min(d, first.get(w, d))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(docs, rows, none, monkeypatch):
    for window, shard in ((50, substrings.SHARD_WORDS), (20, 200)):  # whole anchors in one chunk, or split over many
        monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
        want = brute_windows(rows, window)
        got = substrings.deduplicate(docs, window).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.n_removed == 0
            else:
                assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
                assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert substrings.deduplicate(none).count() == 0


def test_a_passage_twice_in_one_document_goes_twice(spark, monkeypatch):
    """Its windows start in a smaller document with other surroundings, whose segments differ."""
    part = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    p, q, twice = part("p", 60), part("q", 90), f"{part('c', 100)} {part('p', 60)} {part('d', 100)}"
    rows = [(1, f"{part('a', 100)} {p} {part('b', 100)}"), (2, f"{twice} {twice}"), (3, f"{part('e', 70)} {q}"), (4, " ".join([q, part("f", 30)] * 3)), (5, f"{part('g', 80)} {twice} {q}")]
    for window, shard in ((50, substrings.SHARD_WORDS), (50, 60), (20, 200)):
        monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
        want = brute_windows(rows, window)
        assert [want[d][1] for d in (2, 4)] == [120, 270]
        got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_rows_of_one_doc_id_lose_their_own_places_only(spark, monkeypatch):
    part = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, part("w", 60)), (2, part("w", 60)), (2, part("v", 70)), (3, f"{part('x', 40)} {part('v', 60)} {part('y', 30)}"), (3, f"{part('z', 9)} {part('v', 60)}"), (3, part("u", 55)), (3, part("u", 55))]
    want = {part("w", 60): {1: 0, 2: 60}, part("v", 70): {2: 0}, rows[3][1]: {3: 60}, rows[4][1]: {3: 60}, part("u", 55): {3: 0}}
    for shard in (substrings.SHARD_WORDS, 60):
        monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
        got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        kept = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got)
        drop = {60: lambda t: " ".join(w for w in t.split() if w[0] not in "vw"), 0: str}
        assert kept == sorted((d, len(t.split()), want[t][d], drop[want[t][d]](t)) for d, t in rows)


def test_range_minima():
    rng = np.random.default_rng(0)
    for n in (1, 15, 16, 17, 300):
        v = rng.integers(0, 99, n).astype(np.int32)
        pairs = np.array([(a, b) for a in range(n) for b in range(a + 1, n + 1)])
        assert substrings.RangeMinimum(v).of(pairs[:, 0], pairs[:, 1]).tolist() == [v[a:b].min() for a, b in pairs]


def test_shards_of_any_size_agree(rows):
    """Matching statistics of one chunk equal those by comparing windows."""
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 3, n).astype(np.uint64) for n in (9, 30, 25, 12, 30)]
    words.append(words[1][5:25])
    doc = np.array([5, 3, 9, 1, 7, 8])
    got = substrings.covered(words, doc, 6)
    for i, w in enumerate(words):
        for j in range(len(w) - 5):
            own = w[j : j + 6].tolist()
            want = any(doc[k] < doc[i] and any(x[m : m + 6].tolist() == own for m in range(len(x) - 5)) for k, x in enumerate(words))
            assert got[i][j] == want


def shingles(text, width=5):
    w = SPACE.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_jaccard_groups_equal_brute_force(docs, rows, none):
    ids = [r[0] for r in rows if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest(links, set(ids))
    got = jaccard.groups(docs).collect()
    assert len(got) == len(rows) and len(links) > 10
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert jaccard.groups(none).count() == 0


def test_order_and_fragments_do_not_change_groups(spark, rows, monkeypatch):
    few = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] is not None], "doc_id long, text string")
    want = sorted(map(tuple, jaccard.groups(few).collect()))
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "FRAGMENT", 200)
    monkeypatch.setattr(jaccard, "HELD", 300)
    monkeypatch.setattr(jaccard, "HEAVY", 100_000)  # all classes are hot
    monkeypatch.setattr(jaccard, "SENT", 2)
    assert sorted(map(tuple, jaccard.groups(few).collect())) == want


def test_rows_without_an_id_take_their_equals_component(spark):
    text = [f"w{i}" for i in range(60)]
    near = [*text[:59], "other"]
    rows = [(7, " ".join(text)), (None, " ".join(text)), (None, " ".join(near)), (None, "a b c d e f g"), (3, None)]
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 3, 0), (0, 56, 0), (0, 56, 7), (3, 0, 3), (7, 56, 7)]


def test_a_large_benchmark_is_held_in_arrays():
    """Windows of 4 MB of items: what a task holds of them, and what it finds."""
    import tracemalloc

    rng = np.random.default_rng(6)
    words = [f"w{i:05d}".encode() for i in range(20_000)]
    items = [(str(i), b" ".join(words[j] for j in rng.integers(0, len(words), 600))) for i in range(1000)]
    tracemalloc.start()
    windows = decontaminate.Windows(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(len(t) for _, t in items)
    assert size > 4e6 and peak < 16 * size and held < 8 * size
    some = items[17][1].split()
    sizes, spans, found = decontaminate.search_shard([b"x " + b" ".join(some[3:40]) + b" y", b"nothing"], windows)
    assert sizes == [39, 1] and found == [{"17"}, set()] and spans[0][0].tolist() == [1] and spans[0][1].tolist() == [38]


def test_decontamination_equals_brute_force(spark, docs, rows, none, monkeypatch):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(1, " ".join((rows[8][1]).split()[3:25])), (2, rows[3][1].upper()), (3, None), (4, "!!"), (5, rows[20][1]), (5, rows[1][1]), (None, "no such words here at all my dear friend, none whatsoever")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add("null" if i is None else str(i))
    for limit in (decontaminate.BLOCK_BYTES, 200):  # one block of items, or several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.find(docs, bench, with_text=True).collect()
        assert len(got) == len(rows)
        texts = sorted((t or "" for _, t, *_ in rows), key=lambda t: fold(t))
        assert sorted(r.n_words for r in got) == sorted(len(fold(t)) for t in texts)
        for r in (r for r in got if r.doc_id is not None):
            w = fold(dict((x[0], x[1]) for x in rows)[r.doc_id])
            hit, found = set(), set()
            for win, owners in wins.items():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        found |= owners
            assert {i for a, b in zip(r.span_starts, r.span_ends) for i in range(a, b)} == hit
            assert list(r.item_ids) == sorted(found) and fold(r.text) == [x for i, x in enumerate(w) if i not in hit]
    assert decontaminate.find(none, bench).count() == 0
    assert all(r.span_starts == [] for r in decontaminate.find(docs, bench.limit(0)).collect())


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    vectors = [base[i % 40] + rng.standard_normal(16) * s for i, s in enumerate([0.0] * 60 + [0.1] * 200 + [0.25] * 100)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 0.5]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, [1.0] * 16)]
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    links = [(i, j) for i, j in np.argwhere(near).tolist() if i < j]
    want = smallest(links, range(len(vectors)))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for block in (2048, 16):  # whole leaves, or leaves cut into blocks
        monkeypatch.setattr(neighbours.Forest.__init__, "__defaults__", (64,))
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = {r.vec_id: r for r in neighbours.cluster(df).collect()}
        found = sum(r.n_links for r in got.values()) / 2
        assert found >= 0.97 * len(links) and len(got) == len(data)
        assert np.mean([got[i].component_id == c for i, c in want.items()]) > 0.97
        assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(bad)))
    assert neighbours.cluster(df.limit(0)).count() == 0


def test_forest_keeps_pairs_together_at_depth():
    """Recall of pairs at a cosine of exactly 0.9, and copies a row, at depths of 6 and more."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base, n = unit(rng.standard_normal((12_000, 64))), 1000
    away = rng.standard_normal((n, 64))
    away = unit(away - (away * base[:n]).sum(1, keepdims=True) * base[:n])
    other = 0.9 * base[:n] + 0.19**0.5 * away
    for depth, copies in ((6, 10), (10, 25), (17, 80)):
        forest = neighbours.Forest(base, neighbours.LEAF << depth)
        assert forest.depth == depth
        one, two = ({(r, t, leaf) for r, t, leaf in zip(*map(np.ndarray.tolist, forest.leaves(x)), strict=True)} for x in (base[:n], other))
        assert len({r for r, *_ in one & two}) >= 0.98 * n and len(one) <= copies * n


def test_a_hot_cluster_counts_each_link_once(spark, monkeypatch):
    """A third of the rows are near copies: links as by brute force, and no pair leaves its task."""
    rng = np.random.default_rng(4)
    middle = rng.standard_normal(24)
    x = np.concatenate([rng.standard_normal((800, 24)), middle + 0.12 * rng.standard_normal((400, 24)), np.repeat(middle[None], 30, 0)])
    near = (u := x / np.linalg.norm(x, axis=1, keepdims=True)) @ u.T >= 0.9
    want = near.sum(1) - 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for leaf, block in ((32, 2048), (32, 50), (4096, 2048)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours.Forest.__init__, "__defaults__", (leaf,))
        got = {r.vec_id: r for r in neighbours.cluster(df).collect()}
        n = np.array([got[i].n_links for i in range(len(x))])
        assert (n <= want).all() and n.sum() >= 0.97 * want.sum()
        assert len({got[i].component_id for i in range(800, len(x))}) == 1
        if leaf == 4096:
            assert (n == want).all()
