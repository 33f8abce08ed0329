"""Line dedup, importance resampling and ranked search against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumenwatch.llm import lexical, lines, resample
from tests.llm.conftest import SF

RUNS, TERMS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id string, n long"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(rows, least, documents):
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= least and d is not None:
                holders[k].add(d)
    out = []
    for d, t, *_ in rows:
        own = (t or "").split("\n")
        gone = [d is not None and len(holders[key(x)]) >= documents and min(holders[key(x)]) != d for x in own]
        kept = "\n".join(x for x, g in zip(own, gone, strict=True) if not g)
        out.append((d, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


LINES = [
    (1, "Shared Line one\nshort\nown of one\r\nééééééééé"),
    (2, "  shared line ONE\t\nshort\nShared Line one\nleft"),
    (3, "é" * 9 + "\nÉ" * 3 + "\n\x0bshared line one\x0c\nown of ONE"),
    (4, None), (5, ""), (6, "\n\n"), (7, "Shared Line one"), (7, "own of one\nother"), (None, "shared line one"), (None, None),
    (8, "é" * 10), (9, "x\n" + "é" * 10 + "\nlast"),
]


@pytest.mark.parametrize(("least", "documents"), [(10, 2), (10, 3), (1, 2)])
def test_lines(spark, rows, least, documents):
    data = [*LINES, *((None if d is None else d + 100, t) for d, t, *_ in rows), *((i, "the common line of all\n" + "x" * i) for i in range(300, 360))]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in data], "doc_id long, text string, a int, keeper string")
    got = sorted(map(tuple, lines.deduplicate(docs, least, documents).collect()), key=repr)
    assert got == brute_lines(data, least, documents)


def test_hot_lines_are_broadcast_and_cold_ones_joined(spark, monkeypatch):
    monkeypatch.setattr(lines, "HEAVY", 3)
    data = [(i, f"a line that half of all hold\nline of {i // 2} two documents\nown line of {i}") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, lines.deduplicate(docs).collect()), key=repr) == brute_lines(data, 10, 2)


def test_line_dedup_of_nothing(none):
    assert lines.deduplicate(none).collect() == []


def features(text):
    w = RUNS.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(rows, target, share=5, least=20):
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    many, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (many + 10000.0) / ((s[b] + 1.0) * (wanted + 10000.0))))
    out = []
    for d, text, *_ in rows:
        w, f = features(text)
        weight, score = sum(map(gain, f)), None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((d, len(w), len(f), weight, score))
    able = sorted((r for r in out if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    ranks = {(*r, i): i + 1 for i, r in enumerate(able[: share * len(able) // 100])}
    drawn = Counter(r[:5] for r in ranks)
    return Counter(out), drawn, sorted((v, *r[:5]) for r, v in ranks.items())


@pytest.mark.parametrize("share", [5, 50])
def test_resampling(spark, docs, rows, share):
    target = ["abc de Abc de", None, rows[9][1], "", "x" * 5000]
    items = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(target)], ITEMS)
    found = [tuple(r) for r in resample.resample(docs, items, share).collect()]
    every, _, ranked = brute_resample(rows, target, share)
    assert Counter(r[:5] for r in found) == every
    assert sorted((r[5], *r[:5]) for r in found if r[5] is not None) == ranked
    chosen = resample.draw(docs, items, share=share)
    assert chosen.columns == docs.columns
    assert {r[0] for r in chosen.select("doc_id").collect()} == {r[1] for r in ranked}


def test_runs_of_words_hash_as_their_joined_bytes():
    long = b"w" * 300
    texts = [b"a bc \xc3\xa9d " + long + b" z " + long + b" " + long, b"", b"one"]
    n, runs = resample.Hasher(4, 10_000).of(texts)
    got = sorted((int(o), int(b)) for owner, bucket in runs for o, b in zip(owner, bucket, strict=True))
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        want += [(i, zlib.crc32(b" ".join(w[a : a + k])) % 10_000) for k in range(1, 5) for a in range(len(w) - k + 1)]
    assert got == sorted(want) and n.tolist() == [7, 0, 1]


def test_planes_sum_exactly():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 1000):
        counts, gain = rng.integers(0, 5000, (7, n)), rng.integers(-9000, 9000, n)
        counts[0] = 0
        assert (resample.weights(counts, *resample.signed_planes(gain)) == counts @ gain).all()
    assert (resample.weights(counts, *resample.signed_planes(np.zeros(1000, np.int64))) == 0).all()


def test_resampling_of_nothing(spark, docs, none):
    items = spark.createDataFrame([], ITEMS)
    assert resample.resample(none, items).collect() == []
    found = resample.resample(docs, items, 100).collect()
    assert len(found) == docs.count() and any(r["rank"] == 1 for r in found)


def brute_search(rows, items, top):
    bag = [(d, Counter(TERMS.findall((t or "").translate(LOWER)))) for d, t, *_ in rows]
    bag = [(d, b) for d, b in bag if b]
    total = sum(sum(b.values()) for _, b in bag)
    df = Counter(w for _, b in bag for w in b)
    wanted = defaultdict(set)
    for i, t, *_ in items:
        if i is not None:
            wanted[i] |= set(TERMS.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, b in bag:
            m = 100 - 50 + 50 * sum(b.values()) * len(bag) // total
            score = sum(math.floor(1000 * math.log((2 * len(bag) + 2) / (2 * df[w] + 1))) * (1000000000 * b[w] // (1000 * b[w] + 20 * m)) for w in terms if w in b)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("top", "size", "blocks"), [(50, 1024, 10_000), (3, 2, 2), (1, 1024, 3)])
def test_search(spark, docs, rows, monkeypatch, top, size, blocks):
    monkeypatch.setattr(lexical, "MOST", size)
    monkeypatch.setattr(lexical, "ITEMS", blocks)
    words = rows[9][1].split()
    items = [(i, " ".join(words[i * 7 : i * 7 + 9]), "clash", i) for i in range(8)]
    items += [(3, words[200], "", 0), (20, None, "", 0), (21, "", "", 0), (22, "nowhere 漢字", "", 0), (None, words[0], "", 0), (23, rows[8][1].upper(), "", 0), (24, " ".join(words), "", 0)]
    copies = [(d + 1000 * c, rows[8][1], None, None, None, None, None) for c in range(1, 70) for d in (0,)]
    data = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    got = sorted(map(tuple, lexical.search(data, spark.createDataFrame(items, ITEMS), top).collect()))
    assert got == brute_search([*rows, *copies], items, top)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame([(1, "abc", "", 0)], ITEMS)
    assert lexical.search(none, items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(none, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("name", ["op11_bitsliced_resampling", "op12_line_dedup", "op13_bag_lexical_search"])
def test_query_equals_sql(spark, name):
    from lumenwatch.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(map(tuple, found.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
