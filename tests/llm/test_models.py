"""Language identification, language-model scores, personal data and URL filters."""

import math
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from itertools import product
from urllib.parse import urljoin, urlsplit

import numpy as np
from pyspark.sql import functions as F

from lumenwatch.llm import language, lattice, pii, urls

from .conftest import SF


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    held = language.fold(5, 0)
    model = language.learn(docs.where(~held))
    rows = language.identify(docs, model, "lang").where(held).collect()
    assert len(rows) == sum(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs.collect())
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_mixtures_and_defined_cases(spark, docs, rows, none):
    texts = [("en", "the cat and the dog " * 30), ("de", "der hund und die katze " * 30)]
    model = language.learn(spark.createDataFrame(texts, "lang string, text string"))
    mixed = spark.createDataFrame([(1, texts[0][1] + texts[1][1]), (2, texts[1][1]), (3, "…123"), (4, None), (5, "")], "doc_id int, text string")
    got = {r.doc_id: r for r in language.identify(mixed, model).collect()}
    assert sorted(got[1].languages) == ["de", "en"] and 0.4 < got[1].score < 0.6
    assert got[2].languages == ["de"] and got[2].lang_pred == "de"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    empty = language.learn(none)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
    assert len(language.identify(docs, language.learn(docs), "spans").collect()) == len(rows)


def test_mixtures_equal_the_rule_written_out(spark):
    """Counts, expectation-maximisation and the choice of languages in plain loops; with null ids and repeated rows."""
    train = [("en", "the cat and the dog " * 9), ("de", "der hund und die katze " * 7), ("fr", "le chat et le chien " * 8), ("de", "noch ein satz"), (None, "not read")]
    texts = ["the hund", "le chien and the katze und der chat " * 3, "die katze " * 20, "xyz", "a", "ÄÖ straße", None, "12 !", ""]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, texts[0])]
    seen = {}
    for lang, t in train:
        if lang:
            for g in language.grams(t).tolist():
                seen.setdefault(lang, Counter())[g] += 1
    chance = {x: (lambda g, c=c, n=sum(c.values()): (c[g] + language.SMOOTHING) / (n + language.SMOOTHING * language.BUCKETS)) for x, c in seen.items()}

    def fitted(langs, grams):
        share = dict.fromkeys(langs, 1 / len(langs))
        for _ in range(language.ROUNDS if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for g in grams:
                whole = sum(share[x] * chance[x](g) for x in langs)
                for x in langs:
                    new[x] += share[x] * chance[x](g) / whole
            share = {x: v / len(grams) for x, v in new.items()}
        return share, sum(math.log(sum(share[x] * chance[x](g) for x in langs)) for g in grams)

    def told(text):
        if not text or not any(c.isalpha() for c in text):
            return ("und", 0.0, ())
        grams = language.grams(text).tolist()
        share, _ = fitted(sorted(seen), grams)
        order = sorted(seen, key=lambda x: (-share[x], x))
        best, value = fitted(order[:1], grams)
        for k in (2, 3):
            more, gain = fitted(order[:k], grams)
            if gain - value <= language.PENALTY * math.log(max(2, len(grams))):
                break
            best, value = more, gain
        first = max(best, key=lambda x: best[x])
        return (first, round(best[first], 9), tuple(sorted(best)))

    model = language.learn(spark.createDataFrame(train, "lang string, text string"))
    got = language.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9), tuple(sorted(r.languages))) for r in got) == Counter((d, *told(t)) for d, t in rows)


def all_ways(word, tokens, logs, spelled):
    """Probability of all segmentations, one by one."""
    text, total = lattice.MARK + word, 0.0
    for cuts in product((0, 1), repeat=len(text) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        p = 1.0
        for a, b in zip(edges, edges[1:]):
            part = text[a:b]
            q = math.exp(logs[tokens[part]]) if part in tokens else 0.0
            if len(part) == 1:
                q += math.exp(sum(logs[spelled[x]] for x in part.encode()))
            p *= q
        total += p
    return total


def test_marginals_sum_all_segmentations():
    path = lattice.default_path()
    logs = lattice.first_logs(path)
    model = lattice.Lattice(path, logs)
    for word in ("the", "ation", "straße", "é", "zq漢"):
        assert math.isclose(math.exp(model.marginal(word)), all_ways(word, model.pieces, logs, model.bytes), rel_tol=1e-9)
        total = np.zeros(len(logs))
        model.expect(word, 2, total)
        lengths = [0] * len(logs)
        for piece, i in model.pieces.items():
            lengths[i] = len(piece)
        plain = sum(total[i] * lengths[i] for i in model.pieces.values())
        assert plain <= 2 * (len(word) + 1) + 1e-6 and total.sum() > 0


def test_words_side_by_side_score_as_one_by_one(rows):
    path = lattice.default_path()
    logs = lattice.first_logs(path)
    words = sorted({w for r in rows for w in (r[1] or "").split()})[:400] + ["x" * 300, "a" * 199, "a" * 200, "é漢\x00z", "\U0010ffff"]
    many, one = lattice.Lattices(path, logs), lattice.Lattice(path, logs)
    assert np.allclose(many.marginals(words), [one.marginal(w) for w in words], rtol=1e-10)
    counts, got, want = np.arange(len(words)) % 5 + 1, np.zeros(len(logs)), np.zeros(len(logs))
    many.expect(words, counts, got)
    for w, c in zip(words, counts.tolist(), strict=True):
        one.expect(w, c, want)
    assert np.allclose(got, want, rtol=1e-8, atol=1e-9)


def test_scores_equal_brute_force(docs, rows, none):
    out = lattice.score(docs, ~language.fold(7, 2), passes=1).collect()
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    words = lambda t: [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
    counts = Counter(w for r in train for w in words(r[1]))
    ends = len(train)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 1) / (n + v + 1))
    want = Counter()
    for d, t, *_ in rows:
        w = words(t)
        want[d, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, round(sum(base(counts[x]) for x in w) + base(ends), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and r.score < 0 and r.lattice_score < 0 for r in out)
    assert lattice.score(none, ~language.fold(7, 2)).count() == 0
    lonely = lattice.score(docs.where("doc_id IS NOT NULL"), language.fold(1, 5)).collect()  # nothing to learn from
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lonely)


def test_score_equals_the_model_written_out(spark, monkeypatch):
    """The score of short texts by enumerating all segmentations, with the pieces' weights learnt the same way."""
    rows = [(i, t) for i, t in enumerate(["the cat sat", "a cat", "the the dog", "cow cat", "ox", None])]
    docs, train = spark.createDataFrame(rows, "doc_id int, text string"), F.col("doc_id") < 3
    path = lattice.default_path()
    words = [w for _, t in rows[:3] for w in t.split()]
    counts, logs = Counter(words), lattice.first_logs(path)
    model = lattice.Lattice(path, logs)
    total, kinds = len(words) + 3, len(counts) + 1
    total_pieces = np.full(len(logs), lattice.SMOOTHING)
    for w in counts:  # one step of expectation-maximisation, by enumeration
        text, whole = lattice.MARK + w, all_ways(w, model.pieces, logs, model.bytes)
        for cuts in product((0, 1), repeat=len(text) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
            ways = [[]]
            for a, b in zip(edges, edges[1:]):
                part = text[a:b]
                own = [[model.pieces[part]]] * (part in model.pieces) + [[model.bytes[x] for x in part.encode()]] * (len(part) == 1)
                ways = [x + y for x in ways for y in own]
            for way in ways:
                for piece in way:
                    total_pieces[piece] += math.exp(sum(logs[x] for x in way)) / whole
    total_pieces[-1] += 3 * len(counts) / len(words)
    logs = np.log(total_pieces / total_pieces.sum())
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    chance = lambda c, p: max(c - discount, 0) / total + discount * kinds / total * p
    for r in lattice.score(docs, train, passes=0).collect():
        text = dict(rows)[r.doc_id] or ""
        want = sum(math.log10(chance(counts[w], all_ways(w, model.pieces, logs, model.bytes))) for w in text.split()) + math.log10(chance(3, math.exp(logs[-1])))
        assert math.isclose(r.score, want, rel_tol=1e-9), r


def test_frequent_words_score_as_rare_ones(docs, monkeypatch):
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6))
    want = sorted(map(key, lattice.score(docs, ~language.fold(7, 2), passes=1).collect()))
    monkeypatch.setattr(lattice, "FREQUENT", 1)
    monkeypatch.setattr(lattice, "BLOCK_BYTES", 3000)
    assert sorted(map(key, lattice.score(docs, ~language.fold(7, 2), passes=1).collect())) == want


def plain(text):
    """The base patterns as they are written."""
    luhn = pii.luhn
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns(spark, docs, none):
    odd = ["a@b@c.de@f.gh", "@x.y a@", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 00000255.1.1.1", "4111-1111-1111-1111 4111 1111 1111 1112", "+1 +49 (0)30 12345-678 +123", "a..b@-.-.", "é@b.c %@d.e", "12345678901234567890 +123456789012345678"]
    texts = odd + [r.text for r in docs.collect() if r.text] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        got = [(k, a, b) for k, a, b, base in pii.candidates(t) if base]
        assert got == plain(t)


def test_redaction_and_defined_cases(spark, docs, rows, none):
    model = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    out = pii.find(docs, model, "lang").collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is not None and "555-7713" in (rows[r.doc_id][1] or ""):
            assert r.redacted.startswith("Mail [EMAIL] or [PHONE], card [CARD], host [IP] not") and [s.kind for s in r.spans] == ["email", "phone", "card", "ip"]
        elif r.doc_id is not None:
            assert r.redacted == rows[r.doc_id][1] or r.spans
    assert pii.digest(pii.find(none, pii.fit(none))).count() == 0


def test_spelled_and_unprefixed_data_is_added_and_digit_groups_stay(spark):
    """The training rows hold base spans and number groups only; none of the planted forms."""
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 9))) for _ in range(200)]
    some = lambda n: " ".join(rng.choice(words, n))
    spans = [lambda: f"{rng.choice(words)}.{rng.choice(words)}{rng.integers(99)}@{rng.choice(words)}.example.com", lambda: f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}"]
    rows = [(i, f"{some(9)} {spans[i % 2]()} {some(9)} {rng.integers(1950, 2030)} {rng.integers(1000, 9999)} {rng.integers(1000, 9999)} {some(3)}") for i in range(1200)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    mails = ["jane.doe (at) posteo (dot) org", "max[at]firma-bau[dot]de", "ann.lee {at} mail {dot} example {dot} net"]
    phones = ["212 555-7713", "646-555-2091", "312/555/8834"]
    harmless = ["1000 2000 3000 4000", "2024-03-05 2024", "12.50 13.75 14.00", "see me (at) home. then"]
    texts = [f"{some(6)} {t} {some(6)}" for t in mails + phones + harmless]
    added = [[(k, t[a:b]) for k, a, b, _ in model.added(t, pii.candidates(t))] for t in texts]
    assert added[:3] == [[("email", m)] for m in mails]
    assert added[3:6] == [[("phone", p)] for p in phones]
    assert added[6:] == [[]] * 4


def test_versions_amounts_and_mentions_stay_and_numbers_are_found_whole(spark):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    added = lambda t: [(k, t[a:b]) for k, a, b, _ in model.added(t, pii.candidates(t))]
    harmless = ["Version 10.20.30.400 is out", "gdp grew 12.345.678.901 euros", "met @ cafe.de", "1000 2000 3000 4000", "2024-03-05 2024", "order 12345678901 shipped", "build 1.2.3.20240305", "see me (at) home. then", "isbn 978-3-16-148410-0"]
    assert [added(t) for t in harmless] == [[]] * len(harmless)
    for kind, span in [("email", "jane.doe (at) example (dot) org"), ("phone", "030 901820 445"), ("card", "4111.1111.1111.1111"), ("phone", "0049 30 1234567"), ("phone", "(212) 555-0187")]:
        assert added(f"write or call {span} now") == [(kind, span)]


def test_a_text_of_many_candidates_takes_linear_time():
    model = pii.Model(np.zeros((0, 1)), np.zeros(0, bool), np.zeros(0, bool))
    model.trees = type("All", (), {"score": staticmethod(lambda x: np.zeros(len(x)))})()
    model.least = dict.fromkeys(pii.KINDS, 0.0)
    took = []
    for n in (10_000, 50_000):
        text = "".join(f"a{i}@b.org 212 555-{i:05d} x" for i in range(n))
        began = time.time()
        found = pii.candidates(text)
        assert len(model.added(text, found)) >= n and len(found) >= 2 * n
        assert len(list(pii.examples(text))) >= n
        took.append(time.time() - began)
    assert took[1] < 12 * took[0]


def test_copies_teach_once_and_the_sample_is_bounded(spark):
    rows = [(i, f"call me at +1 (212) 555-{7000 + i % 40} or mail a{i % 40}@b.org") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    all_ = pii.sample(docs).collect()
    want = {e for _, t in rows for e in pii.examples(t)}
    assert len(all_) == len(want) and Counter(r.y for r in all_) == Counter(e[4] for e in want)
    few = pii.sample(docs, 25).collect()
    assert len(few) == 25 and {r.h for r in few} == set(sorted((r.h for r in all_), key=lambda h: h & 0xFFFFFFFFFFFFFFFF)[:25])


def test_equal_scores_pass_or_fail_together():
    y = np.array([True] * 100 + [False, True])
    assert 1 < pii.least_score(y, np.array([2.0] * 100 + [1.0, 1.0])) < 2
    assert pii.least_score(np.zeros(30, bool), np.ones(30)) == np.inf


def test_trees_separate_what_thresholds_can():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 5))
    y = (x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)
    from lumenwatch.llm.boost import BoostedTrees

    assert ((BoostedTrees().fit(x[:1500], y[:1500].astype(float)).score(x[1500:]) > 0) == y[1500:]).mean() > 0.95


class Links(HTMLParser):
    """Canonical links, refreshes and the base of a page, by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.base, self.found = "", []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "base" and not self.base:
            self.base = a.get("href", "")
        if tag == "link" and a.get("rel", "").lower() == "canonical":
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "url=" in a.get("content", "").lower():
            self.found.append(re.split("url=", a["content"], flags=re.I)[1].strip())


def test_links_resolve_as_the_standard_library_resolves_them(spark):
    pages = ["http://c.net/y", "http://c.net", "https://C.net/a/b/c.html?q=1#f", "http://c.net/a/b/"]
    refs = ["/y?src=http://b.example.com/de/1", "x", "../x", "../../../x/./y/..", "?page=2", "#top", "//d.org/z", "HTTP://E.com/q", "a&amp;b=c/d", "./", "mailto:me@x.org", "javascript:void(0)", "/a//b", "x.y/../z"]
    heads = ["", '<base href="http://f.net/k/l">', "<BASE href='/up/'>"]
    forms = [lambda r: f'<link rel="canonical" href="{r}">', lambda r: f"<LINK  type=x\nhref='{r}' rel=canonical />", lambda r: f'<meta http-equiv="refresh" content="3;url={r}">']
    rows = [(p, h + f(r)) for p in pages for h in heads for f in forms for r in refs]
    rows += [("http://c.net/two", "<link rel=canonical href=/1><link rel=canonical href=/2>"), ("http://c.net/not", "<link rel=stylesheet href=/canonical><a href=x rel=canonical>")]
    want = Counter()
    for page, html in rows:
        seen = Links(html)
        for ref in seen.found:
            to = urlsplit(urljoin(urljoin(page, seen.base), ref))
            if to.scheme.lower() in ("http", "https"):
                want[page, to.netloc.lower(), to.path] += 1
    df = spark.createDataFrame([(i, p, h) for i, (p, h) in enumerate(rows)], "page_id int, url string, html string")
    got = urls.link_edges(df).select("from_url", urls.host_of(F.col("to_url")).alias("h"), urls.path_of(F.col("to_url")).alias("p")).collect()
    assert Counter(map(tuple, got)) == want


def test_unclosed_tags_take_no_longer(spark):
    html = "<link " * 200_000 + "<link rel=canonical href=/x>"
    began = time.time()
    assert urls.link_edges(spark.createDataFrame([("http://a.b/c", html)], "url string, html string")).count() == 1
    assert time.time() - began < 20


def test_block_decisions_reach_aliases(spark):
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    link = lambda u: f"<HEAD><link href='{u}' rel=\"canonical\"></HEAD>"
    pages = [
        (1, "http://A.example.net/x", link("http://b.example.com/de/1")),
        (2, "https://b.example.com/de/1?q#f", None),
        (3, "http://c.net/y", '<meta http-equiv="refresh" content="0; url=/x2">'),
        (4, "http://c.net/x2", link("http://a.example.net/x")),
        (12, "http://h.net/y", link("/y?src=http://b.example.com/de/1")),
        (5, "http://d.net/z", link("http://e.org/ok")),
        (6, "http://d.net/z#again", link("http://b.example.com/de/9")),
        (7, None, None),
        (8, "no scheme", "<link rel=canonical href=http://b.example.com/de/1>"),
        (9, "http://www.example.org/en/12", ""),
        (10, "http://sub.fr.example.com/fr/", ""),
        (11, "http://lonely.net", ""),
        (11, "http://lonely.net", ""),
        (None, "http://example.org/es/", None),
    ]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, verdict string")
    moved = spark.createDataFrame([("http://lonely.net", "http://b.example.com/de/1")], "from_url string, to_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert got == {1: (None, "block"), 2: ("com/de/", "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: ("example.org/en/1", "block"), 10: ("com/fr/", "allow"), 11: (None, "allow"), 12: (None, "allow"), None: ("example.org/es/", "block")}
    again = urls.judge(df, rules, moved).collect()
    assert [r.verdict for r in again if r.page_id == 11] == ["block", "block"] and len(again) == len(pages)
    assert urls.judge(df.limit(0), rules).count() == 0


def test_all_examples_teach_and_parts_give_the_model_of_the_whole(spark, monkeypatch):
    """More examples than the former sample of 20,000 held: each counts, and sums over partitions are those of one piece."""
    from lumenwatch.llm.boost import BoostedTrees

    phone = lambda i: f"call +1 ({200 + i % 700}) 555-{1000 + i // 700} or mail u{i}@b{i % 9}.org, room {i % 97} {i} {i * 7}"
    docs = spark.range(9000).rdd.map(lambda r: (r.id, phone(r.id))).toDF("doc_id long, text string").repartition(3)
    assert pii.sample(docs).count() > 20_000
    monkeypatch.setattr(pii, "BoostedTrees", lambda: BoostedTrees(rounds=2))
    seen, of = [], pii.Model.of.__func__
    monkeypatch.setattr(pii.Model, "of", classmethod(lambda cls, total: seen.append(int(total(lambda p: p.n.sum(keepdims=True))[0])) or of(cls, total)))
    whole = pii.fit(docs)
    monkeypatch.setattr(pii, "FEW", 0)
    parts = pii.fit(docs)
    assert seen == [pii.sample(docs).count()] * 2
    assert whole.least == parts.least and all(np.array_equal(a, b) for x, y in zip(whole.trees.trees, parts.trees.trees, strict=True) for a, b in zip(x, y, strict=True))
