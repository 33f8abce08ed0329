"""Personal data: candidate spans, boosted trees, calibrated thresholds.

Base spans come from fixed patterns and always stay. High-recall generators propose further spans, which
may overlap: failed base matches, spelled-out e-mail addresses, numbers in other groupings. Boosted trees
score each candidate by its format and its context. They learn from all documents' distinct examples (copies
teach once): equal ones in all features are one row with a count, and a level of a tree takes sums over these rows where they lie. Positives are base spans, and base spans rewritten in
their own context as only the generators find them: spelled out, without prefix, with 00 or a trunk 0, in
brackets or other groupings. Negatives are failed tests, number groups that no word before them explains, and
harmless text (dates, amounts, versions, a word @ a place) put in a base span's place. Numbers that begin with 00 are no cards. A generator's other proposals are left out, as nothing says what they are. The threshold of
each kind is the least score, in steps of 1 / STEPS, from which PRECISION of the non-base examples of a held-out fifth (every fifth by hash) is
positive; equal scores count together, and those at the threshold must be as precise themselves. A kind with
fewer than LEAST held-out positives, or fewer than 50 examples in all, has no threshold and gets no additions.
Candidates that reach it and touch no base span are added, best first, without overlap. The work on a text
grows with its length, whatever the number of its candidates.

Offsets are code points, end exclusive. Defined cases: null or empty text has no spans; documents without
any candidates give base spans only, and so do examples without both classes; a repeated row gives its
spans each time; an empty table gives no rows; a null doc_id is kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boost import TOP, BoostedTrees, Part
from .common import columns, save

KINDS = ("email", "ip", "card", "phone")
PRECISION, LEAST = 0.99, 20
#: Scores count in steps of 1 / STEPS, from -REACH to REACH; so many rows of examples are learnt from in one piece.
STEPS, REACH, FEW = 1024, 32, 50_000
ANY = re.compile("[0-9@]|\\bat\\b", re.I)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match that started inside a number would fail as its start does
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED = re.compile(r"(?<!\S)[A-Za-z0-9._%+-]{2,64} ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{2,24})+", re.I)
GROUPED = re.compile(r"\([0-9]{1,5}\) ?[0-9][0-9 ().\-/]{3,30}[0-9]|[0-9][0-9 ().\-/]{7,30}[0-9]")
WORDS = [re.compile(p, re.I) for p in (r"mail", r"\bip\b|server|addr", r"card|visa|pay|konto|tarjeta|carte", r"tel|phone|call|mobil|fon")]
ENDINGS = frozenset("com org net edu gov mil int info biz name app dev example test online site shop cloud tech xyz".split())
SENTENCE = re.compile(r"\. ")
#: Harmless text for a base span's place.
PLAIN = ["{y}-0{a}-1{b} 11{c}{d}", "{y} {y} 20{a}{b}", "{a}000 {b}000 {c}000", "{a}{b}.50 {c}{d}.75 1{a}.00", "{y}/{y} 20{b}{c}", "0.{a}25 0.{b}50 0.{c}75", "1{a}-2{b} 3{c}-4{d} 5{a}-6{b}", "1{a}.2{b}.3{c}.{d}00", "1{a}.3{b}5.6{c}8.9{d}1", "{a}.{b}.{c}.2{d}{y}", "{a}{b}3.{c}45.{d}12", "{a}.{b}.{c}.{y}0{d}05"]
#: Doubled digits for the Luhn sum.
DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(DOUBLED[x] for x in d[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a match holds one @, so each @ is tried with the longest local part since the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """The base patterns' matches and whether each passes its test."""
    out = [("email", a, b, True) for a, b in emails(text)]
    out += [("ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in IP.finditer(text)]
    out += [("card", *m.span(), 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)) for m in CARD.finditer(text)]
    out += [("phone", *m.span(), 10 <= len(digits_of(m[0])) <= 15) for m in PHONE.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """kind, start, end, base: base spans and every generator's proposals, sorted by start, kind and end."""
    if not ANY.search(text):
        return []
    found: dict[tuple[str, int, int], bool] = {}
    for kind, a, b, good in matches(text):
        if good or b - a >= 7:
            found[kind, a, b] = good
    for m in SPELLED.finditer(text):
        found.setdefault(("email", *m.span()), False)
    for m in GROUPED.finditer(text):
        digits = digits_of(m[0])
        for kind, low, high in (("phone", 9, 15), ("card", 13, 19)):
            if low <= len(digits) <= high and not (kind == "card" and digits.startswith("00")):  # no card starts so
                found.setdefault((kind, *m.span()), False)
    return sorted(((*k, v) for k, v in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of one candidate."""
    span, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    digits = digits_of(span)
    parts = [p for p in re.split(r"[^0-9]+", span) if p]
    edge = lambda c: 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
    return [
        KINDS.index(kind), b - a, len(digits), len(parts), max(map(len, parts), default=0), float(bool(digits) and luhn(digits)),
        float(len(parts) == 4 and max((int(p[:6]) for p in parts), default=999) <= 255), float(span[0] == "+"), float(digits.startswith("00")), float(len(set(map(len, parts[1:]))) == 1), float("(" in span), span.count("."), span.count(" "), span.count("-"),
        span.count("@"), float("[" in span or "{" in span or "(at" in span.lower()), edge(before[-1:]), edge(after[:1]), float(before[-1:] in "=#:\"'" and bool(before)),
        *(float(bool(w.search(before))) for w in WORDS), len(set(digits)),
        float(len(top := re.split(r"[^A-Za-z]", span)[-1] or re.split(r"[^A-Za-z]+", span.rstrip(")]}"))[-1]) == 2 or top.lower() in ENDINGS), float(bool(SENTENCE.search(span))),
        min(map(len, parts), default=0), len(parts[0]) if parts else 0, float(bool(parts) and len(parts[0]) == 4 and parts[0][:2] in ("19", "20")),
    ]


def label(text: str, kind: str, a: int, b: int, base: bool) -> bool | None:
    """Whether a candidate is personal data, as far as its text says; None where it may be either."""
    if base:
        return True
    if kind == "ip" or kind == "phone" and text[a] == "+" or kind == "card" and not (13 <= len(d := digits_of(text[a:b])) <= 19 and luhn(d)):
        return False
    return None if kind == "email" or WORDS[KINDS.index(kind)].search(text[max(0, a - 40) : a]) else False


def grouped(digits: str, sep: str) -> str:
    head = len(digits) - 7
    return sep.join([*filter(None, [digits[: max(0, head - 3)]]), digits[max(0, head - 3) : head], digits[head:-4], digits[-4:]])


def rewritten(kind: str, span: str, words: list[str]) -> list[tuple[str, bool]]:
    """A base span as only a generator finds it, and something harmless for its place; which forms, its hash says."""
    h = zlib.crc32(span.encode())
    digits, pick = digits_of(span), lambda *x: x[h // 16 % len(x)]
    a, b, c, d = (h >> k & 7 for k in (3, 7, 11, 17))
    plain = PLAIN[h % len(PLAIN)].format(y=1950 + h // 8 % 80, a=a + 1, b=b + 1, c=c + 1, d=d + 1)
    if kind == "email":
        local, domain = span.split("@")
        if h & 1:  # other addresses than this table's
            local, domain = re.sub("[0-9]", "", local).strip("._%+-") or local, re.sub("[0-9]", "", domain)
        if h & 2:
            domain = ".".join([*domain.split(".")[-2:-1], pick("com", "org", "net", "de", "fr", "es")])
        at = pick("(at)", "[at]", "{at}", " (at) ", " [at] ", " {at} ", " @ " if re.search("[0-9._%+-]", local) else "(at)", " (AT) ")  # a bare word @ a place may be either
        dot = (".", f" {at.strip()[0]}dot{at.strip()[-1]} ", f"{at.strip()[0]}dot{at.strip()[-1]}")[0 if "@" in at else h % 3]
        one, two, three = (words[(h >> k) % len(words)] for k in (2, 9, 15)) if words else ("see", "home", "then")
        place = f"{one} @ {two}.{pick('de', 'com', 'net')}" if h % 5 == 0 else f"{one}{pick(' (at) ', ' @ ', ' [at] ')}{two}. {three}"
        return [(local + at + domain.replace(".", dot), True), (place, False)]
    if kind == "phone":
        rest = re.sub(r"^[0-9]{1,3}[ .-]+", "", span[1:])
        national = rest if len(digits_of(rest)) >= 9 else span[1:]
        own = digits_of(national)
        sep, trunk = pick(" ", "-", ".", "/"), f"0{own[:2]} {own[2:-3]} {own[-3:]}"
        abroad = ("00" + span[1:], f"00{20 + h // 64 % 79}{pick(' ', '-', '')}{own[:2]}{pick(' ', '-')}{own[2:]}")[h // 8 % 2]
        forms = (span[1:], national, grouped(digits, sep), grouped(own, sep), abroad, trunk, f"({own[:-7]}) {own[-7:-4]}{pick('-', ' ')}{own[-4:]}")
        return [(forms[h % 7], True), (plain, False)]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = [*fours[:-1], fours[-1][:-1] + str((int(digits[-1]) + 1 + h % 9) % 10)]
        return [(pick(".", "/", "  ", " - ").join(fours), True), (pick(".", "/", "  ", " - ").join(wrong), False)]
    return []


class Taken:
    """Which characters of a text spans hold."""

    def __init__(self, text: str, found: list[tuple[str, int, int, bool]]):
        self.marks = bytearray(len(text))
        for _, a, b, base in found:
            if base:
                self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.marks[a:b] = b"\1" * (b - a)

    def free(self, a: int, b: int) -> bool:
        return self.marks.find(1, a, b) < 0


def examples(text: str) -> Iterator[tuple[str, int, int, str, bool, bool]]:
    """Text around it, start, end, kind, label and base of everything that a text can teach."""
    found = candidates(text)
    if not found:
        return
    taken = Taken(text, found)
    for kind, a, b, base in found:
        good = label(text, kind, a, b, base)
        before, after = text[max(0, a - 40) : a], text[b : b + 20]
        if good is not None and (base or taken.free(a, b)):  # what touches a base span is never added
            yield before + text[a:b] + after, len(before), len(before) + b - a, kind, good, base
        if base:
            words = re.findall(r"[A-Za-z]{3,24}", before + after)
            for span, good in rewritten(kind, text[a:b], words):
                other = before + span + after
                for k, x, y, own in candidates(other):
                    if not own and len(before) <= x and y <= len(before) + len(span):
                        yield other, x, y, k, good and k == kind, False


def sample(docs: DataFrame, size: int | None = None) -> DataFrame:
    """All distinct examples: hash, features (a byte each, TOP at most), whether each is personal data and whether it is a base span. With a size, those of the smallest hashes, for a look at them."""
    kinds = [("text", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("y", pa.bool_()), ("base", pa.bool_())]

    def taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for text in columns(batch, "text")[0] for r in examples(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [shown([features(t, k, a, b)]).tobytes() for t, k, a, b in zip(*columns(batch, "text", "kind", "a", "b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("h")), pa.array(x, pa.binary()), *(batch.column(batch.schema.get_field_index(n)) for n in ("y", "base"))], ["h", "x", "y", "base"])

    rows = docs.select("text").mapInArrow(taught, "text string, a int, b int, kind string, y boolean, base boolean")
    found = rows.distinct().withColumn("h", F.xxhash64(*rows.columns))
    if size is not None:
        found = found.orderBy(F.shiftrightunsigned("h", 32), "h").limit(size)
    return found.mapInArrow(described, "h long, x binary, y boolean, base boolean")


def folded(found: DataFrame) -> DataFrame:
    """The examples with held: every fifth by hash. Counts by its first 16 bits give where a slot begins, so no task puts all of them in order."""
    rows = found.withColumn("_slot", F.shiftrightunsigned("h", 48))
    slots = rows.groupBy("_slot").agg(F.count("*").alias("_n"))  # 65,536 rows at most
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("_slot").orderBy(F.shiftrightunsigned("h", 32), "h"))
    ranked = rows.withColumn("_inner", inner).join(F.broadcast(slots.select("_slot", before.alias("_before"))), "_slot")
    return ranked.withColumn("held", F.pmod(F.col("_before") + F.col("_inner") - 1, F.lit(5)) == 0).drop("_slot", "_inner", "_before")


def shown(x: list[list[float]]) -> np.ndarray:
    """Features as the trees see them."""
    return np.minimum(np.array(x, float), TOP).astype(np.uint8)


def least_score(right: np.ndarray, score: np.ndarray, n: np.ndarray | None = None) -> float:
    """Halfway below the least score from which PRECISION of the examples, and of those of that score, are positive; n: how often each occurs."""
    n = np.ones(len(score)) if n is None else n
    values, group = np.unique(-score, return_inverse=True)
    hits, n = np.bincount(group, right * n, len(values)), np.bincount(group, n, len(values))
    good = np.flatnonzero((hits.cumsum() >= PRECISION * n.cumsum()) & (hits.cumsum() >= LEAST) & (hits >= PRECISION * n))
    return float(-values[good[-1] : good[-1] + 2].mean()) if len(good) else np.inf


def stepped(score: np.ndarray) -> np.ndarray:
    """The step of each score, from 0 to 2 * REACH * STEPS."""
    return np.rint((np.clip(score, -REACH, REACH) + REACH) * STEPS).astype(np.int64)


class Model:
    """Trees and, for each kind, the score from which a candidate is personal data. total adds up what a function gives of each Part of the rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, base: np.ndarray):
        self.learn(Part(x.astype(np.uint8), y, base, np.arange(len(y)) % 5 == 0, np.ones(len(y), np.int64)).total)

    @classmethod
    def of(cls, total: Callable[[Callable[[Part], np.ndarray]], np.ndarray]) -> Model:
        model = cls.__new__(cls)
        model.learn(total)
        return model

    def learn(self, total: Callable[[Callable[[Part], np.ndarray]], np.ndarray]) -> None:
        self.trees, self.least = None, dict.fromkeys(KINDS, np.inf)
        n, good, train, right = total(lambda p: np.array([(p.n * k).sum() for k in (np.ones(len(p.y), bool), p.y, ~p.held, p.y & ~p.held)], np.int64)).tolist()
        if n < 50 or good in (0, n) or right in (0, train):
            return
        counts = total(lambda p: p.values())
        trees = BoostedTrees().begin([(np.flatnonzero(c), c[c > 0]) for c in counts], right / train).grow(total)
        wide = 2 * REACH * STEPS + 1

        def by_score(p: Part) -> np.ndarray:
            use = p.held & ~p.base
            return np.bincount((p.x[use, 0].astype(np.int64) * 2 + p.y[use]) * wide + stepped(trees.score(p.x[use])), p.n[use], 2 * len(KINDS) * wide).astype(np.int64)

        held = total(by_score).reshape(len(KINDS), 2, wide)
        for kind, (bad, good) in zip(KINDS, held, strict=True):
            some = np.flatnonzero(bad + good)
            self.least[kind] = least_score(np.repeat([False, True], len(some)), np.tile(some / STEPS - REACH, 2), np.concatenate([bad[some], good[some]]))
        self.trees = trees

    def added(self, text: str, found: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, float]]:
        """Candidates to add to the base spans, with their probability."""
        if self.trees is None:
            return []
        taken = Taken(text, found)
        rest = [(k, a, b) for k, a, b, base in found if not base and taken.free(a, b)]
        if not rest:
            return []
        out, score = [], stepped(self.trees.score(shown([features(text, *r) for r in rest]))) / STEPS - REACH
        for i in np.argsort(-score, kind="stable"):
            k, a, b = rest[i]
            if score[i] >= self.least[k] and taken.free(a, b):
                taken.add(a, b)
                out.append((k, a, b, float(1 / (1 + np.exp(-score[i])))))
        return out


def fit(docs: DataFrame) -> Model:
    """The model of all documents' distinct examples: up to FEW rows in one piece, more of them by sums over Spark's partitions; the model is the same."""
    rows = save(folded(save(sample(docs), "examples")).groupBy("x", "y", "base", "held").agg(F.count("*").alias("n")), "taught")

    def part(batch: pa.RecordBatch | pa.Table) -> Part:
        x, y, base, held, n = (batch.column(c).to_pylist() for c in ("x", "y", "base", "held", "n"))
        return Part(np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1 if x else 0), *(np.array(c, bool) for c in (y, base, held)), np.array(n, np.int64))

    def total(f: Callable[[Part], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = sum(f(part(b)) for b in batches if b.num_rows)
            flat = np.ravel(out)
            used, shape = np.flatnonzero(flat), np.shape(out)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(flat[used], pa.int64()), pa.array([list(shape)] * len(used), pa.list_(pa.int64()))], ["slot", "n", "shape"])

        found = rows.mapInArrow(run, "slot long, n long, shape array<long>").groupBy("slot").agg(F.sum("n").alias("n"), F.first("shape").alias("shape")).collect()  # a sum a node, feature and bin, or a step of the score
        shape = found[0].shape
        out = np.zeros(int(np.prod(shape)), np.int64)
        out[[r.slot for r in found]] = [r.n for r in found]
        return out.reshape(shape)

    if rows.limit(FEW + 1).count() <= FEW:
        return Model.of(part(rows.toArrow()).total)
    return Model.of(total)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def find(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, spans (sorted by start and kind) and redacted, the text with each span as [KIND]."""
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            spans, clean = [], []
            for text in columns(batch, "text")[0]:
                found = candidates(text or "")
                own = [(k, a, b, True, 1.0) for k, a, b, base in found if base]
                own += [(k, a, b, False, p) for k, a, b, p in model.added(text, found)] if len(own) < len(found) else []
                own.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                spans.append([dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in own])
                clean.append(redacted(text, own))
            rest = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(spans, kind), pa.array(clean, pa.string())], [*names, "spans", "redacted"])

    rows = docs.select(*dict.fromkeys([*names, "text"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, spans {SPANS}, redacted string")


def redacted(text: str | None, spans: list[tuple]) -> str | None:
    """The text with each span replaced by its kind; spans that overlap become one, named after the first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
