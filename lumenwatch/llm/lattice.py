"""Language-model scores from a lattice of subwords.

The model draws pieces of an existing vocabulary (its ids and scores are given; nothing is tokenized or
merged anew) until it draws the end. A text's probability is the sum over all its segmentations: words
start with the vocabulary's word mark and no piece crosses a word, so it is the product of the words'
marginals, each by a forward recursion in log space. A character can also be spelled in byte pieces.

The existing scores are ranks; read as a Zipf law, 1 / (2 - score), they are the first piece
probabilities. Expectation-maximisation over the lattices of all distinct training words then re-weights
them: each word teaches once, whatever its count, as pieces are there for words that training didn't hold.
The first PASSES steps go over disjoint shares of the words, one after the other, the last over all words.
The driver gets one number for each piece.

A word seen in training is also one whole piece of the lattice: its last place has one arc more, from the
start, with the word's discounted share of the training tokens, (c - D) / N. The mass that this leaves,
D * V / N, goes to the vocabulary's pieces. D = n1 / (n1 + 2 * n2) follows from the words seen once and
twice (absolute discounting; a half without any). lattice_score leaves these arcs out.

Word counts are the only table that grows with the corpus. Words that make up more than 1 / FREQUENT of
all tokens (at most FREQUENT words, whatever the corpus) are scored where the documents are; all others
meet their words' scores in buckets of the word's hash, packed by blocks of documents.

Defined cases: null or empty text is the end alone; without training documents all counts are 0 and the
first probabilities stand; a null doc_id is a training document; repeated rows are counted and scored
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, columns, partitions, save

FREQUENT, SMOOTHING, PASSES, MARK = 400_000, 0.1, 4, "▁"
FLUSH, BLOCK_BYTES, BUCKET_WORDS = 300_000, 8 << 20, 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], list[int], np.ndarray, int]:
    """Pieces' numbers, the 256 byte pieces' numbers, first log weights, and the longest piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
    raw = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
    weight = np.array([-np.log(2.0 - min(0.0, model.get_score(i))) for i in range(size)])
    return plain, [raw[f"<0x{b:02X}>"] for b in range(256)], weight, max(map(len, plain))


def with_whole_words(c: np.ndarray, lp: np.ndarray, total: int, kinds: int, discount: float) -> np.ndarray:
    """The forward recursion's last step once the whole-word arc is added to each word's marginal."""
    if not total:
        return lp
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(c - discount, 0) / total), np.log(discount * kinds / total) + lp)


class Lattice:
    """All segmentations of words, with one log probability for each piece (and the end's, last)."""

    def __init__(self, path: str, logs: np.ndarray):
        self.pieces, self.bytes, _, self.longest = vocabulary(path)
        self.logs = logs.tolist()

    def arcs(self, word: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each place after the first, its incoming arcs: where from, which pieces, log probability."""
        text, get, logs, longest = MARK + word, self.pieces.get, self.logs, self.longest
        out = []
        for end in range(1, len(text) + 1):
            own = []
            for start in range(max(0, end - longest), end):
                piece = get(text[start:end])
                if piece is not None:
                    own.append((start, (piece,), logs[piece]))
            spelled = tuple([self.bytes[b] for b in text[end - 1].encode("utf-8", "replace")])
            own.append((end - 1, spelled, sum([logs[b] for b in spelled])))
            out.append(own)
        return out

    @staticmethod
    def forward(arcs: list[list[tuple[int, tuple[int, ...], float]]]) -> list[float]:
        """Log probability of all ways to each place; the last is the word's marginal."""
        alpha = [0.0]
        for own in arcs:
            terms = [alpha[a] + p for a, _, p in own]
            top = max(terms)
            alpha.append(top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top)
        return alpha

    def marginal(self, word: str) -> float:
        return self.forward(self.arcs(word))[-1]

    def expect(self, word: str, n: int, total: np.ndarray) -> None:
        """Add n times the expected number of each piece in the word."""
        arcs = self.arcs(word)
        alpha = self.forward(arcs)
        beta = [-1e300] * len(alpha)
        beta[-1] = 0.0
        whole = alpha[-1]
        for end in range(len(arcs), 0, -1):
            after = beta[end]
            for start, pieces, p in arcs[end - 1]:
                share = exp(alpha[start] + p + after - whole)
                for piece in pieces:
                    total[piece] += n * share
                t = p + after
                b = beta[start]
                beta[start] = t if b < -1e299 else (b + log(1 + exp(t - b)) if b > t else t + log(1 + exp(b - t)))


class Lattices:
    """The same recursions over many words side by side: words of like length share each numpy step.

    Pieces are found by the hash of each substring, so no Python runs for a single word. Words longer than
    LONG go through Lattice one by one; both give the same numbers (tests compare them).
    """

    LONG, CELLS, NEVER, FACTOR, PAD = 200, 40_000, -1e30, np.uint64(0x9E3779B97F4A7C15), 0x110000

    def __init__(self, path: str, logs: np.ndarray):
        self.single, self.logs = Lattice(path, logs), np.append(logs, self.NEVER)
        pieces = list(self.single.pieces)
        hashes = np.zeros(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(self.FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array([self.single.pieces[pieces[i]] for i in order], np.int32)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._slot(self.hashes)] = True
        self.powers = np.ones(self.single.longest + 1, np.uint64)
        np.multiply.accumulate(np.full(len(self.powers) - 1, self.FACTOR), out=self.powers[1:])
        self.spelled: dict[int, float] = {}

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD1342543DE82EF95) >> np.uint64(42)).astype(np.int64)

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1, the place of NEVER."""
        out = np.full(h.shape, -1, np.int32)
        maybe = np.nonzero(self.filter[self._slot(h)])
        own = h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == own, self.numbers[at], -1)
        return out

    def groups(self, words: list[str]) -> Iterator[np.ndarray]:
        """Numbers of words of like length, as many as fit CELLS characters."""
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(n, kind="stable")
        order = order[n[order] <= self.LONG]
        while len(order):
            size = int(np.searchsorted(np.arange(1, len(order) + 1) * n[order], self.CELLS, side="right"))
            yield order[: max(1, size)]
            order = order[max(1, size) :]

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, characters, pieces by (word, end, length - 1), and the log probability of each character in bytes."""
        texts = [MARK + w for w in words]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(n.max())
        chars = np.full((len(texts), width), self.PAD, np.uint32)
        chars[np.arange(width) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        sums = np.zeros((len(texts), width + 1), np.uint64)
        for j in range(width):
            sums[:, j + 1] = sums[:, j] * self.FACTOR + chars[:, j] + np.uint64(1)
        most = min(width, self.single.longest)
        piece = np.full((len(texts), width + 1, most), -1, np.int32)
        for k in range(1, most + 1):
            piece[:, k:, k - 1] = self._found(sums[:, k:] - sums[:, :-k] * self.powers[k])
        piece[np.arange(width + 1) > n[:, None]] = -1  # past the word's end
        known, place = np.unique(chars, return_inverse=True)
        for c in known.tolist():
            if c not in self.spelled:
                self.spelled[c] = float(sum(self.logs[self.single.bytes[b]] for b in chr(c).encode("utf-8", "replace"))) if c != self.PAD else self.NEVER
        spelled = np.array([self.spelled[c] for c in known.tolist()])[place].reshape(chars.shape)
        spelled[np.arange(width) >= n[:, None]] = self.NEVER
        return n, chars, piece, spelled

    def _forward(self, n: np.ndarray, logs: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        rows, width, most = len(n), spelled.shape[1], logs.shape[2]
        alpha = np.full((rows, most + width), self.NEVER)  # place j is column most - 1 + j
        alpha[:, most - 1] = 0.0
        for j in range(1, width + 1):
            terms = np.empty((rows, most + 1))
            terms[:, :most] = alpha[:, j - 1 : j - 1 + most][:, ::-1] + logs[:, j]
            terms[:, most] = alpha[:, most + j - 2] + spelled[:, j - 1]
            top = terms.max(1)
            alpha[:, most - 1 + j] = top + np.log(np.exp(terms - top[:, None]).sum(1))
        return alpha[:, most - 1 :]

    def marginals(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for own in self.groups(words):
            n, _, piece, spelled = self._table([words[i] for i in own])
            out[own] = self._forward(n, self.logs[piece], spelled)[np.arange(len(n)), n]
        for i, w in enumerate(words):
            if len(w) >= self.LONG:
                out[i] = self.single.marginal(w)
        return out

    def expect(self, words: list[str], counts: np.ndarray, total: np.ndarray) -> None:
        """Add the expected number of each piece in the words, each counts times."""
        for own in self.groups(words):
            n, chars, piece, spelled = self._table([words[i] for i in own])
            logs = self.logs[piece]
            rows, width, most = len(n), spelled.shape[1], logs.shape[2]
            alpha = self._forward(n, logs, spelled)
            whole = alpha[np.arange(rows), n]
            beta = np.full((rows, width + 1 + most), self.NEVER)
            beta[np.arange(rows), n] = 0.0
            for j in range(width - 1, -1, -1):
                terms = np.full((rows, most + 1), self.NEVER)
                reach = min(most, width - j)
                terms[:, :reach] = beta[:, j + 1 : j + 1 + reach] + logs[:, np.arange(j + 1, j + 1 + reach), np.arange(reach)]
                terms[:, most] = beta[:, j + 1] + spelled[:, j]
                top = terms.max(1)
                beta[:, j] = np.where(j < n, top + np.log(np.exp(terms - top[:, None]).sum(1)), beta[:, j])
            weight = counts[own].astype(np.float64)
            for k in range(1, most + 1):
                used = piece[:, k:, k - 1]
                at = np.nonzero(used >= 0)
                if len(at[0]):
                    row, end = at[0], at[1] + k
                    share = np.exp(alpha[row, end - k] + logs[row, end, k - 1] + beta[row, end] - whole[row]) * weight[row]
                    total += np.bincount(used[at], share, len(total))
            share = np.exp(alpha[:, :-1] + spelled + beta[:, 1 : width + 1] - whole[:, None]) * weight[:, None]
            known, place = np.unique(chars, return_inverse=True)
            for c, x in zip(known.tolist(), np.bincount(place.ravel(), np.where(chars != self.PAD, share, 0.0).ravel(), len(known)).tolist(), strict=True):
                if c != self.PAD:
                    for b in chr(c).encode("utf-8", "replace"):
                        total[self.single.bytes[b]] += x
        for w, c in zip(words, counts.tolist(), strict=True):
            if len(w) >= self.LONG:
                self.single.expect(w, c, total)


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """word, c (its count in training documents) and n (in all documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            words = [*counts[0], *(w for w in counts[1] if w not in counts[0])]
            c = [counts[1][w] for w in words]
            n = [counts[0][w] + x for w, x in zip(words, c, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for batch in batches:
            for text, own in zip(*columns(batch, "text", "train"), strict=True):
                counts[own].update(text.lower().split())
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield rows()
                    counts = (Counter(), Counter())
        yield rows()

    rows = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), train.alias("train"))
    return rows.mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def first_logs(path: str) -> np.ndarray:
    weight = np.exp(vocabulary(path)[2])
    return np.log(np.append(weight, weight.mean()) / (weight.sum() + weight.mean()))


def reweighted(words: DataFrame, path: str, logs: np.ndarray, ends: float, scale: int = 1) -> np.ndarray:
    """One step of expectation-maximisation over distinct words; ends: the end's count beside all; scale: all words for one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattices(path, logs), np.zeros(len(logs))
        for batch in batches:
            words = columns(batch, "word")[0]
            lattice.expect([w.decode("utf-8", "replace") for w in words], np.ones(len(words)), total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    rows = words.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.full(len(logs), SMOOTHING)
    for piece, n in rows:
        counts[piece] += n * scale
    counts[-1] += ends
    return np.log(counts / counts.sum())


def score(docs: DataFrame, train: Column, path: str | None = None, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score (all log10) of every document."""
    spark, path = docs.sparkSession, path or default_path()
    counted = save(word_counts(docs, train), "words")
    ends, everything = docs.agg(F.coalesce(F.sum(train.cast("long")), F.lit(0)), F.count("*")).first()
    seen, distinct, tokens, all_words, once, twice = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    total, kinds = seen + ends, distinct + (ends > 0)
    logs = first_logs(path)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    learned, share = counted.where("c > 0"), F.pmod(F.xxhash64("word"), F.lit(max(1, passes)))
    for i in range(passes + 1 if seen else 0):
        some, scale = (learned.where(share == i), passes) if i < passes else (learned, 1)
        logs = reweighted(some, path, logs, ends * distinct / seen, scale)  # as many ends a word as in the texts
    buckets = max(partitions(spark), all_words // BUCKET_WORDS)

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, hashes = Lattices(path, logs), WordHashes()
        for batch in batches:
            words = columns(batch, "word")[0]
            lp = lattice.marginals([w.decode("utf-8", "replace") for w in words])
            bucket = (hashes.of(words) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp, pa.float64()), pa.array(bucket)], [*batch.schema.names, "lp", "bucket"])

    scored = save(counted.mapInArrow(marginals, "word binary, c long, n long, lp double, bucket int"), "scored")
    hot = scored.where(F.col("n") * FREQUENT > tokens).select("word", "c", "lp").toPandas()  # FREQUENT words at most
    known = spark.sparkContext.broadcast((dict(zip(map(bytes, hot["word"]), range(len(hot)), strict=True)), hot["c"].to_numpy(np.float64), hot["lp"].to_numpy(np.float64)))
    below = total + kinds + 1
    parts = save(_blocks(docs, train, known, buckets, total, kinds, discount, ends, float(logs[-1])), "blocks")

    def meet(words: pa.Table, blobs: pa.Table) -> pa.Table:
        number = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        c, lp = words.column("c").to_numpy(), words.column("lp").to_numpy()
        base, some, whole = np.log10((c + 1) / below), (c > 0).astype(np.float64), with_whole_words(c, lp, total, kinds, discount)
        out = []
        for block, text, owners in zip(*(blobs.column(n).to_pylist() for n in ("block", "words", "owners")), strict=True):
            at = np.fromiter(map(number.__getitem__, text.split(b" ")), np.int64)
            used, place = np.unique(np.frombuffer(owners, np.int32), return_inverse=True)
            sums = np.stack([np.bincount(place, v[at], len(used)) for v in (some, base, whole, lp)])
            out.append((block, used.astype(np.int32).tobytes(), sums.tobytes()))
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("block", pa.int64()), ("owners", pa.binary()), ("sums", pa.binary())))})

    blobs = parts.where("bucket >= 0").select("bucket", "block", "words", "owners")
    rare = scored.where(F.col("n") * FREQUENT <= tokens).select("bucket", "word", "c", "lp")
    sums = rare.groupBy("bucket").cogroup(blobs.groupBy("bucket")).applyInArrow(meet, "block long, owners binary, sums binary")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def added(group: pa.Table) -> pa.Table:
        head = [r for r in group.to_pylist() if r["ids"] is not None][0]
        all_sums = np.frombuffer(head["sums"], np.float64).reshape(4, -1).copy()
        for owners, more in zip(group.column("owners").to_pylist(), group.column("sums").to_pylist(), strict=True):
            if owners is not None:
                all_sums[:, np.frombuffer(owners, np.int32)] += np.frombuffer(more, np.float64).reshape(4, -1)
        n = np.frombuffer(head["tokens"], np.int64)
        ids = pa.array(head["ids"], group.schema.field("ids").type.value_type)
        return pa.table({"doc_id": ids, "held_out": pa.array(head["held"], pa.bool_()), "n_tokens": n, "n_known": np.rint(all_sums[0]).astype(np.int64), "train_tokens": np.full(len(n), total), "base_score": all_sums[1], "score": all_sums[2] / np.log(10), "lattice_score": all_sums[3] / np.log(10)})

    heads = parts.where("bucket < 0").select("block", "ids", "held", "tokens", F.lit(None).cast("binary").alias("owners"), "sums")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("ids", f"array<{id_type}>"), ("held", "array<boolean>"), ("tokens", "binary"))]
    rows = heads.unionByName(sums.select("block", *nothing, "owners", "sums"))
    return rows.groupBy("block").applyInArrow(added, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double")


def _blocks(docs: DataFrame, train: Column, known, buckets: int, total: int, kinds: int, discount: float, ends: int, end_log: float) -> DataFrame:
    """Blocks of documents: a row (bucket -1) with their ids and what frequent words and ends add, and their rare words by bucket."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), (~train).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, c, lp = known.value
        below = total + kinds + 1
        base, some, joint = np.append(np.log10((c + 1) / below), 0), np.append((c > 0).astype(np.float64), 0), np.append(with_whole_words(c, lp, total, kinds, discount), 0)
        lp, get, hashes = np.append(lp, 0), number.get, WordHashes()
        block, miss = TaskContext.get().partitionId() << 32, len(c)
        fixed = np.array([float(ends > 0), np.log10((ends + 1) / below), with_whole_words(np.array(ends), np.array(end_log), total, kinds, discount), end_log])

        def out(ids: list[pa.Array], held: list[bool], texts: list[bytes]) -> pa.RecordBatch:
            sums, tokens, rare, owners = [], [], [], []
            for i, text in enumerate(texts):
                words = text.lower().split()
                at = np.fromiter([get(w, miss) for w in words], np.int64, len(words))
                sums.append([some[at].sum(), base[at].sum(), joint[at].sum(), lp[at].sum()])
                tokens.append(len(words) + 1)
                own = np.flatnonzero(at == miss).tolist()
                rare += [words[j] for j in own]
                owners += [i] * len(own)
            first = (np.array(sums).reshape(-1, 4) + fixed).T
            bucket = (hashes.of(rare) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            owner = np.array(owners, np.int32)[order]
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)).tolist()
            order = order.tolist()
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            n, n_rest = 1, len(spans)
            ids_all = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([-1] + [int(bucket[order[a]]) for a, _ in spans], pa.int32()),
                    pa.array([block] * (n + n_rest), pa.int64()),
                    pa.array([ids_all.to_pylist()] + [None] * n_rest, pa.list_(ids_all.type)),
                    pa.array([held] + [None] * n_rest, pa.list_(pa.bool_())),
                    pa.array([np.array(tokens, np.int64).tobytes()] + [None] * n_rest, pa.binary()),
                    pa.array([first.tobytes()] + [None] * n_rest, pa.binary()),
                    pa.array([None] + [b" ".join([rare[j] for j in order[a:b]]) for a, b in spans], pa.binary()),
                    pa.array([None] + [owner[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                ["bucket", "block", "ids", "held", "tokens", "sums", "words", "owners"],
            )

        ids, held, texts, size = [], [], [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                text, flags = columns(batch, "text", "held")
                ids.append(batch.column(0))
                held += flags
                texts += text
                size += sum(map(len, text))
                if size >= BLOCK_BYTES:
                    yield out(ids, held, texts)
                    block, ids, held, texts, size = block + 1, [], [], [], 0
        if texts:
            yield out(ids, held, texts)

    return rows.mapInArrow(run, f"bucket int, block long, ids array<{id_type}>, held array<boolean>, tokens binary, sums binary, words binary, owners binary")
