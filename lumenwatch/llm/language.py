"""Language identification as a mixture of languages.

Training counts hashed letter 3-grams of each language's documents (all of them). A document's language
shares come from expectation-maximisation over its 3-grams' likelihoods. The set of languages is chosen
by penalised likelihood: languages join in order of share as long as the log likelihood gains more than
PENALTY * ln(number of 3-grams) each.

Defined cases: null text, or text without a letter, is `und` with score 0 and no languages, and so is
everything if no labelled document is there to learn from; texts of one or two letters use the 3-grams
that their blanks give; equal shares go to the language that sorts first; documents without lang are
predicted but never learnt from; repeated rows count each; a null doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns

BUCKETS, SMOOTHING, ROUNDS, PENALTY = 1 << 15, 0.5, 12, 3.0
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed 3-grams of the UTF-8 bytes of a text's lower-cased words, each word between blanks."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each 3-gram bucket in each: at most BUCKETS numbers a language reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*columns(batch, "lang", "text"), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(n[used])], ["lang", "bucket", "n"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique().tolist())
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, object), table["lang"].to_numpy(object)), table["bucket"].to_numpy()] = table["n"].to_numpy()
    return langs, np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS))


def shares(likelihood: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of likelihood, a column for each 3-gram seen n times), and the log likelihood."""
    share, total = np.full(len(likelihood), 1 / len(likelihood)), n.sum()
    for _ in range(rounds if len(share) > 1 else 0):
        share = share * (likelihood @ (n / (share @ likelihood))) / total
    return share, float(n @ np.log(share @ likelihood))


def mixture(likelihood: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The languages chosen (largest share first) and their shares."""
    share, _ = shares(likelihood, n)
    order = np.argsort(-share, kind="stable")
    price = PENALTY * np.log(max(2.0, float(n.sum())))
    best, value = shares(likelihood[order[:1]], n)
    for k in range(2, len(order) + 1):
        more, gain = shares(likelihood[order[:k]], n)
        if gain - value <= price:
            break
        best, value = more, gain
    again = np.argsort(-best, kind="stable")
    return order[again], best[again]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """lang_pred, score (the language's share) and languages with their shares, beside doc_id and the columns to keep."""
    langs, logs = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.exp(logs)
        for batch in batches:
            out: list[tuple[str, float, list[str], list[float]]] = []
            for text in columns(batch, "text")[0]:
                if not langs or not has_letter(text):
                    out.append(("und", 0.0, [], []))
                    continue
                n = np.bincount(grams(text), minlength=BUCKETS)
                used = np.flatnonzero(n)
                chosen, share = mixture(table[:, used], n[used].astype(np.float64))
                out.append((langs[chosen[0]], float(min(1.0, share[0])), [langs[i] for i in chosen], share.tolist()))
            new = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())))]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(rest + new, [*names, "lang_pred", "score", "languages", "shares"])

    names = ["doc_id", *keep]
    rows = docs.select(*dict.fromkeys([*names, "text"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, languages array<string>, shares array<double>")


def fold(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
