"""Shared helpers: tables, word splitting and 64-bit hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, save, scratch

__all__ = ["components", "save", "scratch"]

#: An odd multiplier with no short cycle, for polynomial hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the text's bytes (null: empty), with the named columns besides; other columns stay out of Python."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), *more)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


#: Lower-cases A-Z and blanks every other ASCII character that isn't a letter or digit.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and other characters beyond ASCII, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen again; emptied when it holds too many."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Rolling:
    """Hashes of every k consecutive word hashes. Power tables grow to the longest text seen."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def sums(self, words: np.ndarray) -> np.ndarray:
        """Prefix sums of word*base**place; of() takes hashes of spans from them."""
        if len(self.up) <= len(words):
            n = max(4096, 2 * len(words))
            self.up, self.down = powers(n, self.base), powers(n, self.inverse)
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        s = self.sums(words)
        n = max(0, len(words) - k + 1)
        return mixed((s[k : k + n] - s[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: equal only for equal values, with all bits spread."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
