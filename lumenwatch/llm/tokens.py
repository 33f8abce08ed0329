"""Token ids of whole texts by an existing tokenizer; nothing is trained here."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer_of(path: str, limit: int = 1_200_000) -> WordTokenizer:
    """One for each Python worker, so that tasks share the chunks it has seen."""
    return WordTokenizer(path, limit)


#: A chunk of letters and then ASCII marks, which the tokenizer splits there: never an apostrophe, nor what composes with a letter.
MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class WordTokenizer:
    """Encodes texts with the tokenizers library, each distinct blank-separated chunk once.

    word_bpe_49k lower-cases, drops white space and never joins characters across it, so a text's ids
    are its chunks' ids in order (tests compare with encoding whole texts). Chunks kept: at most limit.
    """

    #: Chunks of letters in one call; each has one token that ends a word.
    GROUP = 400

    def __init__(self, path: str, limit: int = 1_200_000):
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.numbers, self.starts, self.lengths, self.ids = _Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _single(self, words: list[str]) -> tuple[list[int], np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [i for c in coded for i in c], np.fromiter(map(len, coded), np.int64, len(coded))

    def _fresh(self, known: int) -> None:
        """Adds the ids of the words numbered from `known` on: letters with marks behind them are both parts' ids, words of letters go many to a call, the others word by word."""
        words = [w.decode("utf-8", "replace") for w in islice(self.numbers, known, None)]
        parts = [m.group(1, 2) if (m := MARKED(w)) and m[1].isalpha() else None for w in words]
        more = [[self.numbers[p[i].encode()] for p in parts if p] for i in (0, 1)]
        words += [w.decode() for w in islice(self.numbers, known + len(words), None)]  # parts that weren't seen by themselves
        marked = np.flatnonzero([p is not None for p in parts])
        plain = np.ones(len(words), bool)
        plain[marked] = False
        letters = np.array([w.isalpha() for w in words])
        starts, lengths, ids, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [self.ids], len(self.ids)

        def add(place: np.ndarray, coded: list[int] | np.ndarray, n: np.ndarray) -> None:
            nonlocal at
            starts[place], lengths[place] = at + np.cumsum(n) - n, n
            ids.append(np.array(coded, np.uint32))
            at += len(coded)

        simple, other = np.flatnonzero(letters), np.flatnonzero(plain & ~letters)
        groups = [simple[i : i + self.GROUP] for i in range(0, len(simple), self.GROUP)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            last = np.flatnonzero(self.ends[e.ids])
            if len(last) == len(g) and last[-1] == len(e.ids) - 1:
                add(g, e.ids, np.diff(last + 1, prepend=0))
            else:
                add(g, *self._single([words[i] for i in g]))
        add(other, *self._single([words[i] for i in other]))
        self.starts, self.lengths, self.ids = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths]), np.concatenate(ids)
        both = np.array(more, np.int64).reshape(2, -1).T  # a row a marked word
        flat, n = self._flat(both.ravel())
        self.starts[known + marked] = len(self.ids) + np.cumsum(n.reshape(-1, 2).sum(1)) - n.reshape(-1, 2).sum(1)
        self.lengths[known + marked] = n.reshape(-1, 2).sum(1)
        self.ids = np.concatenate([self.ids, flat])

    def _flat(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered words, one after the other, and how many each has."""
        n = self.lengths[words]
        ends = np.cumsum(n)
        return self.ids[np.arange(int(n.sum())) + np.repeat(self.starts[words] - (ends - n), n)], n

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's number of ids; end closes each text."""
        if len(self.numbers) > self.limit:
            self.clear()
        known, number = len(self.numbers), self.numbers.__getitem__
        parts = [np.fromiter(map(number, w := t.lower().split()), np.int64, len(w)) for t in texts]
        if len(self.numbers) > known:
            self._fresh(known)
        words = np.concatenate([*parts, np.zeros(0, np.int64)])
        flat, n = self._flat(words)
        total = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, parts)])]
        if end is not None:
            flat = np.insert(flat, total[1:], end)
        return flat, np.diff(total) + (end is not None)
