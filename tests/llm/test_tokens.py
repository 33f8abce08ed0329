"""Packing and token files."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenwatch.llm import huffman, packing
from lumenwatch.llm.tokens import WordTokenizer, default_path


def ids_of(text, end):
    whole = Tokenizer.from_file(default_path())
    return [*whole.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_give_the_ids_of_whole_texts(rows):
    extra = ["don't WE'LL a<|endoftext|>b, x y é ́z Σ ΑΣ ΑΣ. İstanbul it's!! ...", "ab\x1ccd\x85ef", "naïve,co-op; 12a,"]
    texts = [r[1] or "" for r in rows] + extra
    flat, n = WordTokenizer(default_path()).encode([t.encode() for t in texts], 7)
    want = [ids_of(t, 7) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


def fewest_by_best_fit(lengths, capacity):
    """Sequences that best fit uses, one piece at a time, longest first."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


def fewest(lengths, capacity):
    """The exact minimum, by trying all packings."""
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            put(i + 1, tuple(sorted([*rooms[: rooms.index(r)], *rooms[rooms.index(r) + 1 :], r - lengths[i]])))
        put(i + 1, (*rooms, capacity - lengths[i]))

    lengths = sorted(lengths, reverse=True)
    put(0, ())
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_plan_is_near_the_exact_minimum(lengths):
    used = lambda x: len({p[3] + i for p in packing.plan({n: x.count(n) for n in x}, 30) for i in range(-(-(p[2] - p[1]) // p[4]))})
    large = [x for x in lengths if 3 * x > 30]
    assert not large or used(large) == fewest(large, 30)  # matching is exact
    assert fewest(lengths, 30) <= used(lengths) <= min(fewest_by_best_fit(lengths, 30) + 1, fewest(lengths, 30) + 1)


def test_packing_covers_every_id_once_without_gaps(docs, rows):
    out = packing.pack_documents(docs, capacity=256).collect()
    assert sorted((r.ids_crc32, r.length) for r in out) == sorted((crc(p), len(p)) for _, t, *_ in rows for ids in [ids_of(t, 1)] for p in [ids[i : i + 256] for i in range(0, len(ids), 256)])
    by = defaultdict(list)
    for r in out:
        assert r.start == r.piece * 256 and crc(r.ids) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= fewest_by_best_fit([r.length for r in out], 256)
    assert {len(r.ids) for r in packing.sequences(packing.pack_documents(docs, capacity=256)).collect()} == {sum(n for _, n in p) for p in by.values()}


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=20))
def test_plan_places_every_piece_once(histogram):
    fill = defaultdict(list)
    for length, a, b, first, each, offset in packing.plan(histogram, 60):
        for r in range(b - a):
            fill[first + r // each].append((offset + r % each * length, length, a + r))
    assert sorted((x, r) for p in fill.values() for _, x, r in p) == sorted((x, r) for x, n in histogram.items() for r in range(n))
    for p in fill.values():
        at = 0
        for offset, length, _ in sorted(p):
            assert offset == at
            at += length
        assert at <= 60


def test_large_pieces_are_matched_optimally():
    # 40 fits with 20 to 20, 35 with 25: four pairs need four sequences
    assert max(p[3] for p in packing.plan({40: 2, 35: 2, 25: 2, 21: 0 or 1, 22: 1}, 60)) + 1 == 5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), max_size=700), min_size=1, max_size=4))
def test_blocks_decode_to_what_was_encoded(docs):
    parts = [np.array(d, np.uint32) for d in docs]
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=401)
    lengths = huffman.code_lengths(counts)
    n = np.array([len(d) for d in docs], np.int64)
    payload = huffman._block(list(range(len(docs))), np.concatenate(parts), n, huffman.canonical(lengths), lengths)
    ids, got_n, got = huffman.read_block(payload, huffman.decoding_table(lengths))
    assert ids.tolist() == list(range(len(docs))) and got_n.tolist() == n.tolist() and got.tolist() == [i for d in docs for i in d]


def test_code_lengths_are_limited_and_complete():
    counts = np.array([2**min(i, 40) for i in range(60)])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LIMIT and (2.0 ** -lengths.astype(float)).sum() == 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_files_give_back_ids_in_order(spark, docs, rows, none, tmp_path):
    huffman.write(docs, f"file://{tmp_path}/ids")
    out = huffman.read(spark, f"file://{tmp_path}/ids").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in out) == sorted((d is not None, d or 0, ids_of(t, 2)) for d, t, *_ in rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == crc(r.ids)
        at += r.n_tokens
    known = [r.doc_id for r in sorted(out, key=lambda r: r.start) if r.doc_id is not None]
    assert known == sorted(known)
    with pytest.raises(TypeError):
        huffman.write(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"), f"file://{tmp_path}/text")
    huffman.write(none, f"file://{tmp_path}/none")
    assert huffman.read(spark, f"file://{tmp_path}/none").count() == 0


def test_marks_behind_letters_are_coded_once_and_ids_stay_those_of_the_text():
    from lumenwatch.llm.tokens import WordTokenizer, default_path

    coder, given = WordTokenizer(default_path()), []
    plain = coder.tokenizer
    coder.tokenizer = type("Counted", (), {"encode_batch_fast": staticmethod(lambda texts, **more: given.extend(w for t in texts for w in t.split()) or plain.encode_batch_fast(texts, **more))})
    words = ["house", "straße", "Γσς", "漢字", "ét", "x²", "don't", "a"]
    marks = ["", ".", ",", "***", "?!", "$$$", "'", "'.", "²", "́", "<|endoftext|>", ".b", "7", "-"]
    for texts in ([" ".join(w + m for m in marks for w in words)], [w + m for m in marks for w in words], ["house", "...", "house."]):
        ids, n = coder.encode([t.encode() for t in texts], 2)
        assert ids.tolist() == [i for t in texts for i in ids_of(t, 2)] and n.tolist() == [len(ids_of(t, 2)) for t in texts]
    assert given.count("house") == 1 and not {"house.", "house***", "straße?!"} & set(given)
