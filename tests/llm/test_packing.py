"""Packing against the tokenizer and the rules of bins."""

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioflow.llm import packing
from folioflow.llm.packing import WordIds, best_two_fit_pack, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "hello World, it's 12 o'clock", "Ärger über ÑANDÚ çà — naïve…", "a<|endoftext|>b <|startoftext|>", "x" * 9000, "word " * 5000, "tab\tline\r\nnbsp\xa0em\u2003sep\x1cend", "### foo*** bar%%% 日本語 ß ŒUVRE e\u0301", "don't stop", "hello World, it's 12 o'clock"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@cache
def models():
    return WordIds(PATH), Tokenizer.from_file(PATH)


def test_word_ids_equal_the_tokenizer(tokenizer):
    ids = WordIds(PATH)
    for text in TEXTS:
        assert np.frombuffer(ids.encode(text or ""), "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids, whole = models()
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.-\n日", max_size=40)), max_size=6), st.integers(1, 12))
def test_any_column_in_spans_of_any_size(texts, span):
    ids, whole = models()
    usual, packing.SPLIT_BYTES = packing.SPLIT_BYTES, span
    try:
        got, ends = ids.encode_column(pa.array(texts, pa.string()))
    finally:
        packing.SPLIT_BYTES = usual
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got.tolist() == sum(want, []) and np.diff(ends).tolist() == list(map(len, want))


def check_bins(rows, max_len):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= max_len
    return len(bins)


def test_pack_round_trip(spark, tokenizer):
    texts = TEXTS * 4
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, length int").repartition(3)
    rows = best_two_fit_pack(df, PATH, keep_ids=True).collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for r in own for x in r.ids] == want
        assert [r.start for r in own] == list(range(0, len(want), 2048))
    total = sum(r.length for r in rows)
    assert check_bins(rows, 2048) <= -(-total // 2048) + 2


def test_empty_table(spark):
    assert best_two_fit_pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_replaces_the_smallest_by_a_tighter_pair():
    # 6 leaves a gap of 4; 3 goes in; the pair 2 + 2 fills the gap of 4 exactly.
    plan, bins = plan_bins({6: 1, 3: 1, 2: 2}, 10)
    first = plan[plan.sequence == 0].sort_values("offset")
    assert first["length"].tolist() == [6, 2] and first["each"].tolist() == [1, 2] and bins == 2


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1))
def test_plan_places_every_piece_once(histogram):
    plan, bins = plan_bins(histogram, 64)
    fill = np.zeros(bins, int)
    for length, n in histogram.items():
        own = plan[plan.length == length].sort_values("rank")
        ranks = [*own["rank"], n]
        for r, nxt in zip(own.itertuples(), ranks[1:]):
            for k in range(nxt - r.rank):
                assert r.offset + k % r.each * length + length <= 64
                fill[r.sequence + k // r.each] += length
    assert fill.max() <= 64 and fill.sum() == sum(a * b for a, b in histogram.items())
