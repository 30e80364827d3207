from __future__ import annotations

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import suffix_dedup, textbytes as tb

TEXTS = st.lists(st.text(alphabet="aB1 .\n\té€'-", max_size=40), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = tb.batch_of(pa.array(texts, pa.string()))
    starts, ends, first = tb.words(data, offsets, tb.SPACED)
    got = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]


def test_hashes_follow_content():
    data, offsets = tb.batch_of(pa.array(["ab cd", "cd ab", None, ""]))
    starts, ends, first = tb.words(data, offsets, tb.SPACED)
    h = tb.Spans(data).hash(starts, ends)
    assert first.tolist() == [0, 2, 4, 4, 4]
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_hashes_and_comparisons_of_long_and_look_alike_spans():
    """Sums of powers modulo 2 ** 64 give Thue-Morse words and their complements one value."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    x, y = bytes(97 + b for b in bits[:1024]), bytes(98 - b for b in bits[:1024])
    data = np.frombuffer(x + y + x + b"abcabd" + b"z" * 120 + b"z" * 120, np.uint8)
    spans = tb.Spans(data)
    at, end = np.array([0, 1024, 2048, 3072, 3075, 3078, 3198]), np.array([1024, 2048, 3072, 3075, 3078, 3198, 3318])
    h = spans.hash(at, end)
    assert h[0] == h[2] and h[5] == h[6] and len(set(h.tolist())) == 5
    assert spans.equal(at[[0, 0, 3, 5]], at[[2, 1, 4, 6]], np.array([1024, 1024, 3, 120])).tolist() == [True, False, False, True]
    assert spans.same_bytes(h, at, end) and not spans.same_bytes(np.zeros(7, np.uint64), at, end)


def test_runs_cover_all():
    offsets = np.array([0, 5, 5, 500, 501, 502])
    assert list(tb.runs(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_suffix_array(values):
    s = np.array([*(v + 1 for v in values), 0], np.int16)
    assert suffix_dedup.suffix_array(s, 257).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_array_recurses():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 30, 400)
    s = np.append(np.concatenate([base, base[50:300], base]), 0).astype(np.int16)
    assert suffix_dedup.suffix_array(s, 257).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.booleans())
def test_both_inductions_agree(values, buckets):
    s = np.array([*(v + 1 for v in values), 0], np.int16)
    own = suffix_dedup._induce_buckets if buckets else suffix_dedup._induce_suffixes
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_dedup, "_induce", own)
        assert suffix_dedup.suffix_array(s, 5).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_shards_are_sorted_by_recursive_induction(monkeypatch):
    """A shard of the usual size: names go through induction again, level after level, and never through another sort."""
    text = duckdb.sql("SELECT string_agg(text, ' ' ORDER BY doc_id) FROM read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall()[0][0].encode()[: 2 << 20]
    depths, inner = [], suffix_dedup.suffix_array

    def counted(s, names):
        depths.append((len(s), names))
        return inner(s, names)

    monkeypatch.setattr(suffix_dedup, "suffix_array", counted)
    data = np.frombuffer(text, np.uint8)
    array = counted(np.append(data.astype(np.int16) + 1, 0), 257)
    assert len(depths) >= 3 and depths[1][0] > 400_000 and depths[1][1] > 10_000
    assert len(np.unique(array)) == len(text) + 1
    assert all(text[i : i + 4000] <= text[j : j + 4000] for i, j in zip(array[1:-1:97].tolist(), array[2::97].tolist(), strict=False))


def test_permuted_prefixes():
    data = np.frombuffer(b"abcabcabcabcabcabcabxabcabcabcabcabcabcabcq", np.uint8)
    array = suffix_dedup.suffix_array(np.append(data.astype(np.int16) + 1, 0), 257)[1:]
    got = suffix_dedup.permuted_prefixes(data, array, 12)
    for i, j in zip(array[1:], array[:-1], strict=True):
        n = 0
        while n < 12 and max(i, j) + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        assert got[i] == (12 if n == 12 else n // 8 * 8)
