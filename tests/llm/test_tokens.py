"""Token shards and token counts: exact round trips against the libraries."""

from __future__ import annotations

import io
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import textbytes as tb
from skein.llm import token_count, token_store

ODD = ["", "a", " a", "a ", "a  b", "it's 'll", "a\n b", "\n\n x.", "x᠎ y", "　 a", "a\tb", "1 2,3.4", "a.,b", "<|endoftext|> x<|endoftext|>", "é,ñ.\nÀ", "_,.x", "a\x00b c"]
ALPHABET = " \n\t\u180e\x00a's\u00e91.,!_x\u3000\u2009\u00a0\u201c\u1680\u2028\x1c\x7f"


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(token_store.default_tokenizer())


@pytest.fixture(scope="module")
def library():
    """The library's tokenizer as it comes from the file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.default_tokenizer())
    return lambda texts: [[*e.ids, 0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=10))
def test_chunks_encode_as_the_whole(encoder, library, texts):
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == library(texts)


def test_odd_texts_encode_as_the_whole(encoder, library):
    assert [x.tolist() for x in encoder.encode(pa.array(ODD))] == library(ODD)
    assert encoder.encode(pa.array(["a\n\nb"]))[0].tolist() == [64, 198, 198, 65, 0]
    assert 50256 in encoder.encode(pa.array(["x<|endoftext|>"]))[0].tolist()


def test_random_texts_encode_as_the_whole(encoder, library):
    rng = random.Random(9)
    pieces = [*"abcxyzABZ019 .,;:!?'\"-_\n\t\r", " ", " ", "\n\n", "\r\n", "  ", " \n", "'s", "'re", "\u00e9", "\u4e2d\u6587", "\u3000", "\u00a0", "\u2028", "word", " word", "<|endoftext|>", "<|endof", "\x00", "\x1c", "\U0001f600", "\u0301"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    got = encoder.encode(pa.array(texts))
    assert [t for t, x, y in zip(texts, got, library(texts), strict=True) if x.tolist() != y] == []


def test_long_and_look_alike_words(encoder, library):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits), "x" * 3000 + " y", "\u4e2d" * 2000, "a " * 50_000, " ".join(f"w{i}" for i in range(30_000))]
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == library(texts)


def test_shared_hashes_are_noticed(encoder, library, monkeypatch):
    """With hashes of four values all chunks collide; the ids are those of the whole texts all the same."""
    monkeypatch.setattr(tb.Spans, "hash", lambda self, a, b, seed=0: ((b - a) % 4).astype(np.uint64))
    texts = ["some words, other words", "more of them.\nAnd more", "and"]
    fresh = token_store.Encoder(token_store.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in fresh.encode(pa.array(texts))] == library(texts)
        assert fresh.encode(pa.array(["and"]))[0].tolist() == library(["and"])[0]
        assert fresh.encode(pa.array(["but"]))[0].tolist() == library(["but"])[0]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    other, exact = token_store.Encoder(path), Tokenizer.from_file(path)
    assert not other.cuts
    for text in ODD:
        assert other.encode(pa.array([text]))[0].tolist() == [*exact.encode(text, add_special_tokens=False).ids, 0]


def test_cache_generations(encoder, library, monkeypatch):
    monkeypatch.setattr(token_store, "CACHED", 20)
    for k in range(6):
        texts = [f"word{i} and more, of {i * k}." for i in range(9)]
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == library(texts)


def test_shard_lookup(tmp_path):
    rng = random.Random(2)
    keys = sorted({rng.randint(-(2**62), 2**62) for _ in range(800)})
    rows = [(None, np.array([5], "<u2"))] + [(k, np.array([rng.randint(0, 60000) for _ in range(rng.randint(0, 90))], "<u2")) for k in keys]
    rows.insert(10, (rows[9][0], np.array([70000], "<u4")))  # a repeated key, a wide entry
    sink = io.BytesIO()
    writer = token_store.ShardWriter(sink, 1000)
    for k, ids in rows:
        writer.add(k, ids)
    writer.close()
    (tmp_path / "a.sst").write_bytes(sink.getvalue())
    shard = token_store.Shard(f"file://{tmp_path}/a.sst")
    assert len(shard.places) > 50
    assert [(k, v.tolist()) for k, v in shard] == [(k, v.tolist()) for k, v in rows]
    for k, ids in rows[:10] + rows[11:]:
        assert shard.get(k).tolist() == ids.tolist()
    absent = [shard.get(k + 1) for k in keys if k + 1 not in keys]
    assert absent and not any(x is not None for x in absent)
    assert len(sink.getvalue()) < sum(8 + v.nbytes for _, v in rows) + 20_000
    with pytest.raises(ValueError):
        writer2 = token_store.ShardWriter(io.BytesIO())
        writer2.add(5, rows[0][1]), writer2.add(4, rows[0][1])


def test_store_round_trip(spark, sf, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in token_store.op2_token_shards(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, want = 0, {}
    for d, text in docs:
        ids = library([text])[0]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_lookup_across_shards(spark, tmp_path, library):
    rows = [(i * 7 - 300, f"text {i} of\n\nmany") for i in range(200)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = token_store.store_tokens(docs, token_store.default_tokenizer(), folder=f"file://{tmp_path}/out")
    assert out.count() == spark.read.parquet(f"file://{tmp_path}/out/manifest").first()["n_docs"] == 201
    token_store.write_shards(docs, f"file://{tmp_path}/four", token_store.default_tokenizer(), shards=4).write.parquet(f"{tmp_path}/manifest")
    manifest = spark.read.parquet(f"{tmp_path}/manifest")
    assert manifest.count() == 4
    shards = token_store.Shards(manifest)
    for i, text in rows[::9] + rows[-1:]:
        assert shards.get(i).tolist() == library([text])[0]
    assert shards.get(5) is None and shards.get(10**9) is None
    shards.close()


def test_store_odd_rows(spark):
    rows = [(None, "x"), (5, None), (5, "y y"), (-3, ""), (2**40, "z")]
    docs = spark.createDataFrame([(i, t, "p") for i, t in rows], "doc_id long, text string, path string")
    got = token_store.store_tokens(docs, token_store.default_tokenizer()).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -3, 5, 5, 2**40]
    assert [r["n_tokens"] for r in got][:2] == [2, 1]
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert token_store.store_tokens(docs.limit(0), token_store.default_tokenizer()).count() == 0


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.unigram_vocabulary(token_count.default_vocabulary())
    exact = Tokenizer(models.Unigram(vocabulary, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=True)
    return token_count.Counter(vocabulary), exact


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \nabethiaon▁é中\U0001f600<0x>,.\x00", max_size=40))
def test_counts_equal_the_tokenizer(unigram, text):
    counter, exact = unigram
    assert counter.text(text)[0] == len(exact.encode(text, add_special_tokens=False).ids)


def test_counts_of_documents(spark, sf, unigram):
    _, exact = unigram
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d: len(e.ids) for (d, _), e in zip(docs, exact.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True)}
    assert {r["doc_id"]: r["n_tokens"] for r in token_count.op9_token_counts(spark, sf).collect()} == want


def test_count_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (1, None, 1), (1, None, 1), (2, "", 1)], "doc_id long, text string, n_tokens int")
    got = token_count.count_tokens(docs, token_count.default_vocabulary())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == [(0, 1), (1, 0), (1, 0), (2, 0)]


def test_ties_follow_the_tokenizer():
    from tokenizers import Tokenizer, models

    vocabulary = [("", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -2.0), ("c", -1.0), ("abc", -3.0), ("cd", -2.0)]
    exact, counter = Tokenizer(models.Unigram(vocabulary, 0, False)), token_count.Counter(vocabulary)
    for word in ("abc", "ab", "bcabc", "aabbcc", "abcd", "dabc"):
        want = exact.encode(word).tokens
        unknown = sum(t not in {v for v, _ in vocabulary} for t in want)
        assert unknown or counter.word(word)[0] == len(want)


def test_a_word_without_end(unigram, monkeypatch):
    """Long words are matched one character at a time, with the same result, and without a list for each character."""
    counter, exact = unigram
    word = "ablehandöß漢x" * 3000
    assert len(word) > token_count.LONG and counter.text(word)[0] == len(exact.encode(word, add_special_tokens=False).ids)
    some = [word[i : i + 90] for i in range(0, 900, 60)]
    want = [counter.word(w) for w in some]
    monkeypatch.setattr(token_count, "LONG", 5)
    assert [counter.word(w) for w in some] == want
    tracemalloc.start()
    counter.word("ablehand" * 50_000)
    assert tracemalloc.get_traced_memory()[1] < 40 * 400_000
    tracemalloc.stop()


def test_count_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a word", 3, 0.5)], "doc_id long, text string, n_tokens int, score double")
    got = token_count.count_tokens(docs, token_count.default_vocabulary())
    assert got.columns == ["doc_id", "n_tokens", "score"] and got.first()["n_tokens"] > 0
    assert token_count.count_tokens(docs.limit(0), token_count.default_vocabulary()).count() == 0
