"""MinHash, exact and suffix-array dedup against plain programs, and their odd cases."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import exact_dedup, minhash, suffix_dedup
from skein.llm.storage import Scratch

SCHEMA = "doc_id long, text string, kept string, size int"  # with names that the operators use too


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def plain_components(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_all_pairs(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "oNE"), (5, "one two"), (6, "É x"), (7, "é x")]
    for family in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(45):
            copy = [rng.choice(words) if rng.random() < family * 0.012 else w for w in base]
            rows.append((len(rows) * 3, " ".join(copy)))
    rows = [(d + 10 * (d > 7), t) for d, t in rows]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows), shingle_words=size).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in plain_components(rows, size, 80).items()}


def graded(rng, families, copies, words=60):
    """Families of copies that differ from their base by more and more words."""
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            rate = rng.choice([0.0, 0.01, 0.02, 0.03, 0.045])
            rows.append(" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("query_bytes", [None, 400])
def test_search_in_blocks_equals_all_pairs(spark, monkeypatch, query_bytes):
    """With blocks of a text or two and parts of a few, each family is searched in many blocks and parts."""
    if query_bytes:
        monkeypatch.setattr(minhash, "QUERY_BYTES", query_bytes)
        monkeypatch.setattr(minhash, "PART_BYTES", 1500)
    monkeypatch.setattr(minhash, "RARE", 2)
    rows = graded(random.Random(12), 3, 110)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows), shingle_words=5).collect()}
    assert got == plain_components(rows, 5, 80)


def test_many_queries_in_one_family():
    """More than a thousand sets in an index, compared with a plain count."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(1500)]
    index = minhash._Index(sets)
    for own in sets[::150]:
        want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, own)) >= 80 * len(np.union1d(s, own))]
        assert index.links(own, 80).tolist() == want


def test_texts_are_sent_once_to_their_family(spark, monkeypatch):
    """Twice the families, twice the rows of the search, however many queries there are in all."""
    monkeypatch.setattr(minhash, "QUERY_BYTES", 1 << 16)
    seen, keep = [], Scratch.keep

    def counted(self, df, label):
        out = keep(self, df, label)
        if label == "family":
            seen.append((out.count(), out.agg(F.sum("bytes")).first()[0]))
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    monkeypatch.setattr(minhash, "RARE", 0)
    for families in (2, 4):
        minhash.near_duplicates(frame(spark, graded(random.Random(3), families, 60))).count()
    assert len(seen) == 2 and seen[1][0] < 2.6 * seen[0][0]


def test_look_alike_words_are_not_linked(spark):
    """Thue-Morse words and their complements have equal sums of powers modulo 2 ** 64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, [(1, x), (2, y), (3, x + " " + y), (4, y + " " + x), (5, x)])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("size", [2, 5])
def test_sets_do_not_rest_on_hashes(monkeypatch, size):
    """With hashes of a few values the exact sets are still those of the words."""
    texts = ["a b c d e f g", "a b x d e f g", "a", "b", "", "c d", "a b c d e f h", "a  b c\nd e f g"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    true = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()} for w in map(str.split, texts)]

    def check():
        sets = minhash.Shingled(data, offsets, size).exact_sets()
        assert [[len(np.intersect1d(a, b)) for b in sets] for a in sets] == [[len(a & b) for b in true] for a in true]

    check()
    digests = minhash.Shingled(data, offsets, size).digested()[1]
    assert [[a == b for b in digests] for a in digests] == [[a == b for b in true] for a in true]
    monkeypatch.setattr(minhash.tb.Spans, "hash", lambda self, a, b, seed=0: (b - a).astype(np.uint64) % np.uint64(2))
    check()


def test_minhash_repeated_ids(spark):
    """Of an id's texts the one of the smallest MD5 digest is judged, whatever the order of the rows."""
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g"]
    chosen = min(texts, key=lambda t: hashlib.md5(t.encode()).hexdigest())
    for order in (texts, texts[::-1]):
        rows = [(9, t) for t in order] + [(2, chosen), (3, "other words of no one else at all")]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
        assert got[9] == (len(chosen.split()) - 4, 2) and got[3][1] == 3 and len(got) == 3


def test_minhash_long_text(spark):
    text = " ".join(f"w{i % 9001}" for i in range(200_000))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, [(1, text), (2, text + " end"), (3, text[:50_000])])).collect()}
    assert got[1] == (9001, 1) and got[2] == (9002, 1)


def test_minhash_odd_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, None, None), (2, 2, True), (7, 2, False)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101)], "u long, v long")
    got = {r["node"]: r["component"] for r in minhash.connected_components(Scratch(spark, "test"), edges).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100}


def test_exact_dedup(spark):
    rows = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (None, "ab É"), (6, "x" * 200_000), (6, "x" * 200_000)]
    for keep, winner in (("max", 2), ("min", 1)):
        got = sorted((r["doc_id"] or -1, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(spark, rows), keep=keep).collect())
        empty = 5 if keep == "max" else 4
        assert got == [(-1, winner, 3, False), (1, winner, 3, winner == 1), (2, winner, 3, winner == 2), (3, 3, 1, True), (4, empty, 2, empty == 4), (5, empty, 2, empty == 5), (6, 6, 2, True), (6, 6, 2, True)]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_stays_in_the_jvm(spark, sf):
    plan = exact_dedup.op3_exact_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_dedup_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = sorted(duckdb.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.ORACLE})").fetchall())
    assert sorted(map(tuple, exact_dedup.op3_exact_dedup(spark, sf).collect())) == want


def plain_repeats(rows, length):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], (d, i))
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < (d, i):
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[d] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"shard_bytes": 500}])
def test_suffix_dedup_equals_plain_program(spark, options):
    rng = random.Random(5)
    piece = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    rows = [(rng.randint(0, 10**6), "".join(rng.choice(piece) if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(50)) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    rows = list({d: (d, t) for d, t in rows}.values())
    rows += [(-5, "q" * 400), (-4, "ab" * 300), (-3, "short"), (-2, "")]
    common = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows += [(10**7 + i, f"{common}{i % 37:02d}" + "".join(rng.choice("xyz") for _ in range(i % 4)) + common) for i in range(60)]
    got = {r[0]: tuple(r[1:5]) for r in suffix_dedup.remove_repeats(frame(spark, rows), **options).collect()}
    assert got == plain_repeats([(d, t.encode()) for d, t in rows], 100)


def test_suffix_dedup_long_text(spark):
    """Longer than a run, so that it is worked off in pieces; its end repeats its beginning."""
    rng = random.Random(6)
    head = "".join(rng.choice("abcdefgh") for _ in range(3000))
    text = head + "".join(rng.choice("abcdefgh") for _ in range(1_200_000)) + head
    row = suffix_dedup.remove_repeats(frame(spark, [(1, text), (2, "z" + head[:500])])).orderBy("doc_id").collect()
    assert [tuple(r[1:4]) for r in row] == [(len(text), 3000, 1), (501, 500, 1)]
    assert bytes(row[0]["kept_bytes"]).decode() == text[:-3000]


def test_suffix_dedup_odd_rows(spark):
    text = hashlib.sha512(b"x").hexdigest() + hashlib.md5(b"y").hexdigest()[:22]
    rows = [(None, text), (3, None), (4, text), (4, text), (9, text)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(-1, 150, 0), (3, 0, 0), (4, 150, 0), (4, 150, 0), (9, 150, 150)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
