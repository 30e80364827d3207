"""The stored indexes against plain scoring, over segments, and what they skip."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from skein.operators.index import KeywordIndex, VectorIndex
from skein.plans.adapters import keyword_index
from skein.plans.registry import QUERIES

WORDS = [f"w{i}" for i in range(40)]


def plain_bm25(docs, query, limit):
    words = {d: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for d, t in docs}
    mean, terms, score = sum(map(len, words.values())) / len(words), sorted(set(query.lower().split())), {}
    for d, ws in words.items():
        n = Counter(ws)
        if any(n[t] for t in terms):
            idf = {t: math.log(1 + (len(words) - k + 0.5) / (k + 0.5)) for t in terms for k in [sum(t in x for x in words.values())]}
            score[d] = sum(idf[t] * n[t] * 2.2 / (n[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in terms)
    return [(d, pytest.approx(s)) for d, s in sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:limit]]


def random_docs(n, seed, first=0):
    rng = random.Random(seed)
    docs = [(first + i, " ".join(rng.choice(WORDS[: rng.choice((3, 10, 40))]) for _ in range(rng.choice((1, 5, 20, 60))))) for i in range(n)]
    return docs + [(first + n, None), (first + n + 1, ""), (first + n + 2, docs[0][1]), (first + n + 3, "W0, w1! Ünder w39")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def test_search_over_segments_equals_plain_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeywordIndex, "BLOCK_BITS", 3)
    monkeypatch.setattr(KeywordIndex, "FIRST_BLOCKS", 2)
    first, more = random_docs(150, 1), random_docs(60, 2, 1000)
    index = KeywordIndex(spark, str(tmp_path)).add(frame(spark, first).repartition(2))
    for docs in (first, [*first, *more]):
        if docs is not first:
            index.add(frame(spark, more).repartition(3))
        for query, limit in (("w0 w39 w17", 5), ("w1", 12), ("w38 w39", 300), ("w2 nowhere", 7)):
            assert [tuple(r) for r in index.search(query, limit).collect()] == plain_bm25(docs, query, limit), (query, limit)
    assert index.search("", 5).collect() == index.search("nowhere", 5).collect() == []


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeywordIndex, "BLOCK_BITS", 2)
    monkeypatch.setattr(KeywordIndex, "FIRST_BLOCKS", 1)
    docs = [(i, "rare rare rare" if i < 4 else f"rare {'filler ' * 50}") for i in range(400)]
    index = KeywordIndex(spark, str(tmp_path)).add(frame(spark, docs).coalesce(1).sortWithinPartitions("doc_id"))
    found = index.search("rare", 4)
    assert [r["doc_id"] for r in found.collect()] == [0, 1, 2, 3]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare)" in plan or "term" in plan.split("PushedFilters")[1][:200]


def test_words_are_counted_where_documents_are_read(spark, tmp_path):
    docs = [(i, " ".join(WORDS[:20])) for i in range(1000)]
    index = KeywordIndex(spark, str(tmp_path)).add(frame(spark, docs).repartition(2))
    assert spark.read.parquet(f"{index.root}/postings").count() <= 4 * 21  # a row for each word and block, not for each word and document
    assert [tuple(r) for r in index.search("w3", 3).collect()] == plain_bm25(docs, "w3", 3)


def test_documents_of_one_id_are_scored_apart(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path)).add(frame(spark, [(1, "a b"), (1, "a b"), (1, "c a"), (2, "b c")]).coalesce(1))
    assert [r["doc_id"] for r in index.search("a", 9).collect()] == [1, 1, 1]


def test_blocks_end_at_bytes_and_odd_texts_count(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeywordIndex, "BLOCK_BYTES", 60)
    docs = [*random_docs(40, 7), (70, "--"), (71, "\u212aw1 W1\u00fcw1 1w\x00w1"), (72, "w1" * 500 + " w1"), (73, " "), (74, "w1")]
    index = KeywordIndex(spark, str(tmp_path / "some")).add(frame(spark, docs).repartition(3))
    for query in ("w1", "kw1 w2", "w1" * 500, "w0 w1 1w"):
        assert [tuple(r) for r in index.search(query, 90).collect()] == plain_bm25(docs, query, 90), query
    index = KeywordIndex(spark, str(tmp_path / "none")).add(frame(spark, []))
    assert index.search("w1", 5).collect() == index.search("", 5).collect() == []
    index.add(frame(spark, [(1, None), (2, "")]))
    assert index.search("w1", 5).collect() == []
    named = spark.createDataFrame([("x", "w1 w2"), ("y", "w2 w2")], "name string, body string")
    assert [r["name"] for r in KeywordIndex(spark, str(tmp_path / "named"), "name").add(named, "body").search("w2", 5).collect()] == ["y", "x"]


def test_hybrid_search_keeps_a_row_for_each_word_and_block(spark, tmp_path):
    folder = str(tmp_path)
    docs = [(i, f"the license of that and version {' '.join(WORDS[: 1 + i % 30])}") for i in range(900)]
    frame(spark, docs).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [1.0, float(abs(i - 7)), 0.0], 0) for i in range(900)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    found = [(r["doc_id"], r["score"]) for r in QUERIES["hybrid_search"](spark, folder).collect()]
    near = [7, *sorted((i for i in range(900) if i != 7), key=lambda i: (abs(i - 7), i))][:50]
    best = [d for d, _ in plain_bm25(docs, "the license of that and version", 50)]
    score = {d: sum(0.5 / (61 + side.index(d)) for side in (near, best) if d in side) for d in {*near, *best}}
    assert found == [(d, pytest.approx(s, abs=1e-6)) for d, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]]
    assert spark.read.parquet(f"{keyword_index(spark, folder).root}/postings").count() <= 2 * 37  # 36 words and the documents themselves


def test_an_index_is_built_without_a_shuffle(spark, tmp_path):
    folder, context = str(tmp_path), spark.sparkContext
    docs = random_docs(300, 5)
    frame(spark, docs).repartition(3).write.parquet(f"{folder}/documents.parquet")
    written = spark.read.parquet(f"{folder}/documents.parquet")
    context.setJobGroup(folder, "the building")
    index = KeywordIndex(spark, f"{folder}/index").add(written)
    context.setLocalProperty("spark.jobGroup.id", None)
    ran = context.statusTracker()
    assert sum(len(ran.getJobInfo(job).stageIds) for job in ran.getJobIdsForGroup(folder)) == 1
    files = [r["f"] for r in spark.read.parquet(f"{index.root}/postings").selectExpr("_metadata.file_path AS f").distinct().collect()]
    for file in files:
        terms = [r["term"] or "" for r in spark.read.parquet(file).select("term").collect()]
        assert terms == sorted(terms) and len(terms) > 10
    assert [tuple(r) for r in index.search("w1 w30", 40).collect()] == plain_bm25(docs, "w1 w30", 40)


def test_hybrid_search_keeps_a_row_for_each_word_of_some_thousand_documents(spark, tmp_path):
    folder, words = str(tmp_path), "the license of that and version"
    docs = [(i, f"{words} {' '.join(WORDS[: 1 + i % 30])}") for i in range(2000)]
    frame(spark, docs).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [1.0, float(abs(i - 7)), 0.0], 0) for i in range(2000)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    near = [7, *sorted((i for i in range(2000) if i != 7), key=lambda i: (abs(i - 7), i))][:50]
    best = [d for d, _ in plain_bm25(docs, words, 50)]
    score = {d: sum(0.5 / (61 + side.index(d)) for side in (near, best) if d in side) for d in {*near, *best}}
    found = [(r["doc_id"], r["score"]) for r in QUERIES["hybrid_search"](spark, folder).collect()]
    assert found == [(d, pytest.approx(s, abs=1e-6)) for d, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:10]]
    assert spark.read.parquet(f"{keyword_index(spark, folder).root}/postings").count() == 37  # 36 words and the documents themselves


def test_a_changed_table_is_indexed_anew(spark, tmp_path):
    folder = str(tmp_path)
    frame(spark, [(1, "old words here")]).write.parquet(f"{folder}/documents.parquet")
    assert [r["doc_id"] for r in keyword_index(spark, folder).search("old", 3).collect()] == [1]
    frame(spark, [(2, "new words here")]).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert keyword_index(spark, folder).search("old", 3).collect() == []
    assert [r["doc_id"] for r in keyword_index(spark, folder).search("new", 3).collect()] == [2]


def test_vectors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(c % 5, 1.0) for c in range(8)] if i % 2 else [rng.gauss(-c, 0.5) for c in range(8)], i % 3) for i in range(600)]
    rows += [(900, [0.0] * 8, 0), (901, None, 1), (902, rows[7][1], 2)]
    units = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    index = VectorIndex(spark, str(tmp_path)).build(units)
    assert index.rows().count() == len(rows)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    query = rows[7][1]
    want = sorted(((i, (1 + cos(query, v)) / 2) for i, v, _ in rows if v and any(v)), key=lambda x: (-round(x[1], 6), x[0]))[:10]
    exact = [(r["vec_id"], r["certainty"]) for r in index.search(query, 10, exact=True).collect()]
    assert [i for i, _ in exact] == [i for i, _ in want] and [c for _, c in exact] == pytest.approx([c for _, c in want], abs=1e-5)
    near = {r["vec_id"] for r in index.search(query, 10).collect()}
    assert len(near & {i for i, _ in want}) >= 9
    queries = units.where("vec_id % 20 = 0 AND vec_id < 600").selectExpr("vec_id AS query_id", "embedding AS vector")
    found = index.recall(queries).collect()
    assert len(found) == 30 and sum(r["found"] for r in found) >= 0.9 * sum(r["wanted"] for r in found)


def test_recall_on_the_test_tables(spark):
    rows = QUERIES["vector_index_recall"](spark, "/root/testdata/sf0.01").collect()
    assert rows and all(r["wanted"] == 10 for r in rows) and sum(r["found"] for r in rows) >= 0.9 * 10 * len(rows)


def test_empty_vectors(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).build(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert index.search([1.0, 0.0]).collect() == []
