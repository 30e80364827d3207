"""The quality classifier against a plain program with named features, and on held-out labels."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import quality
from skein.llm import textbytes as tb

SCHEMA = "doc_id long, text string"


def named(text):
    """Features by name, each with its share."""
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff\x20\x09-\x0d]+", text or "")
    low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words]
    forms = []
    for w in words:
        n = len(re.findall("[A-Z]", w))
        sign = not re.match(r"[0-9A-Za-z\x80-\U0010ffff]", w)
        forms.append(("sign", w) if sign else "lower" if n == 0 else "first" if n == 1 and w[0].isascii() and w[0].isupper() else "capitals")
    grams = [("w", w) for w in low] + [("f", f) for f in forms]
    for i in range(1, len(words)):
        grams += [("r",) if low[i] == low[i - 1] else ("ww", low[i - 1], low[i]), ("ff", forms[i - 1], forms[i])]
    return {g: n * quality.SCALE / len(grams) for g, n in Counter(grams).items()}


def plain_scores(texts, training):
    """training: (text, label) in order."""
    labels = [y for _, y in training]
    if len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels) if labels else 0.5, 1e-6), 1 - 1e-6)
        return [share] * len(texts)
    z, n = defaultdict(float), defaultdict(float)

    def weight(g):
        if abs(z[g]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[g]) - z[g]) / ((quality.BETA + math.sqrt(n[g])) / quality.ALPHA + quality.L2)

    def score(x):
        return 1 / (1 + math.exp(-sum(weight(g) * v for g, v in x.items())))

    for _ in range(quality.PASSES):
        for text, y in training:
            x = {**named(text), "constant": 1.0}
            p = score(x)
            old = {g: weight(g) for g in x}
            for g, v in x.items():
                slope = (p - y) * v
                sigma = (math.sqrt(n[g] + slope * slope) - math.sqrt(n[g])) / quality.ALPHA
                z[g] += slope - sigma * old[g]
                n[g] += slope * slope
    return [score({**named(t), "constant": 1.0}) for t in texts]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def random_texts(n, seed):
    rng, words = random.Random(seed), ["The", "cat", "sat.", "Über", "SAT!!", "%%%", "on", "mat,", "a", "A"]
    return [(i, None if i % 17 == 0 else " ".join(rng.choice(words[: 4 + 6 * (i % 2)]) for _ in range(rng.choice((0, 1, 2, 9, 30))))) for i in range(n)]


def run(spark, docs, labels, tmp_path):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return quality.op13_quality(spark, str(tmp_path)).collect()


def test_op13_equals_plain_program(spark, tmp_path):
    docs = random_texts(120, 3) + [(500, "  \n "), (501, ""), (None, "The cat"), (502, "Twice."), (502, "Once."), (503, "long " * 300_000), (504, "x" * 1_200_000)]
    labels = [(i, i % 2, 0) for i in range(0, 90)] + [(90, None, 1), (None, 1, 0), (91, 0, 0), (91, 1, 0), (502, 1, 0), (503, 0, 0), (9_999, 1, 0)]
    got = run(spark, docs, labels, tmp_path)
    of = {}
    for i, y, _ in labels:
        if i is not None and y is not None and not held(i):
            of[i] = max(of.get(i, 0), y)
    order = [r[0] for r in spark.createDataFrame([(i,) for i in of], "i long").orderBy(F.xxhash64("i"), "i").collect()]
    texts = {}
    for i, t in docs:
        if i in of:
            texts[i] = min(texts.get(i, "\U0010ffff"), t or "")
    want = plain_scores([t for _, t in docs], [(texts[i], of[i]) for i in order if i in texts])
    assert len(got) == len(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    pairs = zip(sorted((r["doc_id"], r["score"], r["held_out"], r["predicted"]) for r in got if r["doc_id"] is not None), sorted((d[0], w) for d, w in zip(docs, want) if d[0] is not None))
    for (i, score, out, predicted), (j, w) in pairs:
        assert i == j and score == pytest.approx(w, abs=1e-5) and out == held(i) and predicted == int(score >= 0.3)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False] and key


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.op13_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    above = np.mean([a > b for a in good for b in bad])
    assert len(rows) > 50 and right > 0.95 and above > 0.99


def test_no_labels_one_class_and_empty_tables(spark, tmp_path):
    docs = [(1, "a"), (2, None)]
    assert [r["score"] for r in run(spark, docs, [], f"{tmp_path}/a")] == [pytest.approx(0.5)] * 2
    one = [(i, 1, 0) for i in (1, 2) if not held(i)]
    assert all(r["score"] > 0.99 for r in run(spark, docs, one, f"{tmp_path}/b"))
    assert run(spark, [], [(1, 1, 0)], f"{tmp_path}/c") == []


def test_other_columns(spark):
    docs = spark.createDataFrame([("x", "A b.", 1, 2), ("y", "%%% b", 0, 3)], "name string, body string, label int, score int")
    labels = spark.createDataFrame([("x", 1), ("y", 0)], "name string, good int")
    got = quality.score_quality(docs, labels, lambda _: F.lit(False), "good", "name", "body").orderBy("name").collect()
    assert [r["predicted"] for r in got] == [1, 0] and got[0].asDict().keys() == {"name", "held_out", "score", "predicted"}


def test_pieces_of_a_text_make_the_same_grams(monkeypatch):
    text = " ".join(random.Random(5).choice(("The", "the", "cat!", "a", "Ünder  ", "SAT!!", "\n")) for _ in range(4000)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = Counter(f for _, fs in quality._grams(data, offsets) for f in fs.tolist())
    monkeypatch.setattr(tb.runs, "__defaults__", (200,))
    monkeypatch.setattr(tb, "RUN_BYTES", 200)
    assert Counter(f for _, fs in quality._grams(data, offsets) for f in fs.tolist()) == whole
