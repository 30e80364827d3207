"""The pipeline's stages and the whole run against plain programs that give the exact rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from skein.llm import mixing, token_store, toxicity
from tests.llm.test_dedup import plain_components
from tests.llm.test_labels import plain_contamination

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Families of near copies, passages of items as they are and with other values, toxic texts, odd rows."""
    rng, root = random.Random(31), tmp_path_factory.mktemp("tables")
    words = [f"word{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{say(6)} Tom buys {i + 2} kg of {say(5)} near Ulm and {i + 2} of {say(6)}") for i in range(12)]
    texts = []
    for _ in range(12):
        base = say(rng.randint(30, 90)).split()
        for _ in range(rng.randint(1, 7)):
            texts.append(" ".join(rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base))
    for _ in range(25):
        item = rng.choice(items)[1]
        if rng.random() < 0.6:
            item = item.replace("Tom", "Ann").replace("Ulm", rng.choice(["Bern", "Rome"])).replace("kg", rng.choice(["g", "kg"]))
        part = item.split()
        texts.append(f"{say(12)}. {' '.join(part[rng.randint(0, 8) :])} {say(20)}")
    texts += [say(rng.randint(5, 40)) + " idiot scum" for _ in range(15)] + [say(rng.randint(0, 60)) for _ in range(40)] + ["", " ", None]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    labels = [(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def plain_dedup(rows):
    found = plain_components([r[:2] for r in rows], 5, 80)
    return [r for r in rows if found[r[0]][1] == r[0]]


def plain_decontamination(rows, items):
    return [r for r in rows if not any(plain_contamination(r[1] or "", t)[0] for _, t in items)]


def plain_mix(spark, rows, root):
    """The mix by SQL, then the nearest whole number of each document's share (halves go up)."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/mixed.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{root}/mixed.parquet/*.parquet')")
    taken = {d: (n, s) for d, n, s in con.sql(f"SELECT doc_id, taken, size FROM ({mixing.ORACLE})").fetchall()}
    return [r for r in rows for _ in range(1 if taken[r[0]][1] == 0 else int(taken[r[0]][0] / taken[r[0]][1] + 0.5))]


def plain_tokens(rows):
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(token_store.default_tokenizer()), [], 0
    for d, t, *_ in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def read(spark, folder, table="documents"):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_every_stage_equals_a_plain_program(spark, folder, tmp_path):
    docs, items = read(spark, folder), [tuple(r) for r in read(spark, folder, "benchmark").collect()]
    want = rows_of(STAGES["toxicity"](spark, docs, folder))
    labels = toxicity.chain_labels(read(spark, folder, "labels"))
    kept = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels, toxicity.CHAIN).where("kept").collect()}
    assert [r[0] for r in want] == sorted(kept) and len(docs.columns) == 5
    assert sum("idiot" in (r[1] or "") for r in want) <= 4 and len(want) > 90
    plain = {
        "minhash_dedup": plain_dedup,
        "decontamination": lambda rows: plain_decontamination(rows, items),
        "source_mixing": lambda rows: plain_mix(spark, rows, tmp_path),
        "token_output": plain_tokens,
    }
    for name, program in plain.items():
        before = spark.createDataFrame(want, SCHEMA)
        want = program(want)
        got = STAGES[name](spark, before, folder)
        assert name == "token_output" or got.columns == before.columns
        assert rows_of(got.select("doc_id", "start", "n_tokens", "ids_crc32") if name == "token_output" else got) == sorted(want), name
        assert 0 < len(want) and (name == "token_output" or len(want) != before.count()), name
    assert rows_of(corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")) == sorted(want)


def test_output_stays(spark, folder, tmp_path):
    spark.conf.set(corpus_pipeline.OUTPUT, f"file://{tmp_path}/out")
    try:
        out = STAGES["token_output"](spark, read(spark, folder), folder).collect()
    finally:
        spark.conf.unset(corpus_pipeline.OUTPUT)
    (run,) = (tmp_path / "out").iterdir()
    shards = token_store.Shards(spark.read.parquet(f"file://{run}/manifest"))
    assert all(len(shards.get(r["doc_id"])) == r["n_tokens"] for r in out)


def test_near_dedup_of_repeated_ids(spark, sf):
    """Each row's text is compared and one row of each group stays."""
    text, other, far = "a b c d e f g h", "n o p q r s t u v", "one two three four five six"
    rows = [(5, text), (5, text), (5, other), (3, other), (9, other + " w"), (9, far), (9, far), (None, text), (None, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = STAGES["minhash_dedup"](spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got.collect()), key=repr) == sorted([(0, text), (0, text), (3, other), (5, text), (9, far)], key=repr)


def test_clashing_columns(spark, folder):
    """Columns that the operators name themselves pass through all stages but the last."""
    docs = read(spark, folder)
    for name in ("kept", "number", "row", "text_key", "contaminated_text_key", "copies", "of", "copy", "share", "component_id", "p_toxic"):
        docs = docs.withColumn(name, docs["doc_id"])
    columns, before = docs.columns, Counter(r["doc_id"] for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    assert 0 < docs.count() and set(r["kept"] for r in docs.collect()) <= set(before)


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        read(spark, folder, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
