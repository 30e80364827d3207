"""License scan, decontamination, toxicity, mixing, language id and the pipeline."""

from __future__ import annotations

import random
import re
import sys
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import decontaminate, langid, license_scan, mixing, toxicity

SCHEMA = "doc_id long, text string, kept string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture
def documents(sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")


@pytest.mark.parametrize(("op", "module"), [("op4_license_scan", license_scan), ("op7_mix_sources", mixing)])
def test_equals_sql(spark, sf, documents, op, module):
    got = getattr(module, op)(spark, sf)
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({module.ORACLE})").fetchall()
    key = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))


# --- license scan ---------------------------------------------------------------------------------------------------


def test_templates_equal_patterns():
    rng = random.Random(4)
    for label, template in license_scan.TEMPLATES:
        automaton = license_scan.compile_template(label, template)
        pattern = re.compile(license_scan._pattern(template)[:-1] + r"(?= |$)")
        words = [w for w in re.findall(r"\S+", re.sub("<<[^>]*>>", " ", template))]
        for _ in range(300):
            text = [w for w in words if rng.random() < 0.93]
            for _ in range(rng.randint(0, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice([*words, "zz"]))
            assert bool(automaton.match(text)) == bool(pattern.match(" " + " ".join(text))), (template, text)


def _spoken(template):
    """A template's wording with its replaceable regions filled."""
    return re.sub(r"\s+", " ", re.sub(r"<<var:[^>]*>>", "someone", template).replace("<<optional>>", "").replace("<</optional>>", "")).strip()


def test_partial_licenses_are_not_labelled(spark):
    for label, template in license_scan.TEMPLATES[:3]:
        words = _spoken(template).split()
        cut = [words[: len(words) // 2], words[:-1], [*words[:-6], "not", *words[-6:]]]
        rows = [(0, "Before: " + " ".join(words).upper() + ". After"), *((i, " ".join(w)) for i, w in enumerate(cut, 1))]
        got = {r["doc_id"]: (label in r["labels"].split(","), r["score"]) for r in license_scan.scan_licenses(frame(spark, rows)).collect()}
        assert got[0] == (True, 1.0)
        assert all(not got[k][0] and got[k][1] <= 0.9 for k in (1, 2, 3)), label
    bare = _spoken(license_scan.TEMPLATES[0][1])
    bare = bare[bare.index("permission is") :]
    assert "license:mit" in license_scan.scan_licenses(frame(spark, [(1, bare)])).first()["labels"]
    with pytest.raises(ValueError):
        license_scan.compile_template("x", "one two <<optional>> three <</optional>> four five six")


def test_license_rows(spark):
    rows = [(1, "x Under the MIT license, under THE mit-license"), (2, None), (3, "..."), (4, "Licensed under the Apache License,\nVersion 2.0."), (4, "cc-by-nc cc by nc"), (5, "CC BY NCÉ"), (None, "licensed under the gnu affero general public license v3"), (6, "y " * 100_000 + "under the mit license")]
    got = sorted(repr((r["doc_id"] or 0, *tuple(r)[1:])) for r in license_scan.scan_licenses(frame(spark, rows)).collect())
    want = [
        (0, 9, 0, None, None, "", "notice:gpl", 1.0),
        (1, 9, 2, 1, 5, "mit", "mit", 0.9),
        (2, 0, 0, None, None, "", "", 0.0),
        (3, 0, 0, None, None, "", "", 0.0),
        (4, 8, 1, 3, 3, "apache-2", "apache-2,notice:apache-2", 1.0),
        (4, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 0.9),
        (5, 3, 0, None, None, "", "", 0.0),
        (6, 100_004, 1, 100_000, 100_000, "mit", "mit", 0.9),
    ]
    assert got == sorted(map(repr, want))
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


# --- decontamination ------------------------------------------------------------------------------------------------

ITEM = "A train leaves Springfield at 60 km per hour with 12 cars. Alice counts 12 cars and 60 wheels before the bridge near the old mill."


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, "Six words stand in this item"), (3, "too short"), (None, ITEM), (4, None)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination(spark, items):
    renamed = ITEM.replace("Springfield", "Shelbyville").replace("60", "75").replace("12", "9").replace("km", "miles").replace("Alice", "Carol")
    mixed = renamed.replace("Carol counts 9", "Carol counts 44")
    rows = [(1, "Before. " + ITEM + " After."), (2, "Before. " + renamed), (3, mixed), (4, "nothing of this kind " * 30), (5, None), (6, ""), (7, "now six words stand in this item, there"), (8, "too short"), (9, ITEM[:60])]
    got = {r["doc_id"]: (r["item_ids"], r["verbatim"], r["kept"]) for r in decontaminate.contamination(frame(spark, rows), items).collect()}
    assert got[1] == ([1], True, False)
    assert got[2] == ([1], False, False)
    assert got[7] == ([2], True, False)
    assert all(got[k] == ([], False, True) for k in (4, 5, 6, 8))
    assert got[3] == ([1], False, False)
    left = decontaminate.remove_contaminated(frame(spark, rows), items)
    assert {r["doc_id"] for r in left.collect()} == {k for k, v in got.items() if v[2]}
    assert left.columns == ["doc_id", "text", "kept", "size"]


def test_inconsistent_slots_are_no_copy(spark):
    item = "the box holds 5 balls and 5 cubes and then 5 rings lie over it"
    docs = [(1, item.replace("5", "8")), (2, "the box holds 1 balls and 2 cubes and then 3 rings lie over it")]
    got = {r["doc_id"]: r["kept"] for r in decontaminate.contamination(frame(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True}


def test_consistent_stretches_count(spark):
    """A conflict ends a stretch, not the alignment, and two item values may go to the same one."""
    sums = "Take 3 of the red pens and 5 of the blue pens to the 2 boxes on the table"
    late = "Put 7 red lamps near 9 doors, then 7 green lamps near the long wall of the old house by the lake"
    docs = [
        (1, ITEM.replace("60 wheels", "61 wheels")),
        (2, sums.replace("3", "4").replace("5", "4").replace("2", "9")),
        (3, late.replace("7 red", "8 red").replace("9", "2")),
        (4, "Put 8 red lamps near 2 doors, then 6 green lamps near nothing at all"),
    ]
    bench = spark.createDataFrame([(1, ITEM), (2, sums), (3, late)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["n_words"], r["verbatim"], r["kept"]) for r in decontaminate.contamination(frame(spark, docs), bench).collect()}
    assert got == {1: ([1], 20, True, False), 2: ([2], 19, False, False), 3: ([3], 20, True, False), 4: ([], 0, False, True)}
    left = decontaminate.remove_contaminated(frame(spark, docs), bench)
    assert [r["doc_id"] for r in left.collect()] == [4]


def test_readings(spark):
    """Names that begin sentences, copies in other case or with other line breaks, and numbers with separators."""
    tom = "Tom has 12 red marbles. Anna gives Tom 5 more. Tom then loses 3. How many does Tom have?"
    town = "Near Ulm the river Danube meets Blau, and from Ulm to Passau the Danube flows east past Regensburg"
    coins = "The chest holds 950 coins while the other one by the door holds 3.5 kg of silver and 20 of lead"
    docs = [
        (1, tom.replace("Tom", "Raj").replace("Anna", "Mei")),
        (2, town.lower()),
        (3, town.replace(" Danube", "\nDanube").replace(" Passau", "\nPassau")),
        (4, coins.replace("950", "1,250").replace("3.5", "4").replace("20", "1,000.75")),
        (5, "Raj has 4 green boxes. Mei takes Raj 9 less. Raj then finds 2. How few does Mei want?"),
    ]
    bench = spark.createDataFrame([(1, tom), (2, town), (3, coins)], "item_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["n_words"], r["verbatim"], r["kept"]) for r in decontaminate.contamination(frame(spark, docs), bench).collect()}
    assert got == {1: ([1], 19, False, False), 2: ([2], 18, True, False), 3: ([2], 18, True, False), 4: ([3], 21, False, False), 5: ([], 0, False, True)}
    left = decontaminate.remove_contaminated(frame(spark, docs), bench)
    assert [r["doc_id"] for r in left.collect()] == [5]


def plain_readings(text, joined):
    """Words and their kinds by reading, with regular expressions."""
    number = r"\d+(?:[.,]\d+)*" if joined else r"\d+"
    tokens = list(re.finditer(rf"(?a:{number}(?![A-Za-z0-9\u0080-\U0010ffff]))|[A-Za-z0-9\u0080-\U0010ffff]+", text))
    if joined:  # a letter beside joined digits makes one word of all
        tokens = list(re.finditer(r"(?:[A-Za-z0-9\u0080-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text))
    words, kinds, end = [], [[], [], []], None
    for m in tokens:
        word = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])
        begins = end is None or re.search("[.!?:\n]", text[end : m.start()]) is not None
        is_number = re.fullmatch("[0-9.,]+", m[0]) is not None
        after = bool(kinds[0]) and kinds[0][-1] == "<number>"
        kind = "<number>" if is_number else "<unit>" if word in decontaminate.UNITS and after and not begins else "<name>" if "A" <= m[0][0] <= "Z" and not begins else ""
        kinds[0].append(kind)
        kinds[1].append("")
        kinds[2].append("<name>" if not is_number and "A" <= m[0][0] <= "Z" and begins else kind)
        words.append(word)
        end = m.end()
    return words, kinds


def plain_contamination(doc, item):
    """(longest stretch that counts, whether one is verbatim) from every pair of windows and every stretch."""
    best, equal = 0, False
    for joined in (False, True):
        (words, kinds), (own, item_kinds) = plain_readings(doc, joined), plain_readings(item, joined)
        if len(own) < 5 or joined and "<number>" not in item_kinds[0]:
            continue
        size = min(8, len(own))
        by_word = {}
        enough = lambda r, kinds: r == 1 or kinds.count("") >= 2
        for r in range(3):
            for j in range(len(own) - size + 1):
                if not enough(r, item_kinds[r][j : j + size]):
                    continue
                by_word.setdefault((r, tuple(k or w for k, w in zip(item_kinds[r][j : j + size], own[j : j + size]))), []).append(j)
        hits = {}
        for r in range(3):
            for i in range(len(words) - size + 1):
                for j in () if not enough(r, kinds[r][i : i + size]) else by_word.get((r, tuple(k or w for k, w in zip(kinds[r][i : i + size], words[i : i + size]))), ()):
                    hits.setdefault((i - j, i), set()).add(r)
        for some in (set(hits), {k for k, v in hits.items() if 0 in v}):
            for gap in {g for g, _ in some}:
                covered = sorted({i + k for g, i in some if g == gap for k in range(size)})
                while covered:
                    n = next((k for k in range(1, len(covered)) if covered[k] != covered[k - 1] + 1), len(covered))
                    stretch, covered = covered[:n], covered[n:]
                    pairs = [(own[i - gap], words[i], bool(kinds[0][i] or item_kinds[0][i - gap]) or own[i - gap] != words[i]) for i in stretch]

                    def consistent(lo, hi):
                        to = {}
                        return all(to.setdefault(a, b) == b for a, b, slot in pairs[lo:hi] if slot)

                    found, half = [], min(12, (len(own) + 1) // 2)
                    found += [(hi - lo, False) for lo in range(n) for hi in range(lo + 12, n + 1) if consistent(lo, hi)]
                    lo = 0
                    while lo < n:
                        hi = max(h for h in range(lo + 1, n + 1) if consistent(lo, h))
                        found += [(hi - lo, False)] * (hi - lo >= half)
                        lo = hi
                    found += [(hi - lo, True) for lo in range(n) for hi in range(lo + half, n + 1) if all(a == b for a, b, _ in pairs[lo:hi])]
                    best, equal = max([best, *(x for x, _ in found)]), equal or any(v for _, v in found)
    return best, equal


def test_contamination_equals_plain_program(spark):
    """Both ways, on texts made of pieces of items with other numbers, names, units, case and line breaks."""
    rng = random.Random(77)
    pool = ["the", "box", "holds", "red", "balls", "near", "door", "Ulm", "Raj", "Mei", "12", "5", "3.5", "1,250", "kg", "km", "miles", "old", "mill", "and", "counts"]
    sentence = lambda n: " ".join(rng.choice(pool) + rng.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(n))
    bench = [(i, sentence(rng.choice([3, 5, 6, 7, 8, 9, 13, 25, 40]))) for i in range(40)]
    bench += [(100, bench[5][1]), (5, bench[9][1]), (None, sentence(9)), (101, None)]
    swap = {"12": "9", "5": "44", "Raj": "Bo", "kg": "g", "3.5": "7", "1,250": "2,000"}
    docs = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(bench[:40])[1].split(" ")
            lo = rng.randint(0, len(words))
            words = words[lo : lo + rng.randint(1, 40)]
            if rng.random() < 0.6:
                some = {k: rng.choice([v, "8"]) for k, v in swap.items()}
                words = [some.get(w, w) if rng.random() < 0.95 else rng.choice(pool) for w in words]
            piece = " ".join(words)
            parts.append(piece.lower() if rng.random() < 0.2 else piece)
        docs.append((rng.choice([len(docs), len(docs), None, 3]), rng.choice([" ", ". "]).join(parts)))
    docs += [(7, None), (8, ""), docs[0]]
    key = lambda r: repr(r)
    found = {t: {i: plain_contamination(t, x) for i, x in bench if i is not None and x is not None and i != 5} for _, t in docs if t}
    for t in found:
        both = [plain_contamination(t, x) for i, x in bench if i == 5]
        found[t][5] = max(n for n, _ in both), any(v for _, v in both)
    want = []
    for d, t in docs:
        held = {i: v for i, v in found.get(t, {}).items() if v[0]}
        want.append((d, sorted(held), max((n for n, _ in held.values()), default=0), any(v for _, v in held.values()), not held))
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))
    assert 60 < sum(not w[4] for w in want) < 240
    left = decontaminate.remove_contaminated(frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(key((r["doc_id"], r["text"])) for r in left.collect()) == sorted(key(d) for d, w in zip(docs, want, strict=True) if w[4])


def test_contamination_of_documents_equals_plain_program(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r["text"]) < 2500]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d: sorted(i for i, x in bench if plain_contamination(t, x)[0]) for d, t in docs}
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.op5_decontaminate(spark, sf).collect()}
    assert any(want.values()) and {d: got[d] for d in want} == want


def test_filter_only_saves_work(spark, monkeypatch, items):
    """A filter so small that everything passes gives the same rows."""
    docs = frame(spark, [(1, "x " + ITEM), (2, "nothing of this kind " * 30), (None, ITEM), (None, "clean"), (1, ITEM)])
    whole = sorted(map(repr, decontaminate.contamination(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)
    assert sorted(map(repr, decontaminate.contamination(docs, items).collect())) == whole and len(whole) == 5


@pytest.mark.parametrize("kind", ["numbers", "names", "within"])
def test_rows_of_placeholders_are_kept(spark, kind):
    """Tables of numbers, lists of names and a row of numbers in other words meet no item, and few rows are joined."""
    rng, n = random.Random(3), 60
    names = ["Ada", "Bo", "Cy", "Di", "Ed", "Flo", "Gus", "Hal", "Ida", "Jo", "Kim", "Lou", "Mia", "Ned", "Oda", "Pia"]

    def text(i):
        if kind == "names":
            return "we saw " * (i % 2) + " ".join(rng.choice(names) + str(rng.randint(0, 99)) for _ in range(40))
        row = " ".join(str(rng.randint(0, 10**6)) for _ in range(40 if kind == "numbers" else 14))
        return row if kind == "numbers" else f"{'the first list of' if i < n else 'another long row with'} {row} {'ends here' if i < n else 'is done now'}"

    bench = spark.createDataFrame([(i, text(i)) for i in range(n)], "item_id long, text string")
    docs = [(i, text(n + i)) for i in range(n)]
    same = bench.where("item_id = 7").first()["text"]
    got = {r["doc_id"]: (r["item_ids"], r["verbatim"]) for r in decontaminate.contamination(frame(spark, [*docs, (999, f"so {same} so")]), bench).collect()}
    items, verbatim = got.pop(999)
    assert 7 in items and verbatim and got == {i: ([], False) for i in range(n)}
    left = decontaminate.remove_contaminated(frame(spark, [*docs, (999, same)]), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(n))


def test_long_text(spark, items):
    docs = frame(spark, [(1, "word " * 300_000 + ITEM), (2, "word " * 300_000)])
    assert {r["doc_id"]: r["kept"] for r in decontaminate.contamination(docs, items).collect()} == {1: False, 2: True}


def test_no_items(spark, items):
    assert decontaminate.contamination(frame(spark, [(1, ITEM)]), items.limit(0)).first()["kept"]
    assert decontaminate.contamination(frame(spark, []), items).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    """Trained on every other document, judged on the rest."""
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), toxicity.chain_labels(spark.read.parquet(f"{big}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, labels.where("doc_id % 2 = 0"), toxicity.CHAIN).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic, clean = [r for r in scored if r["toxic"]], [r for r in scored if not r["toxic"]]
    assert np.mean([not r["kept"] for r in toxic]) > 0.85
    assert np.mean([r["kept"] for r in clean]) > 0.995


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, 1)], "doc_id long, low_quality int, toxic int")
    docs = frame(spark, [(i, "foo bar idiot" if i % 2 else "foo bar fine") for i in range(40)] + [(90, None), (91, ""), (None, "idiot idiot"), (92, "idiot " * 60_000)])
    got = {r["doc_id"]: r["kept"] for r in toxicity.score_toxicity(docs, labels, toxicity.CHAIN).collect()}
    assert not got[1] and got[2] and not got[92] and len(got) == 44
    none = toxicity.score_toxicity(docs, labels.limit(0), toxicity.CHAIN).collect()
    assert all(r["kept"] for r in none)
    assert toxicity.score_toxicity(docs.limit(0), labels, toxicity.CHAIN).count() == 0
    left = toxicity.reject_toxic(docs, labels, toxicity.CHAIN)
    assert left.columns == docs.columns and left.count() == sum(got.values()) and 1 not in {r["doc_id"] for r in left.collect()}


def test_repeated_labels_and_ids_train_once(spark):
    """Of rows of one id the smallest text, of its labels the largest, whatever their order."""
    docs = frame(spark, [(i, "foo bar idiot" if i % 2 else "foo bar fine") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, low_quality int, toxic int")
    more = docs.union(frame(spark, [(3, "zz later text"), (3, "foo bar idiot"), (4, "zz idiot")]))
    twice = labels.union(spark.createDataFrame([(3, 0, 0), (5, 1, 0)], labels.schema))
    want = {r["doc_id"]: r["p_toxic"] for r in toxicity.score_toxicity(docs, labels, toxicity.CHAIN).collect()}
    for d, x in ((docs, twice), (more, labels), (more.repartition(3), twice.repartition(2))):
        got = {r["doc_id"]: r["p_toxic"] for r in toxicity.score_toxicity(d, x, toxicity.CHAIN).where("doc_id not in (3, 4)").collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if k not in (3, 4)})


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    n = 600
    first, second = rng.integers(0, 2, n), rng.integers(0, 2, n)
    features = np.stack([100 + first, 200 + second, np.full(n, 300)], 1).ravel()
    sample = toxicity.Sample(np.arange(n + 1) * 3, features, np.log1p(np.tile([1, 1, 2], n)).astype(np.float32))
    labels = np.stack([first, first], 1)
    models = toxicity.fit_chain(sample, labels, np.arange(n) % 5)
    assert len(models[1].weights) == len(models[1].chosen) + 1
    assert models[1].weights[-1] > 0


# --- mixing ---------------------------------------------------------------------------------------------------------


def test_mixing_targets(spark):
    rng = random.Random(8)
    sizes = {"a": 20, "b": 3000, None: 500, "É": 40, "z": 900}
    rows = []
    for source, total in sizes.items():
        while total > 0:
            n = min(total, rng.randint(0, 120))
            total -= n
            rows.append((len(rows), " ".join(["w"] * n) if n else rng.choice([None, "", " "]), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    by = {i: s for i, _, s in rows}
    order, everything = ["a", "b", "z", "É", None], sum(sizes.values())
    weight, free, level = dict(zip(order, (5, 2, 1, 5, 2), strict=True)), set(order), 0.0
    while True:
        level = (everything - sum(3 * sizes[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        free -= over
    taken = Counter()
    for r in got:
        taken[by[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = by[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(level * weight[s] if s in free else 3 * sizes[s])
    for r in got:
        assert abs(taken[by[r["doc_id"]]] - r["target"]) < 1
    assert mixing.mix(docs.limit(0)).count() == 0


def test_prefixes_of_the_schedule_keep_to_the_targets(spark, sf):
    """After any number of slots each source has had its share of them to within a few."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = docs.select("source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).alias("n")).groupBy("source").agg(F.sum("n").cast("long").alias("source_size"))
    targets = mixing.source_targets(sizes).collect()
    total = sum(int(t["target"]) for t in targets)
    highs = np.cumsum([int(t["target"]) for t in sorted(targets, key=lambda t: t["place"])]) / total
    slots = spark.range(-(-total // 256)).mapInArrow(mixing._placed(highs, np.arange(len(highs), dtype=np.int32)), "id long, place int").orderBy("id").collect()
    had = np.zeros(len(highs))
    for k, row in enumerate(slots, 1):
        had[row["place"]] += 1
        assert np.abs(had - k * np.diff(highs, prepend=0)).max() < 4
    got = mixing.op7_mix_sources(spark, sf).join(docs.select("doc_id", "source"), "doc_id").where("taken > 0").collect()
    share = {t["source"]: t["target"] / total for t in targets}
    for most in (len(slots) // 4, len(slots) // 2):  # documents that have come up by a slot, by source
        early = Counter(r["source"] for r in got if r["first_slot"] < most)
        assert set(early) == {s for s, x in share.items() if x > 0.01} | (set(early) - {s for s, x in share.items() if x > 0.01})
    assert all(r["slots"] >= 1 and r["first_slot"] >= 0 for r in got)


def test_mixing_ties_and_long_texts(spark):
    """Equal ids and texts share a place in the order; a long text covers many blocks; runs agree."""
    rows = [(1, "w " * 100_000, "s"), (2, "a b", "s"), (2, "a b", "s"), (2, "a c", "s"), (3, "x " * 500, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(mixing.mix(docs).collect(), key=key)
    assert got == sorted(mixing.mix(docs.repartition(3)).collect(), key=key) and len(got) == 5
    assert all(r["taken"] <= 3 * r["size"] for r in got) and max(r["slots"] for r in got) > 350


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", "s", 1), (1, "a b", "s", 1), (1, "a b", "s", 1), (2, None, "t", 1)], "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) == 7


# --- language id ----------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    out = langid.op8_language_id(spark, "/root/testdata/sf0.1")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(docs, "doc_id")
    assert held.where("lang_pred = lang").count() / held.count() > 0.99


def test_viterbi_equals_a_plain_program():
    rng = np.random.default_rng(7)
    langs, sizes = 3, [0, 1, 7, 30, 0, 12]
    model = langid.Model(["a", "b", "c"], np.ones((langid.BINS, langs)), np.ones((langid.SCRIPTS, langs)))
    scores = rng.normal(size=(sum(sizes), langs)).astype(np.float32) * 4
    first = np.concatenate([[0], np.cumsum(sizes)])
    label = model.spans(scores.copy(), first, 3.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if a == b:
            continue
        best, back = scores[a].astype(float), []
        for t in range(a + 1, b):
            step = best[:, None] - 3.0 * (1 - np.eye(langs))
            back.append(step.argmax(0))
            best = step.max(0) + scores[t]
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        total = lambda p: sum(scores[a + i][x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert total(label[a:b].tolist()) == pytest.approx(total(path[::-1]), abs=1e-3)


def test_scripts_are_ranges_of_letters():
    names = {"LATIN": "latin", "GREEK": "greek", "CYRILLIC": "cyrillic", "HEBREW": "hebrew", "ARABIC": "arabic", "HANGUL": "hangul", "CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "ARMENIAN": "armenian", "GEORGIAN": "georgian", "DEVANAGARI": "south asian", "THAI": "southeast asian"}
    wrong = []
    for point in range(0x10000):
        c, kind = chr(point), unicodedata.category(chr(point))
        if kind in ("Cs", "Cn", "Co"):
            continue
        number = set(langid._scripts(np.frombuffer(c.encode(), np.uint8))[0].tolist())
        assert len(number) == 1
        script = "" if number == {langid._NO_LETTER} else langid.SCRIPT_NAMES[number.pop()]
        want = names.get(unicodedata.name(c, "").split(" ")[0])
        if kind[0] == "L" and want and script not in (want, "mark"):
            wrong.append(point)
        if kind in ("Po", "Pi", "Pf", "Ps", "Pe", "Zs", "Nd") and point < 0x3000 and 0x700 > point or 0x2000 <= point < 0x2C00:
            assert script == "" or kind[0] in "LM" or point in (0x55A, 0x5BE, 0x5C0, 0x5C3, 0x5C6), hex(point)
    assert not wrong, [hex(x) for x in wrong]


def test_every_letter_is_judged(spark):
    """No letter alone gives und, and no text without one gives a language."""
    model = langid.Model(["a", "b"], np.ones((langid.BINS, 2)), np.ones((langid.SCRIPTS, 2)))
    points = [p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) != "Cs"]
    for some in (points[i : i + 50_000] for i in range(0, len(points), 50_000)):
        texts = [chr(p).encode() for p in some]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        scores, first, letters = model.word_scores(data, offsets)
        kinds = np.array([unicodedata.category(chr(p))[0] == "L" for p in some])
        assert (letters == kinds).all()
        assert (np.diff(first)[kinds] == 1).all() and len(scores) == first[-1]
    docs = spark.createDataFrame([(1, "the tree", "en"), (2, "\u211d \u2115", None), (3, "\u207f", None), (4, "\u3031", None), (5, "\u0301 \u20ac 5", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, F.col("doc_id") > 1).collect()}
    assert got == {1: "en", 2: "en", 3: "en", 4: "en", 5: "und"}


def test_apostrophes_and_quotes_are_no_script():
    data = np.frombuffer("it\u2019s \u201cdone\u201d \u2013 caf\u00e9 \u0434\u043e\u043c e\u0301t".encode(), np.uint8)
    _, at, scripts, first, _ = langid._grams(data, np.array([0, len(data)]))
    assert [langid.SCRIPT_NAMES[s] for s in scripts] == ["latin", "latin", "latin", "latin", "cyrillic", "latin"] and first[-1] == 6


def test_language_ties_repeats_and_clashing_names(spark):
    rows = [(i, "la casa y el mar " * 4, "b", "x", True) for i in range(10)] + [(20 + i, "la casa y el mar " * 4, "a", "x", True) for i in range(10)]
    rows += [(100, "la casa", None, "x", True), (100, "la casa", None, "x", True), (100, None, None, "x", True), (101, "the " * 3, None, "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, held_out boolean")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, F.col("doc_id") >= 100).where("held_out").collect()]
    assert sorted(got) == [(100, "a"), (100, "a"), (100, "und"), (101, "a")]


def test_language_odd_rows(spark):
    rows = [(i, "the house and the tree " * 5, "en") for i in range(20)] + [(50 + i, "дом и дерево " * 5, "ru") for i in range(20)]
    odd = [(100, None, None), (101, "", "en"), (102, "123 — !!", "en"), (None, "the tree", None), (103, "дерево", None), (104, "the house and the tree", None), (105, "日本", None), (106, "the house " * 5 + "дом и дерево " * 20, None), (107, "the house " * 40_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, F.coalesce(F.col("doc_id") >= 100, F.lit(True))).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103] == ("ru", 1.0) and got[104] == ("en", 1.0) and got[107] == ("en", 1.0) and got[None][0] == "en"
    assert got[106][0] == "ru" and 0.7 < got[106][1] < 1
    assert got[105][0] in ("en", "ru")
    unlearned = langid.identify(docs, F.lit(True)).collect()
    assert {r["lang_pred"] for r in unlearned} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(False)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_keeps_rows_without_an_id(spark, sf):
    docs = spark.createDataFrame([(None, "some words here that are fine", None, None, None), (3, None, None, None, None)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert sorted(r["doc_id"] or 0 for r in docs.collect()) == [0, 3]
