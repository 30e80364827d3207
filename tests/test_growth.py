"""Steps that once grew faster than their input: their results against plain programs, and what their plans no longer hold."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators import classes, graph, timewin
from skein.operators.index import VectorIndex
from skein.plans.registry import QUERIES
from skein.sources import cache, store


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replay_of_many_flushes(spark):
    rng, start = random.Random(5), datetime(2024, 1, 1)
    ops = [(rng.choice("nm"), rng.choice("abc"), rng.choice(("get", "get", "set", "delete", "flush")), str(i), start + timedelta(minutes=rng.randrange(900)), i) for i in range(600)]
    log = spark.createDataFrame(ops, "namespace string, key string, op string, value string, at timestamp, seq long").repartition(3)
    held, generation, want, last = {}, {"n": 0, "m": 0}, {}, start + timedelta(minutes=700)
    alive = {}
    for ns, key, op, value, at, seq in sorted(ops, key=lambda r: (r[4], r[5])):
        if op == "flush":
            generation[ns] += 1
            held = {k: v for k, v in held.items() if k[0] != ns}
        else:
            old = held.get((ns, key))
            want[seq] = (generation[ns], old is not None and (ns != "n" or (at - old[1]).total_seconds() < 1800))
            if op == "set":
                held[ns, key] = (value, at)
            elif op == "delete":
                held.pop((ns, key), None)
        if at < last:
            alive = dict(held)
    replayed = cache.replay(log, {"n": 1800})
    assert {r["seq"]: (r["generation"], r["hit"]) for r in replayed.collect()} == want
    assert "collect_list" not in plan_of(replayed)
    live = {(r["namespace"], r["key"]): (r["value"], r["written_at"]) for r in cache.entries(log, {"n": 1800}, F.lit(last)).collect()}
    assert live == {k: v for k, v in alive.items() if k[0] != "n" or (last - v[1]).total_seconds() < 1800}


HOLDS = "(file_rest + symbol_rest) % 5 <> 0"


def by_class(spark):
    """Files and symbols by class, and the plain pairs; keys repeat, and a class has no partner on either side."""
    rng = random.Random(9)
    files = [(f, f % 7) for f in range(60)] + [(3, 3), (11, 4), (99, 50)]
    symbols = [(s, f"n{rng.randrange(6)}", s % 7) for s in range(0, 40, 2)] + [(4, "n1", 4), (77, "other", 60), (8, "a::b", 1), (9, None, 2)]
    owners = spark.createDataFrame([(f, c, f % 5) for f, c in files], "file_path long, class long, rest long")
    names = spark.createDataFrame([(s, n, c, s % 5) for s, n, c in symbols], "symbol long, name string, class long, rest long")
    return owners, names, [(f, s, n) for f, c in files for s, n, d in symbols if c == d]


def test_pairs_of_classes_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(classes, "ROWS_OF_TASK", 7)
    owners, names, rows = by_class(spark)
    got = classes.pairs(owners, names)
    assert sorted(map(tuple, got.collect())) == sorted({(f, s) for f, s, _ in rows})
    assert plan_of(got).count("Aggregate") == 2 and plan_of(got).lstrip()[:7] == "Project"  # nothing is made distinct after the join


def test_calls_by_class_equal_calls_by_id(spark):
    owners, names, rows = by_class(spark)
    symbols = spark.createDataFrame([(f, n) for f, _, n in rows], "file_path long, name string")
    ids = [(f"{f}::{n}", f"{f + step(s)}::{n}") for f, s, n in rows if n is not None for step in [lambda s: 7 if s % 3 == 0 else 1]]
    want = {(r["caller"], r["callee"]) for r in store.call_edges_of(spark.createDataFrame(ids, "caller string, callee string"), symbols).collect()}
    calls = names.select("class", "name", F.when(F.col("symbol") % 3 == 0, 7).otherwise(1).alias("step"))
    got = classes.call_edges(owners, names, calls)
    assert want and sorted(map(tuple, got.collect())) == sorted(want)
    assert plan_of(got).lstrip()[:7] == "Project"


def test_counts_by_class_equal_counts_of_pairs(spark):
    owners, names, rows = by_class(spark)
    held = [(f, s) for f, s, _ in rows if (f % 5 + s % 5) % 5 != 0]
    want = {f: len({s for g, s in held if g == f}) for f, _ in held}
    assert {r["file_path"]: r["symbols_count"] for r in classes.symbol_counts(owners, names, HOLDS).collect()} == want


def test_unlinked_by_class_equals_pairs(spark):
    owners, names, rows = by_class(spark)
    known = {f for f, _, _ in rows if f % 4}
    held = {(f, s) for f, s, _ in rows if (f % 5 + s % 5) % 5 != 0}
    for kept, holds in ((held, HOLDS), (set(), "false"), ({p for p in held if p[0] % 5 == 2}, HOLDS + " AND file_rest = 2")):
        (row,) = classes.unlinked(spark.createDataFrame([(f,) for f in known], "file_path long"), owners, names, holds).collect()
        defined = {s for _, s in kept}
        assert tuple(row) == (sum(s not in defined for _, s, _ in rows), sum(f in known and (f, s) not in kept for f, s, _ in rows))


def test_files_with_symbols_by_class(spark):
    owners, names, rows = by_class(spark)
    assert {r["file_path"] for r in classes.with_symbols(owners, names).collect()} == {f for f, _, _ in rows}


def test_queries_of_symbols_make_no_pairs(spark, sf):
    for name in ("file_metrics", "graph_integrity", "files_by_language", "assembled_results"):
        assert "% 97) = (" not in plan_of(QUERIES[name](spark, sf)), name


def test_betweenness_in_arrays_equals_joins(spark):
    rng = random.Random(4)
    pairs = list({(rng.randrange(40), rng.randrange(40)) for _ in range(110)} | {(100, 101), (101, 102), (100, 103), (103, 102), (7, 7)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    some = spark.createDataFrame([(i,) for i in (*range(0, 40, 3), 100, 500)], "node long")
    for sources in (None, some):
        arrays, joins = ({r["node"]: r["betweenness"] for r in graph.betweenness(edges, sources, **kept).collect()} for kept in ({}, {"edges_of_task": 0}))
        assert arrays == pytest.approx(joins) and any(arrays.values())
    named = graph.betweenness(spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string"))
    whole = {r["node"]: r["betweenness"] for r in graph.betweenness(edges).collect()}
    assert {r["node"]: r["betweenness"] for r in named.collect()} == pytest.approx({f"n{k}": v for k, v in whole.items()})


def test_files_of_one_split_are_parsed_in_many_tasks(spark, sf):
    for name in ("parsed_symbols", "parsed_imports"):
        assert QUERIES[name](spark, sf).select(F.spark_partition_id()).distinct().count() > 4


def test_call_edges_are_not_shuffled(spark):
    rng = random.Random(2)
    words = ["a", "an", "tan", "then", "Ünd"]
    rows = [(i, rng.choice([*words, None, ""]), " ".join(rng.choice(words) for _ in range(rng.randrange(5))) or None) for i in range(50)]
    want = lambda rows: {(a, b) for a, _, body in rows for b, name, _ in rows if a != b and name and body and name in body}
    got = graph.call_edges(spark.createDataFrame(rows, "id long, name string, body string"))
    assert sorted(map(tuple, got.collect())) == sorted(want(rows)) and "Aggregate" not in plan_of(got).split("Join")[0]
    twice = [*rows, *[(i, words[i % 5], rows[i][2]) for i in range(0, 50, 3)]]
    got = graph.call_edges(spark.createDataFrame(twice, "id long, name string, body string"))
    assert sorted(map(tuple, got.collect())) == sorted(want(twice))


def test_call_edges_meet_in_tasks(spark, monkeypatch):
    """Ids with several names and bodies, null ids, blocks of callees, batches of callers and edges: neither edges nor lists of them are shuffled."""
    rng = random.Random(7)
    words = ["a", "an", "tan", "then", "n t", "Ünd", "x"]
    rows = [(rng.choice([None, *range(25)]), rng.choice([*words, None, ""]), " ".join(rng.choice(words) for _ in range(rng.randrange(4))) or None) for _ in range(70)]
    want = sorted({(a, b) for a, _, body in rows for b, name, _ in rows if None not in (a, b) and a != b and name and body and name in body})
    for callees, callers, edges in ((500_000, 2_048, 500_000), (4, 3, 5)):
        for key, value in (("CALLEES_AT_ONCE", callees), ("CALLERS_OF_TASK", callers), ("EDGES_AT_ONCE", edges)):
            monkeypatch.setattr(graph, key, value)
        for kind, ids in (("long", lambda x: x), ("string", lambda x: None if x is None else f"i{x}")):
            symbols = spark.createDataFrame([(ids(i), name, body) for i, name, body in rows], f"id {kind}, name string, body string")
            got = graph.call_edges(symbols)
            assert sorted(map(tuple, got.collect())) == sorted((ids(a), ids(b)) for a, b in want)
            assert "Join" not in plan_of(got) and "Aggregate" not in plan_of(got)
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "id long, name string, body string")
    assert graph.call_edges(nothing).collect() == [] and graph.call_edges(nothing).columns == ["caller", "callee"]


def test_sliding_counts_without_moving_frames(spark):
    """Ties, gaps, windows of one second, requests without a time and keys without a value; every frame begins with its key's first request."""
    rng, start = random.Random(1), datetime(2024, 1, 1)
    rows = [(i, rng.choice([None, 1, 2]), rng.choice("ab"), rng.choice([None, *[start + timedelta(seconds=rng.randrange(200), milliseconds=i)] * 9])) for i in range(400)]
    requests = spark.createDataFrame(rows, "event_id long, user_id long, endpoint string, ts timestamp").repartition(3)
    second = lambda ts: None if ts is None else int((ts - datetime(1970, 1, 1)).total_seconds())
    for window in (1, 10, 86_400):
        want = {}
        for i, user, name, ts in rows:
            s = second(ts)
            others = [second(t) for _, u, n, t in rows if (u, n) == (user, name)]
            met = [t for t in others if (t is None) == (s is None) and (s is None or s - window < t <= s)]
            want[i] = (len(met), None if s is None else min(met) + window)
        got = timewin.sliding_counts(requests, window)
        assert {r["event_id"]: (r["in_window"], r["reset_at"]) for r in got.collect()} == want
        assert got.columns == [*requests.columns, "second", "in_window", "reset_at"]
        assert "RangeFrame, -" not in plan_of(got)
        assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_commit_impact_in_bounded_parts(spark):
    rng = random.Random(6)
    changed = [(rng.randrange(40), rng.randrange(20)) for _ in range(150)]
    edges = list({(rng.randrange(20), rng.randrange(20)) for _ in range(60)})
    want: dict = {}
    for c, f in set(changed):
        for a, b in edges:
            if b == f:
                want[c, a] = want.get((c, a), 0) + 1
    got = graph.commit_impact(spark.createDataFrame(changed, "commit_hash long, file_path long"), spark.createDataFrame(edges, "src long, dst long"), F.col("affected") % 4 == 1, 20)
    assert {tuple(r) for r in got.collect()} == {(c, a, a % 4 == 1, n) for (c, a), n in want.items()}
    assert got.rdd.getNumPartitions() == 22


def test_exact_search_in_groups_equals_plain_scores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(VectorIndex, "ROWS_AT_ONCE", 40)
    monkeypatch.setattr(VectorIndex, "QUERIES_AT_ONCE", 5)
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(3)]) for i in range(170)] + [(200, None), (201, [0.0, 0.0, 0.0])]
    index = VectorIndex(spark, str(tmp_path)).build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cells=6)
    asked = [(i, v) for i, v in rows if i % 13 == 0]

    def certainty(a, b):
        size = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)) if b else 0
        return (1 + sum(x * y for x, y in zip(a, b)) / size) / 2 if size else None

    frame = spark.createDataFrame(asked, "query_id long, vector array<float>")
    everything = {(r["query_id"], r["vec_id"]): r["certainty"] for r in index.search_many(frame, 500, exact=True).collect()}
    assert everything == {(q, i): pytest.approx(c) if c is not None else None for q, v in asked for i, w in rows for c in [certainty(v, w)]}
    best = index.search_many(frame, 4, exact=True).collect()
    for q, _ in asked:
        scores = sorted((c for (a, _), c in everything.items() if a == q and c is not None), reverse=True)
        assert [r["certainty"] for r in sorted((r for r in best if r["query_id"] == q), key=lambda r: r["place"])] == pytest.approx(scores[:4] or [None] * 4)
    cells = {r["vec_id"]: r["cell"] for r in index.rows().collect()}
    some = index.search_many(frame, 500, probes=2).collect()
    for q, _ in asked:
        met = {r["vec_id"] for r in some if r["query_id"] == q}
        held = {cells[i] for i in met}
        assert len(held - {-1}) == 2 and met == {i for i, c in cells.items() if c in held | {-1}}
