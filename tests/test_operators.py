"""Hand-made cases: expectations known by hand, plain programs for folds, properties of traversals."""

from __future__ import annotations

import itertools
import uuid
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.api import CodeIntel
from skein.functions import chunks, text
from skein.operators import graph, relational, search, timewin, trails


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def test_forward_closure(spark):
    e = edges(spark, ("f1", "f2"), ("f2", "f3"), ("f1", "f4"))
    assert {r["node"] for r in graph.reach(e, seeds(spark, "f1"), 5, "upstream", keep_seed=True).collect()} == {"f1", "f2", "f3", "f4"}


def test_criticality_order(spark):
    e = edges(spark, ("f1", "f2"), ("f3", "f2"), ("f2", "f4"), ("f2", "f5"))
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert between["f2"] == pytest.approx(4 / 12)
    acs = {r["node"]: r["acs"] for r in graph.acs_full(e, graph.betweenness(e)).collect()}
    assert 0 < acs["f1"] < acs["f2"] <= 1


def test_betweenness_equals_a_plain_program(spark):
    pairs = [(a, b) for a, b in itertools.product(range(9), repeat=2) if a != b and (a * 7 + b * 5) % 4 == 1]
    nodes = sorted({x for p in pairs for x in p})
    want = dict.fromkeys(nodes, 0.0)
    to = {n: [b for a, b in pairs if a == n] for n in nodes}
    for s in nodes:
        dist, ways, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in to[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] = ways.get(w, 0) + ways[v]
        credit = dict.fromkeys(nodes, 0.0)
        for v in reversed(order):
            for w in to[v]:
                if dist.get(w) == dist[v] + 1:
                    credit[v] += ways[v] / ways[w] * (1 + credit[w])
            if v != s:
                want[v] += credit[v]
    n = len(nodes)
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == pytest.approx({k: v / ((n - 1) * (n - 2)) for k, v in want.items()})


def test_trails_repeat_nodes_but_no_edge(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"))
    found = sorted((r["node"], r["length"]) for r in trails.trail_lengths(e, seeds(spark, "a"), 5, ("upstream",)).collect())
    assert found == [("a", 2), ("b", 1), ("c", 2)]
    short = {r["node"]: r["distance"] for r in graph.reach(e, seeds(spark, "a"), 5, "upstream").collect()}
    assert short == {"a": 2, "b": 1, "c": 2}


def test_many_sources_equal_single_ones(spark):
    e = edges(spark, *[(f"n{a}", f"n{(a * 3 + k) % 12}") for a in range(12) for k in (1, 5)])
    together = {(r["seed"], r["node"], r["distance"]) for r in graph.reach(e, seeds(spark, "n1", "n2"), 4).collect()}
    single = {(r["seed"], r["node"], r["distance"]) for s in ("n1", "n2") for r in graph.reach(e, seeds(spark, s), 4).collect()}
    assert together == single


def test_paths_are_the_shortest(spark):
    e = edges(spark, ("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("a", "e"))
    pairs = spark.createDataFrame([("a", "e")], "start string, end string")
    assert [r["nodes"] for r in trails.paths_between(e, pairs, 5, 2).orderBy("length", "nodes").collect()] == [["a", "e"], ["a", "b", "d", "e"]]


def test_star_of_eight_importers(spark):
    e = edges(spark, *[(f"i{k}", "root") for k in range(8)])
    star = graph.dependency_star(e, seeds(spark, "root")).collect()
    assert len(star) == 8
    assert len({x for r in star for x in (r["from"], r["to"])}) == 9


@pytest.mark.parametrize(("fan_in", "fan_out", "want"), [(20, 15, 0.7), (2, 1, 0.06), (None, None, 0.0)])
def test_centrality(spark, fan_in, fan_out, want):
    df = spark.createDataFrame([(fan_in, fan_out)], "a int, b int")
    assert df.select(graph.centrality(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_confidence(spark):
    df = spark.createDataFrame([(0.9, 0.85, 0.7)], "c double, r double, g double")
    one = lambda on, profile="tested": df.select(search.confidence(F.col("c"), F.col("r"), F.col("g"), on, profile)).first()[0]
    assert one(False) == pytest.approx(0.80)
    assert one(True) == pytest.approx(0.8525)
    assert one(False, "as_coded") == pytest.approx(0.555)


def test_trim_is_a_prefix(spark):
    df = spark.createDataFrame([(i, "x" * 2000, "12345678") for i in range(20)], "rank int, content string, file_path string")
    assert [r["rank"] for r in search.trim_to_budget(df, 4096).orderBy("rank").collect()] == list(range(7))


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([("a", "f", 1, r) for r in range(3)] + [("b", "g", 2, 9)], "file_path string, symbol string, start_line int, rank int")
    once = search.first_of_each(df, ("file_path", "symbol", "start_line"), ("rank",))
    assert sorted(r["rank"] for r in once.collect()) == [0, 9]
    assert search.first_of_each(once, ("file_path", "symbol", "start_line"), ("rank",)).count() == 2


def test_stack_trace(spark):
    trace = 'File "src/app.py", line 42, in handle\nFile "src/session.py", line 88, in <module>\n  at com.A.b(A.java:3)\n\nerror'
    df = spark.createDataFrame([(trace,)], "trace string")
    frames = text.stack_frames(df).orderBy("pos").collect()
    assert [(r["file_path"], r["line_number"], r["function"]) for r in frames] == [("src/app.py", 42, "handle"), (None, None, None), ("A.java", 3, "com.A.b"), (None, None, None)]
    more = text.stack_frames(df, extended=True).orderBy("pos").collect()
    assert (more[1]["file_path"], more[1]["line_number"], more[1]["function"]) == ("src/session.py", 88, "<module>")


def test_uuid5(spark):
    df = spark.createDataFrame([("a:b",), ("",), ("é",)], "s string")
    assert [r[0] for r in df.select(text.uuid5(F.col("s"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, s)) for s in ("a:b", "", "é")]


def test_chunks(spark):
    body = "\n".join(f"line {i} " + "x" * (i % 90) for i in range(200))
    parts = chunks.split_lines(body, 10, 209)
    lines = body.split("\n")
    assert parts[0][1] == 10 and parts[-1][2] == 209
    for content, first, last in parts[:-1]:
        assert content == "\n".join(lines[first - 10 : last - 9])
        assert len(content.replace("\n", "")) <= 2048
    assert all(b[1] <= a[2] + 1 for a, b in itertools.pairwise(parts))
    df = spark.createDataFrame([(1, body, 10, 209), (2, "  ", 1, 1), (3, "short", 5, 5)], "symbol_id int, body string, start_line int, end_line int")
    got = chunks.extract_chunks(df).orderBy("symbol_id", "part").collect()
    assert [(r["content"], r["start_line"], r["end_line"]) for r in got] == [*parts, ("short", 5, 5)]


def _requests(spark, rows):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, u, e, t0 + timedelta(seconds=s)) for i, (u, e, s) in enumerate(rows)], "event_id long, user_id long, endpoint string, ts timestamp_ntz")


def test_admission_equals_a_plain_program(spark):
    rows = [(i % 3, ("search", "file")[i % 2], i // 4) for i in range(500)]
    want, held = {}, {}
    for i, (u, e, s) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][2], x[0])):
        factor = timewin.MULTIPLIERS[e]
        verdict = "allowed"
        for name, key, width, most in (("hour", (u, e), 3600, int(100 * factor)), ("minute", (u, e), 60, int(10 * factor)), ("burst", u, 10, 5)):
            if sum(s - width < x <= s for x in held.get((name, key), [])) >= most:
                verdict = name
                break
        if verdict == "allowed":
            for name, key in (("hour", (u, e)), ("minute", (u, e)), ("burst", u)):
                held.setdefault((name, key), []).append(s)
        want[i] = verdict
    got = {r["event_id"]: r["verdict"] for r in timewin.admit(_requests(spark, rows)).collect()}
    assert got == want
    assert set(want.values()) == {"allowed", "minute", "burst"}


def test_breaker(spark):
    rows = [(1, "x", s) for s in (0, 1, 2, 3, 4, 5, 70, 71, 72)]
    bad = (True,) * 5 + (False, False, True, False)
    calls = _requests(spark, rows).withColumn("failed", F.element_at(F.array(*map(F.lit, bad)), (F.col("event_id") + 1).cast("int")))
    got = [(r["state"], r["refused"]) for r in timewin.breaker_states(calls).orderBy("event_id").collect()]
    assert got == [("CLOSED", False)] * 4 + [("OPEN", False), ("OPEN", True), ("CLOSED", False), ("CLOSED", False), ("CLOSED", False)]


def test_counter_reset_and_alert(spark):
    t0 = datetime(2024, 1, 1)
    samples = spark.createDataFrame([("a", t0 + timedelta(seconds=10 * i), v) for i, v in enumerate([0.0, 50.0, 20.0, 120.0])], "k string, ts timestamp_ntz, value double")
    assert [r["rate"] for r in timewin.counter_rate(samples, ("k",)).orderBy("ts").collect()] == [5.0, 2.0, 10.0]
    spans = timewin.firing(timewin.counter_rate(samples, ("k",)), F.col("rate") >= 2, 20, ("k",), "ts").collect()
    assert len(spans) == 1 and spans[0]["since"] == t0 + timedelta(seconds=10)


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "value double")
    assert timewin.histogram_quantile(df, (50.0, 100.0), 0.75).first()["quantile"] == pytest.approx(75.0)
    assert timewin.histogram_quantile(df, (10.0,), 0.9).first()["quantile"] == 10.0


def test_upsert_and_ignore(spark):
    now = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert sorted((r["k"], r["v"]) for r in relational.upsert(now, new, ("k",), "o").collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(r["k"] for r in relational.insert_ignore(now, new, ("k",)).collect()) == [1, 2, 3]


@pytest.mark.parametrize("payload", ["'; DROP TABLE users; --", "1' OR '1'='1", "admin'--", "<script>alert(1)</script>", "javascript:alert(1)", "<img src=x onerror=alert(1)>"])
def test_dangerous_queries(spark, payload):
    assert spark.createDataFrame([(payload,)], "q string").select(text.check_query(F.col("q"))).first()[0] in ("sql", "script")


@pytest.mark.parametrize("payload", ["../../etc/passwd", "/etc/passwd", "~/x", "a/../../b", ""])
def test_dangerous_paths(spark, payload):
    assert spark.createDataFrame([(payload,)], "p string").select(text.check_path(F.col("p"))).first()[0] != "ok"


def test_api_batch(spark):
    t = {"files": spark.createDataFrame([("a",), ("b",)], "file_path string"), "imports": edges(spark, ("a", "b")), "belongs_to": spark.createDataFrame([("a", "svc")], "file_path string, service string")}
    api = CodeIntel(spark, t)
    good, unknown, bad = api.batch([("blast_radius", {"files": ["b"]}), ("nothing", {}), ("blast_radius", {"files": ["b"], "max_hops": 99})], 60)
    assert [(r["file_path"], r["service"]) for r in good["rows"]] == [("a", "svc")]
    assert unknown["status"] == bad["status"] == "error"
    with pytest.raises(ValueError):
        api.batch([("file", {})] * 21)


def test_routes_agree_with_the_column_rules(spark):
    from skein.plans import routing

    queries = ["what depends on this import", "find the function for logging", "show me the upstream impact", "hello"]
    got = [r[0] for r in spark.createDataFrame([(q,) for q in queries], "q string").select(text.classify_query(F.col("q"))).collect()]
    assert got == [routing.classify(q) for q in queries]
    assert routing.graph_route("blast_radius", max_hops=6).hints["timeout"] == 20
    assert routing.graph_route("blast_radius", max_hops=3).cost_ms == 1600
    assert routing.search_route("a b c d e f g h i j k", 25).hints["k_multiplier"] == 1.5
    assert routing.file_route("x").cached and routing.classify("x", "/search", True) == "hybrid"


def test_sample_of_files(spark):
    from skein.functions.conventions import sample_files

    scored = spark.createDataFrame([(f"f{i:02}", i) for i in range(40)], "path string, score int")
    assert {r["path"] for r in sample_files(scored, 10).collect()} == {f"f{i}" for i in range(30, 40)}
    drawn = {r["path"] for r in sample_files(scored, 10, seed=1).collect()}
    assert len(drawn) == 10 and {f"f{i}" for i in range(35, 40)} <= drawn and len(drawn & {f"f{i:02}" for i in range(30)}) == 5
