"""Trees, parsers, manifests, stores and the bus on files made here."""

from __future__ import annotations

import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.sources import cache, gitlog, parsers, store, tree
from skein.streaming import bus

FILES = {
    "src/app.py": b'import os\nfrom .util import helper as h\nfrom pkg import *\n\nclass Calculator:\n    """Adds."""\n\n    def add(self, a: int, b=1) -> int:\n        return a + b\n\n    @staticmethod\n    async def sub(x):\n        return x\n\n    def mul(self, *args, **kw):\n        return 1\n\ndef main():\n    pass\n',
    "src/util.py": b"def helper():\n    return 1\n",
    "src/broken.py": b"def broken(:\n",
    "src/data.bin": b"\x00\x01",
    "src/latin.py": b"# \xe9\n",
    "web/package.json": b'{"name": "x", "dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}',
    "web/index.ts": b'import { a, b as c } from "./lib";\nconst fs = require("fs");\nexport interface Shape { x: number }\nexport type Id = string;\nexport class Box extends Base {\n  private async open(a: string): Promise<void> { if (a) { run(a); } }\n}\nexport const go = (x: number): number => { return x; };\nfunction plain(a, b) { return "{"; }\n',
    "web/lib.ts": b"export function a() {}\n",
    "web/node_modules/x/package.json": b"{}",
    "svc/go.mod": b"module m\nrequire github.com/a/b v1\nrequire (\n\tx v2\n)\n",
    "svc/main.go": b'package main\n\nimport (\n\t"fmt"\n\tm "math"\n)\n\ntype Shape interface { Area() int }\n\ntype Box struct { w int }\n\nfunc (b *Box) Area(x int) int {\n\treturn b.w // }\n}\n\nfunc main() { fmt.Println("{") }\n',
    "java/A.java": b"import java.util.*;\nimport java.io.File;\n\npublic class A {\n  private int x = 1;\n  public A(int x) { this.x = x; }\n  @Override\n  public static int get(int a, int b) throws Foo { return a; }\n  enum E { P, Q }\n}\ninterface I {\n  void f();\n}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("repo")
    for name, content in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content)
    return str(base)


@pytest.fixture(scope="module")
def files(spark, root):
    return tree.read_tree(spark, root).persist()


@pytest.fixture(scope="module")
def parsed(files):
    return parsers.parse_tree(tree.sources(files, strict=True)).persist()


def test_tree(files):
    assert {r["path"] for r in files.collect()} == set(FILES)
    binary = {r["path"] for r in files.where(tree.is_binary(F.col("content"))).collect()}
    assert binary == {"src/data.bin", "src/latin.py"}
    row = tree.metadata(files).first()
    assert row["total_files"] == 9
    assert tree.read_file(files, "src/util.py").first()["content"].startswith("def helper")


def test_long_text_cut_in_a_character_is_no_binary(spark):
    df = spark.createDataFrame([(bytearray(b"x" * 8191 + "é".encode() * 20),), (bytearray(b"x" * 8100 + b"\xff" + b"x" * 500),)], "content binary")
    assert [r[0] for r in df.select(tree.is_binary(F.col("content"))).collect()] == [False, True]


def test_manifests(files):
    found = {r["manifest_file"]: (r["name"], r["service_type"], r["dependencies"]) for r in tree.manifests(files).collect()}
    assert found == {"web/package.json": ("web", "npm", ["react", "jest"]), "svc/go.mod": ("svc", "go_module", ["github.com/a/b", "("])}
    of = {(r["name"], r["path"]) for r in tree.service_files(tree.manifests(files), files).collect()}
    assert of == {("web", "web/index.ts"), ("web", "web/lib.ts"), ("svc", "svc/main.go")}


def test_python(parsed):
    symbols = {r["name"]: r for r in parsers.symbols_of(parsed.where("path = 'src/app.py'")).collect()}
    assert {n: (s["symbol_type"], s["parent"]) for n, s in symbols.items()} == {"Calculator": ("class", None), "add": ("method", "Calculator"), "sub": ("method", "Calculator"), "mul": ("method", "Calculator"), "main": ("function", None)}
    assert symbols["Calculator"]["docstring"] == "Adds."
    assert (symbols["add"]["parameters"], symbols["add"]["return_type"]) == (["self", "a: int", "b=1"][:2] + ["b"], "int")
    assert symbols["sub"]["modifiers"] == ["@staticmethod", "async"]
    row = parsed.where("path = 'src/app.py'").first()
    assert [(i["module"], i["names"], i["is_relative"]) for i in row["imports"]] == [("os", [], False), (".util", ["helper"], True), ("pkg", ["*"], False)]


def test_bad_files_are_rows(parsed):
    rows = {r["path"]: r for r in parsed.where(F.col("path").isin("src/broken.py", "src/latin.py")).collect()}
    assert not any(r["success"] for r in rows.values())
    assert all(r["errors"] for r in rows.values())


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("svc/main.go", {("Shape", "interface", None), ("Box", "class", None), ("Area", "method", "Box"), ("main", "function", None)}),
        ("java/A.java", {("A", "class", None), ("A", "method", "A"), ("get", "method", "A"), ("E", "enum", "A"), ("I", "interface", None), ("f", "method", "I")}),
        ("web/index.ts", {("Shape", "interface", None), ("Id", "constant", None), ("Box", "class", None), ("open", "method", "Box"), ("go", "function", None), ("plain", "function", None)}),
    ],
)
def test_braced_languages(parsed, path, want):
    rows = parsed.where(F.col("path") == path)
    assert rows.first()["success"]
    assert {(s["name"], s["symbol_type"], s["parent"]) for s in parsers.symbols_of(rows).collect()} == want


def test_imports(parsed):
    by = {r["path"]: [i["module"] for i in r["imports"]] for r in parsed.collect()}
    assert by["svc/main.go"] == ["fmt", "math"]
    assert by["java/A.java"] == ["java.util", "java.io.File"]
    assert by["web/index.ts"] == ["./lib", "fs"]


def test_resolution(spark, parsed, files):
    from skein.operators.graph import resolve_imports

    known = files.select(F.col("path").alias("file_path"))
    out = {(r["src"], r["dst"], r["is_external"]) for r in resolve_imports(parsers.imports_of(parsed), known).collect()}
    assert ("web/index.ts", "web/lib.ts", False) in out
    assert ("src/app.py", "src/util.py", False) in out
    assert ("svc/main.go", "fmt", True) in out


def test_register(spark):
    parsers.register("upper", ("up",), lambda text: ([parsers.Symbol(text.strip(), "function", 1, 1)], [], []))
    assert parsers.parse("a.up", b"F\n")["symbols"][0]["name"] == "F"


def test_git_log(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *args], check=True, capture_output=True)

    git("init")
    (tmp_path / "a.txt").write_text("1\n2\n")
    git("add", "."), git("commit", "-m", "one")
    (tmp_path / "a.txt").write_text("1\n3\n4\n")
    git("add", "."), git("commit", "-m", "two")
    rows = {r["message"]: (r["file_path"], r["additions"], r["deletions"]) for r in gitlog.git_log(spark, str(tmp_path)).collect()}
    assert rows == {"one": ("a.txt", 2, 0), "two": ("a.txt", 2, 1)}


def test_incremental(files, root, spark):
    known = files.select("path", F.sha2("content", 256).alias("digest")).where("path <> 'src/util.py'")
    assert [r["path"] for r in tree.changed_since(files, known).collect()] == ["src/util.py"]


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 2)], "repo_id string, file_path string, n int")
    store.write(a, str(tmp_path), "files")
    store.write(spark.createDataFrame([("r2", "z", 3)], a.schema), str(tmp_path), "files")
    assert sorted((r["repo_id"], r["file_path"]) for r in store.read(spark, str(tmp_path), "files").collect()) == [("r1", "x"), ("r2", "z")]
    left, gone = store.delete_repository({"files": a}, "r1")
    assert gone.first()["deleted"] == 1 and left["files"].count() == 1
    imports = spark.createDataFrame([("x", "new", True), ("x", "lib", False)], "src string, dst string, is_relative boolean")
    more, edges = store.relative_imports(a.select("file_path"), imports)
    assert {r["file_path"] for r in more.collect()} == {"x", "y", "new"} and edges.count() == 1
    symbols = spark.createDataFrame([("p", "f"), ("q", "g")], "file_path string, name string")
    ids = spark.createDataFrame([("p::f", "q::g"), ("p::f", "zz"), ("p::f", "q::none")], "caller string, callee string")
    assert store.call_edges_of(ids, symbols).count() == 1


def test_cache(spark):
    t = datetime(2024, 1, 1)
    cache = spark.createDataFrame([("file", "file:a", "1", t), ("query", "query:b", "2", t)], "namespace string, key string, value string, written_at timestamp_ntz")
    live = store.live_entries(cache, F.lit(datetime(2024, 1, 1, 0, 10)), {"file": 3600, "query": 300})
    assert [r["key"] for r in live.collect()] == ["file:a"]
    assert [r["key"] for r in store.invalidate(cache, "file:*").collect()] == ["query:b"]


def test_dispatch(spark, tmp_path):
    rows = spark.createDataFrame([(k, "r1", datetime(2024, 1, 1, 0, i)) for i, k in enumerate(("index_started", "github_push", "index_started"))], "k string, repo string, at timestamp")
    bus.emit(bus.to_event(rows, F.col("k"), F.col("repo"), F.col("at")), str(tmp_path / "bus"))
    seen, dispatcher = [], bus.Dispatcher()
    dispatcher.on("index_started", lambda batch, _: seen.append(batch.count()))
    dispatcher.on("github_push", lambda batch, _: 1 / 0)
    dispatcher.start(bus.subscribe(spark, str(tmp_path / "bus")), str(tmp_path / "log")).awaitTermination()
    assert seen == [2]
    assert dispatcher.failures[0][1] == "github_push"
    with pytest.raises(ValueError):
        dispatcher.on("nothing", print)


def commit(folder, files, message):
    for name, content in files.items():
        (folder / name).write_text(content)
    for words in (("add", "-A"), ("-c", "user.name=A", "-c", "user.email=a@b", "commit", "-qm", message)):
        subprocess.run(["git", "-C", str(folder), *words], check=True)


def test_two_pulls_equal_one(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    subprocess.run(["git", "-C", str(repo), "init", "-q"], check=True)
    for i in range(5):
        commit(repo, {f"f{i % 2}.txt": f"{i}\n" * (i + 1)}, f"first {i}")
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    gitlog.pull(spark, str(repo), table, log)
    middle = gitlog._git(str(repo), "rev-parse", "HEAD")
    assert spark.read.parquet(table).count() == 5
    for i in range(3):
        commit(repo, {"f9.txt": f"{i}\n"}, f"later {i}")
    gitlog.pull(spark, str(repo), table, log)
    gitlog.pull(spark, str(repo), table, log)
    whole = gitlog.git_log(spark, str(repo))
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == sorted(map(tuple, whole.collect()))
    new = gitlog.git_log(spark, str(repo), since=middle)
    assert sorted(r["message"] for r in new.collect()) == ["later 0", "later 1", "later 2"]
    assert [tuple(r) for r in gitlog.changed_files(new).collect()] == [("f9.txt", 3, 3, 2)]
    spark.dataSource.register(gitlog.GitLog)
    parts = spark.read.format("git_log").option("commits_a_partition", 3).load(str(repo))
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == whole.count() == 8
    with pytest.raises(Exception):
        gitlog.git_log(spark, str(repo), "nothing").count()


def test_table_functions(spark):
    from skein.functions import chunks

    chunks.register(spark)
    body = "\n".join(f"line {i} " + "x" * (i * 37 % 400) for i in range(120))
    symbols = spark.createDataFrame([("a", body), ("b", "one\n\ntwo"), ("c", None)], "symbol_id string, body string")
    want = {(s, i, *c) for s, b in (("a", body), ("b", "one\n\ntwo")) for i, c in enumerate(chunks.split_lines(b, 1, b.count("\n") + 1, 100, 20))}
    lateral = spark.sql("SELECT s.symbol_id, c.* FROM {s} s, LATERAL chunk_text(s.body, 1, size(split(s.body, '\\n')), 100, 20) c", s=symbols)
    assert {tuple(r) for r in lateral.collect()} == want
    lines = spark.sql("SELECT symbol_id, pos + 1 AS line_number, line FROM {s} LATERAL VIEW posexplode(split(body, '\\n')) t AS pos, line", s=symbols)
    lines.createOrReplaceTempView("lines_of_symbols")
    by_line = spark.sql("SELECT * FROM chunk_lines(TABLE(lines_of_symbols) PARTITION BY symbol_id ORDER BY line_number)")
    want = {(s, i, *c) for s, b in (("a", body), ("b", "one\n\ntwo")) for i, c in enumerate(chunks.split_lines(b, 1, b.count("\n") + 1))}
    assert {tuple(r) for r in by_line.collect()} == want


def test_cache_log(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    ops = [("n", "a", "set", "1"), ("n", "a", "get", None), ("n", "b", "get", None), ("n", "a", "delete", None), ("n", "a", "get", None), ("n", "a", "set", "2"), ("n", None, "flush", None), ("n", "a", "get", None), ("n", "a", "set", "3"), ("m", "a", "get", None), ("m", "a", "set", "4")]
    rows = [(ns, key, op, value, at(i), i) for i, (ns, key, op, value) in enumerate(ops)]
    log = spark.createDataFrame(rows, "namespace string, key string, op string, value string, at timestamp, seq long")
    warm = cache.prewarm(spark.createDataFrame([("x", "7", 3), ("y", "8", 9), ("z", "9", 9)], "key string, value string, uses int"), "n", F.lit(at(20)), 2)
    log = log.unionByName(warm)
    got = {r["seq"]: r["hit"] for r in cache.replay(log.where("op = 'get'").unionByName(log.where("op <> 'get'")), {"n": 100}).where("op = 'get'").collect()}
    assert got == {1: True, 2: False, 4: False, 7: False, 9: False}
    live = lambda s, ttl: {(r["namespace"], r["key"], r["value"]) for r in cache.entries(log, ttl, F.lit(at(s))).collect()}
    assert live(30, {"n": 100}) == {("n", "a", "3"), ("n", "y", "8"), ("n", "z", "9"), ("m", "a", "4")}
    assert live(30, {"n": 15, "m": 1}) == {("n", "y", "8"), ("n", "z", "9")}
    stats = {r["namespace"]: r.asDict() for r in cache.statistics(log, {"n": 100}, F.lit(at(30))).collect()}
    assert (stats["n"]["gets"], stats["n"]["hits"], stats["n"]["stored"], stats["n"]["flushes"], stats["n"]["live"], stats["n"]["hit_rate"]) == (4, 1, 5, 1, 3, 0.25)
    sealed = spark.createDataFrame([("k", "väl"), ("k", "väl")], "key string, value string").select("key", "value", cache.seal(F.col("value"), "s", F.col("key")).alias("sealed"))
    opened = sealed.select("sealed", cache.unseal(F.col("sealed"), "s", F.col("key")).alias("v"), cache.unseal(F.col("sealed"), "t", F.col("key")).alias("other"), cache.unseal(F.col("sealed"), "s", F.lit("j")).alias("moved")).collect()
    assert {(r["v"], r["other"], r["moved"]) for r in opened} == {("väl", None, None)}


def test_names_of_one_prefix_in_blocks(spark):
    from skein.operators import graph

    names = [f"get_{i}" for i in range(300)]
    rows = [(i, n, f"def {n}(): return {names[(i * 7 + 1) % 300]}(get_x)") for i, n in enumerate(names)] + [(900, None, "get_5"), (901, "", None), (902, "get_5", "")]
    symbols = spark.createDataFrame(rows, "id long, name string, body string")
    want = {(a, b) for a, _, body in rows for b, name, _ in rows if body and name and a != b and name in body}
    for size in (10**6, 400):
        assert {tuple(r) for r in graph.call_edges(symbols, size).collect()} == want
