"""Engine tables as views over the driver's tables: one SQL text for Spark and for the oracle.

``tables(spark, sf_dir, ...)`` gives DataFrames of the named views, ``with_views(...)`` the same views as a WITH clause.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.operators.index import KeywordIndex, VectorIndex
from skein.sources.scratch import cut, shared_folder

_EDGES = """SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
 ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
 WHERE a.l_partkey <> b.l_partkey AND a.l_quantity >= 36 AND a.l_returnflag = '{flag}'"""

#: name: (tables or views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "files": (("part",), "SELECT p_partkey AS file_path, p_brand AS language, CAST(p_size AS BIGINT) AS total_lines FROM part"),
    "imports": (("lineitem",), _EDGES.format(flag="R")),
    "calls": (("lineitem",), _EDGES.format(flag="A")),
    "seeds": (("imports",), "SELECT src AS seed FROM (SELECT src, row_number() OVER (ORDER BY count(*) DESC, src) AS r FROM imports GROUP BY src) t WHERE r <= 5"),
    "call_seeds": (("calls",), "SELECT src AS seed FROM (SELECT src, row_number() OVER (ORDER BY count(*) DESC, src) AS r FROM calls GROUP BY src) t WHERE r <= 3"),
    "services": (("supplier",), "SELECT s_suppkey AS service, s_name AS name, CAST(s_nationkey AS BIGINT) AS service_type FROM supplier"),
    "belongs_to": (("lineitem",), "SELECT l_partkey AS file_path, min(l_suppkey) AS service FROM lineitem GROUP BY l_partkey"),
    "symbols": (("part", "supplier"), "SELECT s_suppkey AS symbol, p_partkey AS file_path, s_name AS name FROM part JOIN supplier ON p_partkey % 97 = s_suppkey % 97"),
    "symbol_files": (("part",), "SELECT p_partkey AS file_path, p_partkey % 97 AS class, p_partkey % 5 AS rest FROM part"),
    "symbol_names": (("supplier",), "SELECT s_suppkey AS symbol, s_name AS name, s_suppkey % 97 AS class, s_suppkey % 5 AS rest FROM supplier"),
    "defines": (("symbols",), "SELECT file_path, symbol FROM symbols WHERE (file_path + symbol) % 5 <> 0"),
    "commits": (("orders",), "SELECT o_orderkey AS commit_hash, o_custkey AS author, o_orderdate AS commit_date FROM orders"),
    "modified": (("lineitem",), "SELECT DISTINCT l_orderkey AS commit_hash, l_partkey AS file_path, CAST(l_linenumber * 10 AS BIGINT) AS lo, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS hi FROM lineitem"),
    "units": (("embeddings",), "SELECT vec_id, embedding, label FROM embeddings"),
    "paths": (("part",), """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'src/tests/helper' WHEN 1 THEN 'src/test_unit' WHEN 2 THEN 'lib/.hidden/unit'
 WHEN 3 THEN 'web/node_modules/pkg' WHEN 4 THEN 'pkg/unit_test' WHEN 5 THEN 'app/Unit.spec' WHEN 6 THEN 'java/UnitTest' WHEN 7 THEN 'src/environment' ELSE 'src/main' END
 || CAST(p_partkey AS STRING) || CASE p_size % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.go' WHEN 3 THEN '.java' WHEN 4 THEN '.RB' WHEN 5 THEN '.png' WHEN 6 THEN '.ts' ELSE '' END AS path FROM part"""),
    "repositories": (("nation", "orders", "customer"), """SELECT CAST(n_nationkey AS BIGINT) AS repo_id, n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'indexing' WHEN 1 THEN 'error' WHEN 2 THEN 'completed' WHEN 3 THEN 'pending' ELSE 'stale' END AS status,
 max(o_orderdate) AS last_incremental, count(*) AS file_count, count(*) % 7 AS error_count, avg(o_totalprice) / 5000 AS coverage_pct
 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name"""),
    "jobs": (("orders",), "SELECT o_orderkey AS job_id, o_custkey % 25 AS repo_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders"),
    "audit": (("events",), "SELECT event_id AS log_id, CASE event_type WHEN 'error' THEN 'auth_failure' WHEN 'signup' THEN 'auth_success' WHEN 'view' THEN 'search' WHEN 'click' THEN 'file_access' ELSE 'blast_radius' END AS event_type, user_id, user_id % 40 AS resource, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS result, ts FROM events"),
    "requests": (("events",), "SELECT event_id, user_id % 20 AS user_id, event_type AS endpoint, ts, value FROM events"),
    "members": (("customer",), "SELECT CAST(c_nationkey AS BIGINT) AS org_id, c_custkey AS user_id FROM customer WHERE c_acctbal > 0"),
    "repo_owners": (("part",), "SELECT p_partkey AS repo_id, p_partkey % 25 AS org_id, p_size % 10 = 0 AS is_public FROM part"),
    "acl": (("lineitem", "orders"), "SELECT DISTINCT o_custkey AS user_id, l_partkey AS repo_id, CASE WHEN l_returnflag = 'R' THEN 'admin' WHEN l_returnflag = 'A' THEN 'developer' ELSE 'viewer' END AS role FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1"),
    "traces": (("documents",), """SELECT doc_id AS trace_id, 'Traceback (most recent call last):\n  File "src/' || source || '.py", line ' || CAST(n_chars % 97 + 1 AS STRING) || ', in handle\n  File "src/session.py", line 88, in <module>\n\n    at com.shop.Cart.add(Cart.java:' || CAST(doc_id AS STRING) || ')\n    at render (src/view.js:' || CAST(doc_id % 50 + 1 AS STRING) || ':21)\n' || text AS trace FROM documents"""),
}
#: ``symbols`` is the product of ``symbol_files`` and ``symbol_names`` within a class; ``defines`` keeps the pairs of this condition.
DEFINED = "(file_rest + symbol_rest) % 5 <> 0"
#: Views that stand for tables which ingestion writes: built once in a session, as Parquet.
STORED = ("imports", "calls", "belongs_to", "modified")
_stored: dict[tuple[str, str, str], object] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needed(names: tuple[str, ...]) -> list[str]:
    """The views that the names need, in order, each once."""
    out: list[str] = []
    for n in names:
        if n in VIEWS:
            for x in (*_needed(VIEWS[n][0]), n):
                if x not in out:
                    out.append(x)
    return out


def _needed_tables(name: str) -> tuple[str, ...]:
    """The driver tables under a view."""
    return tuple(sorted({t for v in _needed((name,)) for t in VIEWS[v][0] if t in TABLES}))


def _version(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> str:
    """The tables' paths, lengths and times of change: what is stored for one state of them is not taken for another."""
    told = []
    for name in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        found = system.listFiles(where, True)
        while found.hasNext():
            file = found.next()
            told.append(f"{file.getPath()} {file.getLen()} {file.getModificationTime()}")
    return "\n".join(sorted(told))


def with_views(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in _needed(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view; a view's text runs over DataFrames bound by name, so the catalog stays untouched."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in STORED:
        key = (spark.sparkContext.applicationId, _version(spark, sf_dir, _needed_tables(name)), name)
        if key not in _stored:
            _stored[key] = cut(_view(spark, sf_dir, name))
        return _stored[key]
    return _view(spark, sf_dir, name)


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reads, text = VIEWS[name]
    if not reads:
        return spark.sql(text)
    # {name} placeholders bind DataFrames
    bound = re.sub(rf"\b(FROM|JOIN) ({'|'.join(reads)})\b", r"\1 {\2}", text)
    return spark.sql(bound, **{r: table(spark, sf_dir, r) for r in reads})


def _built(spark: SparkSession, sf_dir: str, name: str, build):
    """An index over a table's present files, built once in a session; a table written anew is indexed anew."""
    key = (spark.sparkContext.applicationId, _version(spark, sf_dir, (INDEXED[name],)), name)
    if key not in _stored:
        _stored[key] = build(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _stored[key]


INDEXED = {"keyword_index": "documents", "vector_index": "embeddings"}


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    return _built(spark, sf_dir, "keyword_index", lambda root: KeywordIndex(spark, root).add(table(spark, sf_dir, "documents")))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return _built(spark, sf_dir, "vector_index", lambda root: VectorIndex(spark, root).build(table(spark, sf_dir, "embeddings")))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]
