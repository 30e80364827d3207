"""The engine as one object: a method per tool, each giving a DataFrame, and batches of them."""

from __future__ import annotations

import copy
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.functions.chunks import hash_embedding
from skein.functions.conventions import DEFAULTS
from skein.operators import graph, search

LIMITS = {"k": (1, 50), "max_hops": (1, 10), "query": (3, 500), "files": (1, 100), "batch": (1, 20), "page": (1, 10_000), "page_size": (1, 100)}
TOOLSETS = {
    "all": ("search", "stack_trace", "dependency_graph", "blast_radius", "file", "commit_diff", "test_map", "conventions", "risk_context", "reindex"),
    "incident": ("stack_trace", "search", "file", "dependency_graph", "blast_radius"),
    "review": ("blast_radius", "risk_context", "test_map", "commit_diff", "conventions"),
    "search": ("search", "file"),
}


def within(name: str, value: int) -> int:
    low, high = LIMITS[name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")
    return value


class CodeIntel:
    """tables: DataFrames by name: files, imports, defines, belongs_to, modified, commits, contents, units."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, tables

    def _seeds(self, files: list, column: str) -> DataFrame:
        within("files", len(files))
        kind = self.tables["files"].schema["file_path"].dataType.simpleString()
        return self.spark.createDataFrame([(f,) for f in files], f"{column} {kind}")

    def search(self, query: str, k: int = 10, reranked: bool = False, max_tokens: int = 4096, **filters) -> DataFrame:
        """units: (vec_id, file_path, content, embedding, ...). Recall, metrics, evidence, confidence, token budget."""
        within("query", len(query))
        vector = self.spark.createDataFrame([(query,)], "q string").select(hash_embedding("q").alias("v")).first()["v"]
        t = self.tables
        hits = search.vector_search(t["units"], list(vector), within("k", k), min_certainty=None, **filters)
        metrics = graph.file_metrics(t["files"], t["defines"], t["imports"]).select("file_path", "fan_in", "fan_out")
        found = search.assemble(hits, metrics, graph.latest_commit(t["modified"], t["commits"]), reranked)
        return search.trim_to_budget(search.first_of_each(found, ("file_path", "vec_id"), ("recall_rank",)), max_tokens, (F.desc("confidence"), "recall_rank"))

    def blast_radius(self, files: list, max_hops: int = 5) -> DataFrame:
        t = self.tables
        return graph.blast_radius(t["imports"], self._seeds(files, "file_path"), t["belongs_to"], within("max_hops", max_hops)).orderBy(F.desc("acs_score"), "file_path")

    def dependency_graph(self, file, max_hops: int = 3) -> DataFrame:
        return graph.dependency_star(self.tables["imports"], self._seeds([file], "seed"), within("max_hops", max_hops))

    def stack_trace(self, trace: str, extended: bool = False) -> DataFrame:
        """Frames with the newest commit that touched their line, if their file is known."""
        frames = text.stack_frames(self.spark.createDataFrame([(1, trace)], "trace_id int, trace string"), extended=extended)
        hunks = self.tables["modified"].join(self.tables["commits"], "commit_hash").withColumnRenamed("file_path", "of")
        met = frames.join(hunks, (F.col("of").cast("string") == F.col("file_path")) & graph.ranges_overlap("lo", "hi", F.col("line_number"), F.col("line_number")))
        newest = met.groupBy("trace_id", "pos").agg(F.max(F.struct("commit_date", "commit_hash"))["commit_hash"].alias("commit_hash"))
        return frames.join(newest, ["trace_id", "pos"], "left").orderBy("pos")

    def file(self, path) -> DataFrame:
        return self.tables["contents"].where(F.col("file_path") == path).select("file_path", "content", F.size(F.split("content", "\n")).alias("total_lines"), text.language_of(F.col("file_path").cast("string")).alias("language"))

    def commit_diff(self, commit) -> DataFrame:
        """The files of a commit with their direct dependents."""
        changed = self.tables["modified"].where(F.col("commit_hash") == commit).select("file_path").distinct()
        users = self.tables["imports"].groupBy(F.col("dst").alias("file_path")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))
        return changed.join(users, "file_path", "left")

    def test_map(self, files: list) -> DataFrame:
        return graph.reachable_tests(self.tables["imports"], self._seeds(files, "file_path"), text.is_test_file(F.col("node").cast("string")))

    def risk_context(self, files: list, max_hops: int = 5) -> DataFrame:
        return graph.risk_context(self._seeds(files, "file_path"), self.tables["files"], self.tables["imports"], max_hops)

    def conventions(self, known: dict[str, dict] | None = None, service: str = "") -> dict:
        """A service's conventions, or the defaults."""
        return (known or {}).get(service) or copy.deepcopy(DEFAULTS)

    def reindex(self, repo_id, jobs: DataFrame, as_of) -> DataFrame:
        """jobs with a pending one more."""
        return jobs.unionByName(self.spark.range(1).select(F.lit(str(uuid.uuid4())).alias("job_id"), F.lit(repo_id).alias("repo_id"), F.lit("pending").alias("status"), F.lit(as_of).alias("created_at")), allowMissingColumns=True)

    def batch(self, calls: list[tuple[str, dict]], timeout_s: float = 5.0) -> list[dict]:
        """Up to 20 tools at once, in a fair pool; results in order, each with status ok, error or timeout and its rows."""
        within("batch", len(calls))
        spark, tag = self.spark, uuid.uuid4().hex

        def run(i: int, name: str, arguments: dict) -> list:
            if name not in TOOLSETS["all"]:
                raise ValueError(f"unknown tool {name}")
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", "batch")
            spark.addTag(f"{tag}-{i}")
            try:
                out = getattr(self, name)(**arguments)
                return out.collect() if isinstance(out, DataFrame) else [out]
            finally:
                spark.removeTag(f"{tag}-{i}")

        results = []
        with ThreadPoolExecutor(len(calls)) as pool:
            running = [pool.submit(run, i, *call) for i, call in enumerate(calls)]
            for i, future in enumerate(running):
                try:
                    results.append({"status": "ok", "rows": future.result(timeout_s)})
                except Late:
                    spark.interruptTag(f"{tag}-{i}")
                    results.append({"status": "timeout", "rows": []})
                except Exception as e:
                    results.append({"status": "error", "error": str(e), "rows": []})
        return results
