"""Writing and reading the engine's tables, partitioned by repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import uuid5
from skein.operators.relational import upsert

#: Keys by which rows are merged.
KEYS = {"repositories": ("repo_id",), "files": ("repo_id", "file_path"), "symbols": ("repo_id", "file_path", "name", "start_line"), "services": ("repo_id", "name"), "units": ("unit_id",)}


def write(df: DataFrame, root: str, name: str) -> None:
    """Replaces the repositories that df holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str, repo_id=None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{name}")
    return df if repo_id is None else df.where(F.col("repo_id") == repo_id)


def merge(now: DataFrame, new: DataFrame, name: str, order: str | None = None) -> DataFrame:
    return upsert(now, new, KEYS[name], order)


def relative_imports(files: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with phantom targets, distinct edges) of the imports that are relative."""
    edges = imports.where("is_relative").select("src", "dst").distinct()
    phantom = edges.select(F.col("dst").alias("file_path")).distinct().join(files, "file_path", "left_anti")
    return files.unionByName(phantom, allowMissingColumns=True), edges


def call_edges_of(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """ids: (caller, callee) as path::name. Ids of two parts whose symbols exist on both sides become edges."""
    def parts(c: str) -> Column:
        return F.split(c, "::")

    ok = ids.where((F.size(parts("caller")) == 2) & (F.size(parts("callee")) == 2)).distinct()
    known = symbols.select(F.concat_ws("::", "file_path", "name").alias("id")).distinct()
    return ok.join(known.withColumnRenamed("id", "caller"), "caller", "left_semi").join(known.withColumnRenamed("id", "callee"), "callee", "left_semi")


def unit_id(repo_id: Column, path: Column, symbol: Column, line: Column) -> Column:
    return uuid5(F.concat_ws(":", repo_id, path, symbol, line.cast("string")))


def delete_repository(tables: dict[str, DataFrame], repo_id) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without a repository, and one row with how many rows went."""
    gone = [t.where(F.col("repo_id") == repo_id).select(F.lit(1).alias("x")) for t in tables.values()]
    total = gone[0]
    for g in gone[1:]:
        total = total.union(g)
    return {n: t.where(F.col("repo_id") != repo_id) for n, t in tables.items()}, total.agg(F.count(F.lit(1)).alias("deleted"))


def live_entries(cache: DataFrame, as_of: Column, ttl_s: dict[str, int]) -> DataFrame:
    """cache: (namespace, key, value, written_at). Entries within their namespace's time to live."""
    ttl = F.create_map(*(F.lit(x) for kv in ttl_s.items() for x in kv))
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("written_at").cast("timestamp"))
    return cache.where(age < F.try_element_at(ttl, F.col("namespace")))


def invalidate(cache: DataFrame, pattern: str) -> DataFrame:
    """Without the keys that match a pattern with * and ?."""
    import fnmatch

    return cache.where(~F.col("key").rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$")))
