"""Vector, keyword and hybrid search, and the assembly of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import centrality

# fixed values: weights of certainty, rerank score and centrality, without and with reranking
WEIGHTS = {"tested": {False: (0.5, 0.0, 0.5), True: (0.5, 0.35, 0.15)}, "as_coded": {False: (0.5, 0.0, 0.15), True: (0.5, 0.35, 0.5)}}
#: Of Okapi BM25.
K1, B = 1.2, 0.75
RESULT_OVERHEAD = 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))  # null for a vector without a direction


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Rows with column == value for each wanted value that is not None."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v is not None), df)


def vector_search(units: DataFrame, query: list[float], limit: int = 10, offset: int = 0, min_certainty: float | None = 0.7, id_col: str = "vec_id", vector_col: str = "embedding", **filters) -> DataFrame:
    """The nearest rows by cosine: certainty (1 + cos) / 2 and distance 1 - cos.

    Filters come before the ranking and reach the scan; the certainty filter after limit and offset, and a null or zero
    certainty passes it. A scan with a top-k heap per task: nothing is shuffled but ``limit + offset`` rows of each.
    """
    score = cosine(F.col(vector_col), F.array(*map(F.lit, query)))
    hits = where_all(units, **filters).withColumn("cos", score).withColumn("certainty", (1 + F.col("cos")) / 2)
    hits = hits.orderBy(F.desc("certainty"), id_col).offset(offset).limit(limit)
    if min_certainty is not None:
        hits = hits.where(F.isnull("certainty") | (F.col("certainty") == 0) | (F.col("certainty") >= min_certainty))
    return hits.select(id_col, *(c for c in units.columns if c not in (id_col, vector_col)), "certainty", (1 - F.col("cos")).alias("distance"))


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float = 0.5, limit: int = 10, constant: int = 60, id_col: str = "doc_id") -> DataFrame:
    """Ranked fusion: alpha / (constant + vector rank) + (1 - alpha) / (constant + keyword rank). Both sides are top lists."""
    def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
        return df.select(id_col, F.row_number().over(Window.orderBy(F.desc(by), id_col)).alias(name))

    both = ranked(vector_hits, "certainty", "rv").join(ranked(keyword_hits, "score", "rk"), id_col, "full")
    score = F.coalesce(alpha / (constant + F.col("rv")), F.lit(0.0)) + F.coalesce((1 - alpha) / (constant + F.col("rk")), F.lit(0.0))
    return both.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def confidence(certainty: Column, rerank: Column, central: Column, reranked: bool = False, profile: str = "tested") -> Column:
    a, b, c = WEIGHTS[profile][reranked]
    return F.greatest(F.least(a * F.coalesce(certainty, F.lit(0.0)) + b * F.coalesce(rerank, F.lit(0.0)) + c * F.coalesce(central, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def assemble(hits: DataFrame, metrics: DataFrame | None, latest: DataFrame, reranked: bool = False, profile: str = "tested", key: str = "file_path") -> DataFrame:
    """Hits with metrics, newest commit and confidence, in the order of confidence, then recall rank.

    With metrics a hit on an unknown file is dropped; without them it stays with centrality 0.
    """
    hits = hits.withColumn("recall_rank", F.row_number().over(Window.orderBy(F.desc("certainty"), key)))
    out = hits.join(metrics, key) if metrics is not None else hits.withColumns({"fan_in": F.lit(0), "fan_out": F.lit(0)})
    out = out.join(latest, key, "left").withColumn("rerank_score", F.coalesce("certainty", F.lit(0.5)))
    score = confidence(F.col("certainty"), F.col("rerank_score"), centrality(F.col("fan_in"), F.col("fan_out")), reranked, profile)
    return out.withColumn("confidence", score).orderBy(F.desc("confidence"), "recall_rank")


def trim_to_budget(results: DataFrame, max_tokens: int = 4096, order: tuple = ("rank",), content: str = "content", path: str = "file_path") -> DataFrame:
    """The longest prefix of the results whose running cost stays within 4 * max_tokens characters.

    Nulls cost as empty texts. Each result costs the overhead at least, so no more than budget / overhead can stay; only
    so many, the first in the order, reach the window.
    """
    cost = F.coalesce(F.char_length(content), F.lit(0)) + F.coalesce(F.char_length(path), F.lit(0)) + RESULT_OVERHEAD
    results = results.orderBy(*order).limit(4 * max_tokens // RESULT_OVERHEAD)
    running = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("running_cost", running).where(F.col("running_cost") <= 4 * max_tokens)


def first_of_each(results: DataFrame, keys: tuple[str, ...], order: tuple) -> DataFrame:
    """Of rows with equal keys the first in the order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return results.withColumn("_place", place).where("_place = 1").drop("_place")


def with_dependencies(results: DataFrame, found: DataFrame, first: int = 5, key: str = "file_path") -> DataFrame:
    """found: (seed, direction, node, length). Adds the nearest dependencies each way and their total."""
    nearest = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("length", "node"))), 1, first), lambda x: x["node"])
    sides = found.groupBy(F.col("seed").alias(key), "direction").agg(nearest.alias("nearest"), F.count(F.lit(1)).alias("n"))
    flat = sides.groupBy(key).agg(*(F.max(F.when(F.col("direction") == d, F.col("nearest"))).alias(d) for d in ("upstream", "downstream")), F.sum("n").alias("total_dependencies"))
    return results.join(flat, key, "left").withColumn("total_dependencies", F.coalesce("total_dependencies", F.lit(0)))


#: Metadata that a response shows.
SHOWN = ("dependency_count", "acs_score", "total_lines")


def for_response(results: DataFrame) -> DataFrame:
    """results with confidence, evidence fields and a metadata map, as the response shows them."""
    evidence = F.struct(F.col("commit_hash").alias("commit_sha"), "author", F.col("commit_date").alias("last_modified"))
    shown = F.map_filter("metadata", lambda k, v: k.isin(*SHOWN))
    rest = [c for c in results.columns if c not in ("confidence", "commit_hash", "author", "commit_date", "metadata")]
    return results.select(*rest, F.round("confidence", 3).alias("confidence"), evidence.alias("evidence"), shown.alias("metadata"))
