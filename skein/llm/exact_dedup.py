"""Exact dedup with DataFrame functions only.

Documents meet under the 128-bit hash of their normalised text together with the text itself, so a group is a set of
equal bytes: Spark compares the bytes of keys that share a hash, which excludes collisions. The grouping combines on the
map side, so of a text that fills a third of the table each map task sends one row. The documents then join their
group's row on hash and digest; adaptive execution splits a skewed side of that join.

Defined results: a null text is empty; an id that is null never beats another, and rows without an id keep each other's
group when no row of it has one; repeated rows of one id and text count each and are kept together.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. ASCII texts take the JVM's byte-wise way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and text_sha256. keep: ``min`` or ``max`` of the ids stays."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    normal = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("normal"))
    digests = [F.md5("normal").alias("content_hash"), F.sha2("normal", 256).alias("text_sha256")]
    pick = F.max if keep == "max" else F.min
    groups = (
        normal.select("doc_id", "normal", F.md5("normal").alias("content_hash"))
        .groupBy("content_hash", "normal")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content_hash", F.sha2("normal", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    rows = normal.select("doc_id", *digests)
    return rows.join(groups, ["content_hash", "text_sha256"]).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
