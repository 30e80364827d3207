"""The training-data pipeline: five stages, each over all rows that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, minhash, mixing, token_store, toxicity
from skein.llm.storage import Scratch


#: The setting that names the folder for the pipeline's output.
OUTPUT = "spark.skein.pipeline.output"


def _new_names(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column has."""
    return [max(docs.columns, key=len) + "_" + name for name in names]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.chain_labels(labels), toxicity.CHAIN)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays, of one id's the one whose text has the smallest MD5 digest;
    documents without an id stay."""
    named = docs.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        dropped = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    # ids repeat, so each different row has a number of its own in the order of id and digest
    of, row, number = _new_names(docs, "of", "row", "number")
    named = named.withColumn(row, F.md5(F.coalesce("text", F.lit(""))))
    keys = named.select(F.col("doc_id").alias(of), row).distinct().repartitionByRange(of, row).sortWithinPartitions(of, row)
    keys = Scratch(spark, "numbered").keep(keys.withColumn(number, F.monotonically_increasing_id()), "keys")
    numbered = named.withColumn(of, F.col("doc_id")).join(keys, [of, row])
    kept = minhash.near_duplicates(numbered.select(number, "text"), id_col=number).where("kept").select(number)
    one = numbered.join(kept, number, "left_semi").dropDuplicates([number]).select(docs.columns)
    return one.union(docs.where("doc_id IS NULL").select(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it, to the nearest whole number; one without words stands once."""
    of, copies, copy = _new_names(docs, "of", "copies", "copy")
    share = mixing.mix(docs).groupBy("doc_id").agg((F.sum("taken") / F.nullif(F.sum("size"), F.lit(0))).alias("share"))
    known = share.select(F.col("doc_id").alias(of), F.coalesce(F.round("share"), F.lit(1)).cast("int").alias(copies)).where(F.col(copies) > 0)
    met = docs.join(known, F.col("doc_id").eqNullSafe(F.col(of)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string-table shards, read back as one row per entry.

    The shards and their manifest stay in a new folder under the one that the session's ``spark.skein.pipeline.output`` names; without it
    they are scratch files, which end with the driver.
    """
    output = spark.conf.get(OUTPUT, None)
    folder = f"{output.rstrip('/')}/tokens-{uuid.uuid4().hex}" if output else None
    return token_store.store_tokens(docs, token_store.default_tokenizer(), folder=folder)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: Classifiers, hash minima and tokenizers are beyond SQL. Tests hold every stage but the classifier's, and the whole run behind it, against
#: plain programs that give the exact rows; the classifier is held against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = scratch.keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
