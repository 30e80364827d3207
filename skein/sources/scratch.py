"""Tables in the shared store, to cut the lineage of deep traversals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skein-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cut(df: DataFrame) -> DataFrame:
    """Materialises a plan as Parquet in the shared store and reads it back; the table goes when the driver ends, or by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, where = _at(spark, path)
    system.deleteOnExit(where)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Removes tables made by ``cut`` that nothing reads any more."""
    for table in tables:
        system, where = _at(table.sparkSession, table.scratch_path)
        system.delete(where, True)
