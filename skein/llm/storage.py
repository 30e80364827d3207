"""Shared scratch tables: cut lineage by writing Parquet where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where nothing is set, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Parquet tables under one folder of the shared store.

    ``keep`` materialises a plan and returns a fresh scan of it, so a lost executor costs a re-read and no
    recomputation. ``drop`` removes a table that nothing reads any more; the folder goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._made = 0
        system, where = self._at(self.root)
        system.mkdirs(where)
        system.deleteOnExit(where)

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def path(self, label: str) -> str:
        self._made += 1
        return f"{self.root}/{self._made:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.remove(table.scratch_path)

    def remove(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)
