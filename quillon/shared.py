"""Shared-storage helpers: cutting lineage and reading tables by any path Spark can open."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where none is named, a local master gets a folder of our own, as in
    tests; any other raises, as a temporary folder would be another one on each machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return named or context.getCheckpointDir()


#: Shuffle files of a plan are removed when it has run.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the shared checkpoint folder: later readers neither recompute it nor depend on an executor. The
    shuffle files of its plan are needed no more and are removed."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own under the shared one, by any path Spark can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder, local or remote."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
