"""Helpers the text operators share."""

from __future__ import annotations

import gc
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duskline.sources.lineage import shared_folder

# Whole texts travel to Python; so few rows a batch bound a task's memory.
ROWS_PER_BATCH = 512


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder name of its own below the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/duskline-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: a lost executor does not send later jobs back to the texts.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    release(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_place(df: DataFrame, key: str, label: str, buckets: int = 0) -> DataFrame:
    """Like ``saved``, but lying by ``key``: what is grouped with it by that key comes to it.

    The table is written to the shared folder, in ``buckets`` or, if they are more, as many as a shuffle
    has. The catalog's entry goes at once; the files stay.
    """
    spark = df.sparkSession
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", new_folder(spark, label))
    writer.bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, as soon as nothing refers to them.

    It does so when the driver collects its garbage, which else may take half an hour.
    """
    gc.collect()
    spark._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Like ``release``, but for what was let go just now.

    The driver's Python tells the JVM once a second which objects it no longer holds, and those that
    hold others take two rounds; a collection before that keeps the shuffle files of the
    step that has just ended.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(1.2)
        release(spark)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table made by ``saved`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {path.rpartition("/")[0] for path in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def splittable(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, so that a join by key gets a shuffle of its own for it.

    An aggregate that already lies by the join's key would tie the join to that
    shuffle, and AQE could not split a key that is hot on the other side. For
    tables much smaller than the other side only.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ready(spark: SparkSession) -> None:
    """Small batches, and workers on this machine find the package as the driver did.

    A cluster gets the package through ``--py-files`` or its own installation.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if (root := str(Path(__file__).resolve().parents[2])) not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(doc_id.cast("string")) % divisor


def held_out(doc_id: Column, divisor: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == value, F.lit(False))
