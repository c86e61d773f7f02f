"""Result tables, replaced whole or by the parts a run is about."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from duskline.sources.lineage import remove_folder

# What the last run of each source read and wrote, beside the table; readers of the table pass over it.
MANIFEST = "_manifest"
STATE = "kind string, file string, bytes long, changed timestamp"

Paths = Mapping[str, str | Sequence[str]]


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    file_format: str = "parquet",
    rebalance: bool = False,
) -> None:
    """Write ``df`` to ``path``, replacing what is there; CSV gets a header.

    No shuffle is added by default. City files arrive with one city and, as they
    are kept in order of time, few years per task, so that a task writes few
    files. Where the rows are mixed, ``rebalance`` shuffles them into files of even
    size; AQE cuts the part of a city that holds most rows into many.
    """
    if file_format not in ("parquet", "csv"):
        raise ValueError(f"unknown file format: {file_format}")
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if file_format == "csv":
        writer.option("escape", '"').csv(path, header=True)
    else:
        writer.parquet(path)


def replace_parts(
    df: DataFrame, path: str, partition_by: Sequence[str], paths: Paths, rebalance: bool = False
) -> None:
    """Replace what the sources in ``paths`` have in the table at ``path``; other files stay as they are.

    ``partition_by`` begins with the column that names the source. The parts in ``df`` are replaced
    first, then those that a source no longer has go, and last the sources' manifest
    is replaced: the files read and the files written. A run that ends in between leaves a
    manifest that differs from the files, and ``changed_sources`` then names the source again. ``df`` is
    read twice, so it should be a saved table.
    """
    spark, source = df.sparkSession, partition_by[0]
    rows = df.hint("rebalance", *partition_by) if rebalance else df
    _dynamic(rows, partition_by, path)
    # One row per part: as many as sources times years.
    kept = {_folder(spark, row.asDict()) for row in df.select(*partition_by).distinct().collect()}
    for name in paths:
        top = _folder(spark, {source: name})
        for part in _parts(spark, path, top, len(partition_by)):
            if part not in kept:
                remove_folder(spark, f"{path}/{part}")
    _dynamic(_state(spark, path, source, paths).repartition(1), [source], f"{path}/{MANIFEST}")


def _dynamic(df: DataFrame, partition_by: Sequence[str], path: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)


def table_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns of a table that sources have been written to; none where there is no such table."""
    return spark.read.parquet(path).columns if _exists(spark, f"{path}/{MANIFEST}") else []


def changed_sources(spark: SparkSession, path: str, source: str, paths: Paths) -> list[str]:
    """The sources whose files to be read, or whose written files, are not those of the manifest.

    Files are compared by name, size and time, so their content is not read.
    """
    if not _exists(spark, f"{path}/{MANIFEST}"):
        return list(paths)
    schema = T.StructType.fromDDL(STATE).add(source, T.StringType())
    told = spark.read.schema(schema).parquet(f"{path}/{MANIFEST}")
    now = _state(spark, path, source, paths)
    rows = now.withColumn("side", F.lit(1)).unionByName(told.withColumn("side", F.lit(2)))
    once = rows.groupBy(*now.columns).agg(F.sum("side").alias("sides")).where(F.col("sides") != 3)
    changed = {row[0] for row in once.select(source).distinct().collect()}
    return [name for name in paths if name in changed]


def _state(spark: SparkSession, path: str, source: str, paths: Paths) -> DataFrame:
    """The files to be read and those written, by source; made by listing them."""
    found = []
    for name, read in paths.items():
        written = f"{path}/{_folder(spark, {source: name})}"
        places = {"read": [read] if isinstance(read, str) else list(read)}
        if _exists(spark, written):
            places["written"] = [written]
        for kind, listed in places.items():
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(listed)
            state = [F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed")]
            found.append(files.select(F.lit(name).alias(source), F.lit(kind).alias("kind"), *state))
    return reduce(DataFrame.unionByName, found)


def _folder(spark: SparkSession, values: Mapping[str, object]) -> str:
    """The folder of a part, with Spark's own escapes."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(
        escaped.getPartitionPathString(name, None if value is None else str(value)) for name, value in values.items()
    )


def _parts(spark: SparkSession, path: str, folder: str, depth: int) -> list[str]:
    """The folders ``depth`` levels deep in the table, below one of the first level."""
    found = [folder] if _exists(spark, f"{path}/{folder}") else []
    for _ in range(depth - 1):
        found = [f"{one}/{name}" for one in found for name in _names(spark, f"{path}/{one}")]
    return found


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [one.getPath().getName() for one in system.listStatus(path) if one.isDirectory()]


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
