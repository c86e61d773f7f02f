"""Scans of stop files, census files and saved tables."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from io import StringIO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from duskline.fixed import INDEX_COLUMNS
from duskline.functions.text import blank_to_null
from duskline.session import ready_workers
from duskline.sources.quoted import quoted_rows

# The text of a row that is none of the table's, else null; and the file a row came from.
MALFORMED = "_malformed_row"
SOURCE_FILE = "_source_file"

CSV = dict(quote='"', escape='"')

# Larger than any file: every file is one task of its own.
_ONE_FILE_A_TASK = {
    "spark.sql.files.maxPartitionBytes": str(1 << 40),
    "spark.sql.files.openCostInBytes": str(1 << 40),
}

Paths = Mapping[str, str | Sequence[str]]


def read_text_table(
    spark: SparkSession,
    path: str | Sequence[str],
    multi_line: bool = False,
    strict: bool = True,
    header: Sequence[str | None] | None = None,
    folder: str | None = None,
) -> DataFrame:
    """A CSV with a header, all columns text, missing-value tokens as null.

    A row with more or fewer fields than the header stops the job, as does a quoted
    line break without ``multi_line``. With ``strict=False`` such a row is kept: the
    column ``MALFORMED`` holds its text, null in all other rows, and ``SOURCE_FILE`` the file of each row.

    Nothing is inferred, so only the header is read before the query runs; ``header`` gives its
    fields where they are known. With several files, a file whose header differs stops the job.
    ``multi_line`` accepts line breaks inside quotes. The lines are then numbered first and kept in ``folder``
    (see ``quoted_rows``), and a large file is still read by many tasks.
    """
    files = [path] if isinstance(path, str) else list(path)
    if header is None:
        header = file_headers(spark, {"": files})[""]
    names = column_names(header)
    if multi_line:
        table = _quoted_table(spark, files, header, names, folder)
    else:
        table = _plain_table(spark, files, header, names)
    if strict:
        # Spark refuses to read the text of malformed rows alone; so another column goes with it.
        shown = F.concat(F.col(MALFORMED), F.lit(" in a row with first field "), table[names[0]])
        bad = _stopped(F.concat(F.lit("malformed row: "), F.coalesce(shown, F.col(MALFORMED))))
        kept = F.when(F.col(MALFORMED).isNull(), True).otherwise(bad)
        table = table.where(kept).drop(MALFORMED, SOURCE_FILE)
    return drop_index(blank_to_null(table, but=(MALFORMED, SOURCE_FILE)))


def _plain_table(
    spark: SparkSession, files: Sequence[str], header: Sequence[str | None], names: Sequence[str]
) -> DataFrame:
    # Files are compared with what the first one holds, not with the names Spark gives to blanks;
    # names that occur more than once can't be compared.
    heads = [field or "" for field in header]
    repeated = len({head.lower() for head in heads}) < len(heads)
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*(names if repeated else heads), MALFORMED]])
    # A row is only malformed where all its fields are read, so none are left out.
    reader = spark.read.schema(schema).option("columnPruning", False)
    options = dict(CSV, header=True, enforceSchema=repeated, mode="PERMISSIVE")
    table = reader.csv(list(files), columnNameOfCorruptRecord=MALFORMED, **options)
    named = table.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    return named.toDF(*names, MALFORMED, SOURCE_FILE)


def _quoted_table(
    spark: SparkSession,
    files: Sequence[str],
    header: Sequence[str | None],
    names: Sequence[str],
    folder: str | None,
) -> DataFrame:
    rows = quoted_rows(spark, files, folder)
    kinds = ", ".join("`" + name.replace("`", "``") + "` string" for name in [*names, MALFORMED])
    options = dict(CSV, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)
    parsed = rows.select("file", "row", "text", F.from_csv("text", kinds, options).alias("r"))
    fields = [F.col("r").getField(name) for name in names]
    same = [field.eqNullSafe(F.lit(head or None)) for field, head in zip(fields, header)]
    is_header = F.col("r").getField(MALFORMED).isNull() & F.forall(F.array(*same), lambda x: x)
    told = F.concat(F.lit("the header differs in "), "file", F.lit(": "), "text")
    kept = F.when(F.col("row") > 0, True).when(is_header, False).otherwise(_stopped(told))
    return parsed.where(kept).select("r.*", F.col("file").alias(SOURCE_FILE))


def _stopped(told: Column) -> Column:
    return F.raise_error(told).cast("boolean")


def read_cities(
    spark: SparkSession,
    paths: Paths,
    multi_line: bool = False,
    strict: bool = True,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """One text table per city; the columns may differ from city to city.

    The headers of all cities are read in one job. With ``multi_line`` each city's lines are kept in a
    folder below ``folder``, if that is given.
    """
    files = {city: [path] if isinstance(path, str) else list(path) for city, path in paths.items()}
    headers = file_headers(spark, files)
    return {
        city: read_text_table(spark, files[city], multi_line, strict, headers[city], folder and f"{folder}/{place}")
        for place, city in enumerate(paths)
    }


def city_columns(spark: SparkSession, paths: Paths) -> dict[str, list[str]]:
    """The columns of each city's table, from the headers alone, in one job."""
    columns = {}
    for city, header in file_headers(spark, paths).items():
        names = column_names(header)
        columns[city] = names[1:] if names[0] in INDEX_COLUMNS else names
    return columns


def file_headers(spark: SparkSession, paths: Paths) -> dict[str, list[str | None]]:
    """The fields of each table's header, blank ones as None.

    One distributed job whatever the number of tables: the first file of each is a task that ends
    with its header. A second job looks at all files of those tables whose first file is empty.
    """
    files = {name: sorted(map(_location, _listed(spark, path))) for name, path in paths.items()}
    first = {name: found[0] for name, found in files.items() if found}
    heads = _first_rows(spark, list(first.values()))
    headers = {name: heads.get(path) for name, path in first.items()}
    empty = {name: files[name][1:] for name, head in headers.items() if head is None}
    if any(empty.values()):
        heads = _first_rows(spark, [path for found in empty.values() for path in found])
        headers |= {name: next((heads[p] for p in found if p in heads), None) for name, found in empty.items()}
    if missing := [name or "the files" for name in paths if headers.get(name) is None]:
        raise ValueError(f"no header found for {', '.join(missing)}")
    return {name: [field or None for field in next(csv.reader(StringIO(headers[name])))] for name in paths}


def _listed(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    return spark.read.text([path] if isinstance(path, str) else list(path)).inputFiles()


def _location(uri: str) -> str:
    """A file's name as the scans take it; Spark tells it with different escapes and slashes."""
    parts = urlsplit(uri)
    place = f"//{parts.netloc}" if parts.netloc else ""
    return f"{parts.scheme}:{place}{unquote(parts.path)}" if parts.scheme else unquote(uri)


def _first_rows(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """The first row of each file that has one; a header may hold quoted line breaks."""
    if not files:
        return {}
    ready_workers(spark)
    scan = spark.read.text(list(files), lineSep="\n")
    lines = scan.select("value", "_metadata.file_path", "_metadata.file_block_start")
    with _settings(spark, _ONE_FILE_A_TASK):
        rows = lines.mapInArrow(_first_row, "file string, text string").collect()
    return {_location(row["file"]): row["text"] for row in rows}


def _first_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of the task's file.

    The rest of a large file is not waited for, which costs a new worker; a small one ends anyway.
    """
    parts: list[str] = []
    found = False
    for batch in batches:
        if found:
            return
        for text, file, start in zip(*(column.to_pylist() for column in batch.columns)):
            if start > 0:
                return
            if parts or text.strip():
                parts.append(text.removesuffix("\r"))
            if parts and sum(part.count('"') for part in parts) % 2 == 0:
                yield pa.RecordBatch.from_pydict({"file": [file], "text": ["\n".join(parts)]})
                found = True
                break


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for one job; the session has its own again afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def column_names(header: Sequence[str | None]) -> list[str]:
    """Names of a header's fields as Spark gives them: blanks by place, repeated ones with it."""
    lowered = [(field or "").lower() for field in header]
    return [
        f"_c{i}" if not field else f"{field}{i}" if lowered.count(field.lower()) > 1 else field
        for i, field in enumerate(header)
    ]


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """A saved Parquet table, typed, with column pruning and filter pushdown."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def drop_index(df: DataFrame) -> DataFrame:
    """Remove a row index that another program saved as the first column."""
    return df.drop(*[name for name in df.columns[:1] if name in INDEX_COLUMNS])
