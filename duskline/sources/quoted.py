"""Rows of CSV files whose quoted fields hold line breaks, read by many tasks per file.

A line break ends a row if an even number of quotes lies before it in the file. Spark's text
scan cuts files into parts and gives each part's lines in order, so a task can number its lines,
and count quotes and row ends, for both cases: that its part starts outside quotes, or inside.
The lines are kept with these numbers. The sums of the parts, one small row each, then tell in file order
which case holds and how many rows end before the part. Lines that are rows of their
own stay where they are; only those of rows with breaks are brought together.

As the usual formats do, this takes every quote for one that opens, closes or is doubled; a lone
quote within a plain field would turn what follows inside out. So a row of very many
lines stops the job and is named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from duskline.session import ready_workers
from duskline.sources.lineage import run_folder

# A row of more lines than this is taken for a quote that is never closed.
MOST_LINES = 1000

_LINES = (
    "file string, start long, line long, text string, blank boolean, before boolean, odd boolean, "
    "rows_outside long, rows_inside long, ends_outside boolean, ends_inside boolean"
)
# What the reader of plain rows takes for white space in a blank line.
_BLANK = "".join(map(chr, range(33)))


class _Part:
    """The running numbers of one part of a file."""

    def __init__(self) -> None:
        self.line, self.inside = 0, False
        self.ended = {False: 0, True: 0}

    def numbered(self, file: str, start: int, text: pa.Array) -> dict[str, object]:
        odd = pc.count_substring(text, '"').to_numpy(zero_copy_only=False) % 2 == 1
        after = np.logical_xor.accumulate(np.r_[self.inside, odd])
        before, after = after[:-1], after[1:]
        blank = pc.equal(pc.utf8_trim(text, characters=_BLANK), "").to_numpy(zero_copy_only=False)
        size = len(odd)
        row = {"file": [file] * size, "start": [start] * size, "line": np.arange(self.line, self.line + size)}
        row |= {"text": text, "blank": blank, "before": before, "odd": odd}
        for case, name in ((False, "outside"), (True, "inside")):
            ends = (after == case) & ~(blank & (before == case))
            counted = self.ended[case] + np.cumsum(ends)
            row[f"rows_{name}"], row[f"ends_{name}"] = counted - ends, ends
            self.ended[case] = int(counted[-1])
        self.line += size
        self.inside = bool(after[-1])
        return row


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [kind.split()[0] for kind in _LINES.split(", ")]
    here, part = None, _Part()
    for batch in batches:
        files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        places = list(zip(files, starts))
        edges = [i for i in range(len(places)) if i == 0 or places[i] != places[i - 1]]
        for a, b in zip(edges, [*edges[1:], len(places)]):
            if places[a] != here:
                here, part = places[a], _Part()
            row = part.numbered(*here, batch.column(0).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(row[name]) for name in names], names=names)


def numbered_lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Lines of the files with their place in their part, and what holds in both cases."""
    ready_workers(spark)
    scan = spark.read.text(list(files), lineSep="\n")
    lines = scan.select("value", "_metadata.file_path", "_metadata.file_block_start")
    return lines.mapInArrow(_numbered, _LINES)


def file_parts(lines: DataFrame) -> DataFrame:
    """Per part of a file: whether it starts inside quotes, and the rows that end before it."""
    ended = {case: F.count_if(F.col(f"ends_{case}")).alias(case) for case in ("outside", "inside")}
    sums = lines.groupBy("file", "start").agg(F.count_if("odd").alias("quotes"), *ended.values())
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("opened", F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2 == 1)
    rows = F.sum(F.when(F.col("opened"), F.col("inside")).otherwise(F.col("outside"))).over(order)
    return placed.select("file", "start", "opened", F.coalesce(rows, F.lit(0)).alias("rows_before"))


def quoted_rows(
    spark: SparkSession, files: Sequence[str], folder: str | None = None, most_lines: int = MOST_LINES
) -> DataFrame:
    """``file, row, text``: the rows of CSV files, numbered from 0 in each file, blank lines left out.

    The numbered lines are written to ``folder``, by default one of this run's own below the shared
    folder, from which the rows are read; it may go when they have been used. The scan is so
    not repeated, and its parts can't be cut differently in between. Line breaks in fields
    become plain ones, as the usual readers make them.
    """
    folder = folder or run_folder(spark, "lines")
    numbered_lines(spark, files).write.mode("overwrite").parquet(folder)
    lines = spark.read.schema(_LINES).parquet(folder)
    # The parts are few beside the lines; Spark picks the join by their size.
    told = lines.join(file_parts(lines), ["file", "start"])
    inside = F.col("opened") != F.col("before")
    row = F.col("rows_before") + F.when(F.col("opened"), F.col("rows_inside")).otherwise(F.col("rows_outside"))
    placed = told.select("file", row.alias("row"), "start", "line", "text", "blank", "odd", inside.alias("inside"))
    single = ~F.col("inside") & ~F.col("odd")
    alone = placed.where(single & ~F.col("blank")).select("file", "row", "text")
    broken = placed.where(~single)
    longest = broken.groupBy("file", "row").agg(F.count(F.lit(1)).alias("lines"))
    worst = longest.orderBy(F.desc("lines"), "file", "row").first()
    if worst and worst["lines"] > most_lines:
        raise ValueError(
            f"row {worst['row']} of {worst['file']} has {worst['lines']} lines: a quote seems not to be closed"
        )
    pieces = F.sort_array(F.collect_list(F.struct("start", "line", "text")))["text"]
    joined = broken.groupBy("file", "row").agg(F.array_join(pieces, "\n").alias("text"))
    text = F.regexp_replace(F.regexp_replace("text", "\r$", ""), "\r\n", "\n")
    # The condition always holds. It keeps Catalyst from moving a filter on the text down to
    # lines that are no rows yet, where a filter that may stop the job would do so.
    kept = F.when(F.monotonically_increasing_id() >= 0, text)
    return alone.unionByName(joined).select("file", "row", kept.alias("text"))
