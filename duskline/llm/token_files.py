"""Token ids of documents in binary files, with Elias-Fano document bounds.

Every file holds the ids of its documents one after another, two bytes each where
the vocabulary fits and else four, and two Elias-Fano lists: the document ids and
the ends of the documents. The files are in ascending order of ``doc_id``.

Defined cases: a null text is empty, an empty text has the end id alone; a null
``doc_id`` comes first; repeated ids stay, in the order of their texts' hash;
other columns are not read; an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from duskline.llm.common import new_folder, saved, ready, splittable
from duskline.llm.elias_fano import TokenFile, token_file
from duskline.llm.tokens import byte_encoder, load

# A file is closed once it holds so many bytes of ids; one document is never cut.
FILE_BYTES = 32 << 20
# Texts that are encoded at once hold about so many bytes.
GATHERED_BYTES = 8 << 20
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, as many texts share their words."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= GATHERED_BYTES:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Encode ``text`` of ``docs`` into token files below ``folder``; returns their manifest.

    One shuffle deals the texts out in ranges of ``doc_id``; a task encodes and
    writes its range. Files have names of their own, and only those of tasks that
    ended well are in the manifest, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    ready(spark)
    id_bytes = 2 if load(tokenizer).get_vocab_size() <= 1 << 16 else 4
    kind = f"<u{id_bytes}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder = byte_encoder(tokenizer, kind)
        end = np.array([end_id], kind).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        bodies: list[bytes] = []
        ends: list[int] = []
        size = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            store, place = fs.FileSystem.from_uri(path)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            data = token_file(b"".join(bodies), id_bytes, names, np.array(ends, np.int64))
            with store.open_output_stream(place) as out:
                out.write(data)
            row = dict(part=part, seq=seq, path=path, n_docs=len(names), n_ids=size // id_bytes)
            return pa.RecordBatch.from_pylist([row], manifest)

        for some in gathered(batches):
            ids = some["doc_id"].to_pylist()
            for doc_id, coded in zip(ids, encoder.encode(some["text"].combine_chunks())):
                bodies.append(body := bytes(coded) + end)
                size += len(body)
                names.append(doc_id)
                ends.append(size // id_bytes)
                if size >= file_bytes:
                    yield close()
                    names, bodies, ends, size, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    manifest = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string())]
        + [("n_docs", pa.int64()), ("n_ids", pa.int64())]
    )
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
        # Rows alike in id and text are dealt out by place, so that they need not meet in one task.
        .withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return saved(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it. The sum over files before
    runs on the manifest, which has a row for each 32 MB.
    """
    rows = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    found = TokenFile.read(file.read())
                names = [None] * found.nameless + found.doc_ids.values().tolist()
                ends = found.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                sums = [
                    zlib.crc32(found.ids[a:b].astype("<u4").tobytes())
                    for a, b in zip(starts.tolist(), ends.tolist())
                ]
                columns = [names, starts + base, ends - starts, sums]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=rows
                )

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select(
        "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")
    )
    return splittable(based).mapInArrow(read, ROWS)


def token_offsets(
    spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2
) -> DataFrame:
    """Documents written to token files in the shared folder and read back."""
    folder = new_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
