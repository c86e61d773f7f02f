"""Byte-pair encoding and decoding by a table of distinct words.

Texts are split at white space into words. A block of documents is kept as its list of
distinct words and, for each document, the places of its words in that list. The
lists of all blocks are dealt out by word; each distinct word is encoded once with
the library, its ids become pieces by a join with the vocabulary, and ids and pieces
go back to the blocks by place. Blocks are bounded, so a word that is in every text
comes once per block, and no text is dealt out by word.

Defined cases: a null text is empty and has no ids; texts that hold separators which
only Python takes for white space are one word; repeated rows stay; null document
ids stay; other columns are passed on where they are asked for; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from duskline.llm.common import dropped, new_folder, ready, saved, settle
from duskline.llm.tokens import WordEncoder, added_texts, distinct_pieces, listed, load, plain_words

# A block ends once its texts hold so many characters; one document is never cut.
BLOCK_CHARS = 32_000_000
MAX_WORDS = 400_000
# Words are counted after so many characters.
STEP_CHARS = 2_000_000
# Rows on their way from and to the blocks are put together up to about so many bytes.
PACKED_BYTES = 32 << 20
# Words of blocks that are joined with the table of words in one group, about.
BUCKET_WORDS = 1_000_000
ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def word_blocks(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS) -> str:
    """Name of a table ``block, doc_ids, lengths, places, words``, bucketed by block in the shared folder.

    ``places`` holds the places of all words of the block's documents, one after
    another, and ``lengths`` the number of words of each document. As the table lies by
    block, what comes back to the blocks meets it without moving it.
    """
    spark = docs.sparkSession
    ready(spark)

    added = added_texts(tokenizer)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0

        def fresh():
            return [], [], [], {}, 0

        # table: words to places
        doc_ids, lengths, places, table, size = fresh()

        def close() -> pa.RecordBatch:
            row = dict(block=part << 32 | seq, doc_ids=doc_ids, lengths=lengths)
            # Words in order, as neighbours then begin alike and pack well.
            ordered = sorted(table)
            place = np.empty(len(ordered), "<u4")
            place[[table[word] for word in ordered]] = np.arange(len(ordered))
            flat = place[np.concatenate(places)]
            # Each byte of the places apart, as the high ones are much alike.
            row |= dict(places=flat.view(np.uint8).reshape(-1, 4).T.tobytes(), words=ordered)
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            chars = np.cumsum(pc.utf8_length(texts).to_numpy())
            begin = before = 0
            while begin < len(names):
                # The text that fills the block is its last.
                room = min(block_chars - size, STEP_CHARS)
                end = min(int(np.searchsorted(chars, before + room)) + 1, len(names))
                found, which, sizes = distinct_pieces(texts.slice(begin, end - begin))
                known = [
                    [table.setdefault(word, len(table)) for word in plain_words(piece, added)]
                    for piece in listed(found)
                ]
                taken = pa.array(known, pa.list_(pa.uint32())).take(pa.array(which))
                ends = taken.offsets.to_numpy()[np.r_[0, np.cumsum(sizes)]]
                doc_ids.extend(names[begin:end])
                lengths.extend(np.diff(ends).tolist())
                places.append(taken.flatten().to_numpy())
                size += int(chars[end - 1]) - before
                begin, before = end, int(chars[end - 1])
                if size >= block_chars or len(table) >= MAX_WORDS:
                    yield close()
                    doc_ids, lengths, places, table, size = fresh()
                    seq += 1
        if doc_ids:
            yield close()

    schema = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32()))]
        + [("places", pa.binary()), ("words", pa.list_(pa.string()))]
    )
    kinds = "block long, doc_ids array<string>, lengths array<int>, places binary, words array<string>"
    # Ids travel as text, which keeps null and large ones whole on the way through pandas.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text")
    name = f"blocks_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(split, kinds).write.option("compression", "zstd")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer.bucketBy(buckets, "block").saveAsTable(name, path=new_folder(spark, "blocks"))
    return name


def vocabulary(spark: SparkSession, tokenizer: str) -> DataFrame:
    """``id, piece`` of a tokenizer file; as large as its vocabulary and no larger."""
    table = load(tokenizer).get_vocab(with_added_tokens=True)
    rows = pd.DataFrame({"id": table.values(), "piece": table.keys()})
    return spark.createDataFrame(rows, "id int, piece string")


def encoded_words(distinct: DataFrame, tokenizer: str) -> DataFrame:
    """``word, ids`` of distinct words. A column function, so the rows stay dealt out by word."""
    loaded = []

    @F.arrow_udf("array<int>")
    def encode(column: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(WordEncoder(tokenizer))
        return pa.array(loaded[0].encode(listed(column)), pa.list_(pa.int32()))

    return distinct.select("word", encode("word").alias("ids"))


def decoded_words(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, numbers, text``: the ids of each word, and their pieces by a join, with spaces between.

    The vocabulary is fixed by the tokenizer and so is small enough to be broadcast.
    Words that encode to nothing keep empty texts.
    """
    exploded = encoded.select("word", F.posexplode_outer("ids").alias("at", "id"))
    known = F.when(F.col("id").isNotNull(), F.struct("at", "id", "piece"))
    rows = exploded.join(F.broadcast(vocabulary), "id", "left").groupBy("word")

    def joined(name: str) -> Column:
        return F.array_join(F.transform("found", lambda x: x[name].cast("string")), " ")

    return rows.agg(F.sort_array(F.collect_list(known)).alias("found")).select(
        "word", joined("id").alias("numbers"), joined("piece").alias("text")
    )


def _packet(table: pa.Table) -> bytes:
    """Rows without nulls in one row of Arrow's compressed form: numbers as steps, texts as one and their lengths.

    Offsets and rising numbers hardly pack; lengths and steps are small and do.
    """
    lean = {}
    for name, column in zip(table.column_names, table.combine_chunks().columns):
        column = column.combine_chunks()
        if pa.types.is_integer(column.type):
            lean[name] = pa.array([np.diff(column.to_numpy(), prepend=0)], pa.list_(pa.int64()))
        else:
            ends = pa.array([0, len(column)], pa.int32())
            lean[name] = pc.binary_join(pa.ListArray.from_arrays(ends, column), "")
            lean[f"{name} lengths"] = pa.ListArray.from_arrays(ends, pc.binary_length(column))
    lean, sink = pa.table(lean), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, lean.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(lean)
    return sink.getvalue().to_pybytes()


def _rows(packet: bytes) -> pa.Table:
    """The rows of a ``_packet``."""
    lean, columns = pa.ipc.open_stream(packet).read_all(), {}
    for name in lean.column_names:
        column = lean[name].chunk(0)
        if name.endswith(" lengths"):
            continue
        if pa.types.is_list(column.type):
            columns[name] = np.cumsum(column.flatten().to_numpy())
        else:
            lengths = lean[f"{name} lengths"].chunk(0).flatten().to_numpy()
            ends = pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32))
            columns[name] = pa.StringArray.from_buffers(len(lengths), ends, column.buffers()[2])
    return pa.table(columns)


def packed(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, which are numbers, and ``packed``: the rows of the same keys that a task has.

    Names of rows and lengths of texts take more room than the texts, in files and shuffles.
    """
    names = [name for name in rows.columns if name not in keys]

    def by_keys(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).sort_by([(key, "ascending") for key in keys])
        found = [table[key].to_numpy() for key in keys]
        starts = np.r_[0, np.flatnonzero(np.any([np.diff(one) for one in found], axis=0)) + 1]
        ends = [*starts[1:].tolist(), len(table)]
        data = [_packet(table.select(names).slice(a, b - a)) for a, b in zip(starts.tolist(), ends)]
        columns = [*(pa.array(one[starts]) for one in found), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in batches:
            if len(batch):
                some.append(batch)
                size += batch.nbytes
            if size >= PACKED_BYTES:
                yield by_keys(some)
                some, size = [], 0
        if some:
            yield by_keys(some)

    kinds = "".join(f"{key} long, " for key in keys)
    return rows.select(*(F.col(key).cast("long") for key in keys), *names).mapInArrow(pack, f"{kinds}packed binary")


def unpacked(found: pd.Series) -> pa.Table:
    """The words of a block that ``packed`` has put together, by place; a block may have none."""
    none = pa.table({"place": pa.array([], pa.int64())} | {name: pa.array([], pa.string()) for name in ("numbers", "text")})
    return pa.concat_tables([none, *map(_rows, found)]).sort_by("place").combine_chunks()


def returned_words(used: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """``block, packed``: the ``place, numbers, text`` of the words of the blocks, by a join with the table of words.

    Both sides are dealt out by word in buckets, and travel packed. A word comes once per
    block, so no word is hot beyond the number of blocks.
    """
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).alias("bucket")
    asked = packed(used.select(bucket, "block", "place", "word"), "bucket", "block")
    told = packed(table.select(bucket, "word", "numbers", "text"), "bucket")

    def join(asked: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        known = pa.concat_tables(map(_rows, told["packed"])).combine_chunks()
        parts = [_rows(one) for one in asked["packed"]]
        ends = np.cumsum([len(part) for part in parts]).tolist()
        own = pa.concat_tables(parts).combine_chunks()
        del parts
        at = pc.index_in(own["word"], value_set=known["word"].combine_chunks())
        both = known.select(["numbers", "text"]).take(at).add_column(0, "place", own["place"])
        del known, own, at
        data = [_packet(both.slice(a, b - a)) for a, b in zip([0, *ends], ends)]
        return pd.DataFrame({"block": asked["block"], "packed": data})

    return asked.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(join, "block long, packed binary")


def check_decoder(tokenizer: str) -> None:
    """Decoding joins pieces with spaces, which is right for files without a decoder only."""
    with open(tokenizer, encoding="utf-8") as file:
        if json.load(file).get("decoder") is not None:
            raise ValueError("the tokenizer has a decoder of its own")


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return _by_block(docs, tokenizer, _digests, ENCODED)


def token_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: ``doc_id, ids, n_tokens, ids_sha256, decoded_sha256``."""
    return _by_block(docs, tokenizer, _tokens, f"ids array<int>, {ENCODED}")


def decoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: ``doc_id, ids`` and ``decoded``, the text that the ids stand for."""
    return _by_block(docs, tokenizer, _texts, "ids array<int>, decoded string")


def _joined(parts: list[str]):
    """Texts of the words at some places, with spaces between; empty ones leave none."""
    return lambda at: " ".join([parts[i] for i in at.tolist() if parts[i]])


def _digests(numbers: list[str], texts: list[str]):
    coded, decoded = _joined(numbers), _joined(texts)
    sizes = np.array([one.count(" ") + 1 if one else 0 for one in numbers], np.int64)

    def of(at: np.ndarray) -> dict:
        return dict(
            n_tokens=int(sizes[at].sum()),
            ids_sha256=hashlib.sha256(coded(at).encode()).hexdigest(),
            decoded_sha256=hashlib.sha256(decoded(at).encode()).hexdigest(),
        )

    return of


def _ids(numbers: list[str]):
    coded = [np.array(one.split(), np.int32) for one in numbers]
    none = np.zeros(0, np.int32)
    return lambda at: np.concatenate([none, *[coded[i] for i in at.tolist()]])


def _tokens(numbers: list[str], texts: list[str]):
    digests, ids = _digests(numbers, texts), _ids(numbers)
    return lambda at: {"ids": ids(at)} | digests(at)


def _texts(numbers: list[str], texts: list[str]):
    ids, decoded = _ids(numbers), _joined(texts)
    return lambda at: {"ids": ids(at), "decoded": decoded(at)}


def _by_block(docs: DataFrame, tokenizer: str, describe, kinds: str) -> DataFrame:
    check_decoder(tokenizer)
    spark = docs.sparkSession
    blocks = spark.table(word_blocks(docs, tokenizer))
    used = blocks.select("block", F.posexplode("words").alias("place", "word"))
    coded = encoded_words(used.select("word").distinct(), tokenizer)
    table = saved(decoded_words(coded, vocabulary(spark, tokenizer)), "words")
    # What is shuffled in a step goes before the next one shuffles.
    del coded
    settle(spark)
    words = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    back = saved(returned_words(used, table, 1 + words // BUCKET_WORDS), "back")
    dropped(table)
    del used, table
    settle(spark)
    schema = f"doc_id long, {kinds}"

    def assemble(found: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        told = unpacked(found["packed"])
        of = describe(*(listed(told[name].combine_chunks()) for name in ("numbers", "text")))
        rows, names = [], []
        for doc_ids, lengths, data in zip(own["doc_ids"], own["lengths"], own["places"]):
            places = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
            ends = np.cumsum(lengths)
            names.extend(None if name is None else int(name) for name in doc_ids)
            rows.extend(of(places[end - n : end]) for n, end in zip(lengths, ends))
        frame = pd.DataFrame(rows)
        frame.insert(0, "doc_id", pd.array(names, "Int64"))
        return frame

    own = blocks.select(F.col("block").alias("home"), "doc_ids", "lengths", "places")
    return back.groupBy("block").cogroup(own.groupBy("home")).applyInPandas(assemble, schema)
