import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import ODD, docs, prose
from hypothesis import given, settings, strategies as st

from duskline.llm import bpe, token_files, tokens
from duskline.llm.common import new_folder
from duskline.llm.elias_fano import EliasFano, TokenFile, token_file
from duskline.llm.tokens import load

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=700))
def test_elias_fano_gives_back_what_it_got(values):
    values = sorted(values)
    packed, _ = EliasFano.from_bytes(b"xy" + EliasFano.of(np.array(values, np.int64)).to_bytes(), 2)
    assert packed.values().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert packed.select(i) == values[i]


def test_elias_fano_is_near_the_least_space():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 10_000))
    size = len(EliasFano.of(values).to_bytes())
    assert size < 10_000 * (2 + np.log2((1 << 30) / 10_000) + 0.5) / 8


def test_a_token_file_finds_single_documents():
    ids = [[5, 6, 2], [2], [7, 2]]
    body = np.concatenate(ids).astype("<u2").tobytes()
    file = TokenFile.read(token_file(body, 2, [None, -3, 9], np.array([3, 4, 6])))
    assert [file.doc_id(i) for i in range(3)] == [None, -3, 9]
    assert [file.document(i).tolist() for i in range(3)] == ids


def expected_ids(text):
    return load(PATH).encode(text or "", add_special_tokens=False).ids


def test_files_hold_every_document_in_order(spark):
    found = token_files.token_offsets(spark, docs(spark, ODD), PATH).orderBy("start").collect()
    assert [row["doc_id"] for row in found] == sorted(
        (d for d, _ in ODD), key=lambda d: (d is not None, d or 0)
    )
    by_id = {}
    for doc_id, text in ODD:
        ids = np.array([*expected_ids(text), 2], "<u4")
        by_id.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    start = 0
    for row in found:
        assert row["start"] == start
        start += row["n_tokens"]
        got.setdefault(row["doc_id"], []).append((row["n_tokens"], row["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in by_id.items()}


def test_marks_after_a_word_make_no_new_words(monkeypatch):
    """A word is encoded once, whatever case it has and whatever marks end it."""
    seen = []
    whole = tokens.WordEncoder.encode
    monkeypatch.setattr(tokens.WordEncoder, "encode", lambda self, found: seen.extend(found) or whole(self, found))
    marks = ["", ".", ",***", "&&&", "$$$", ")", "'", '"', "%%%", "--", "?!"]
    text = " ".join(word + mark for word in ("Plain", "plain", "\xc9t\xe9") for mark in marks)
    coded = tokens.Encoder(PATH, "<u2").encode(pa.array([text, None, "", " \x1f plain "]))
    assert [np.frombuffer(one, "<u2").tolist() for one in coded] == [
        expected_ids(t) for t in (text, None, "", " \x1f plain ")
    ]
    assert len(seen) == len(set(seen)) <= 2 + len(marks) + 2


def test_a_block_lists_a_word_once_for_all_its_marks(spark):
    text = " ".join(f"word{mark} Word{mark}" for mark in ("", ".", "***", "&&&", ")", "'s", "--"))
    found = spark.table(bpe.word_blocks(docs(spark, [(1, text)]), PATH)).collect()
    assert sorted(found[0]["words"]) == sorted(["word", ".", "***", "&&&", ")", "word's", "--"])


def test_white_space_is_what_python_takes_for_it():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    spaces = [c for c in points if c.isspace() and c not in tokens.ODD_SPACES]
    parts, places, sizes = tokens.distinct_pieces(pa.array([f"a{c}b" for c in spaces] + ["".join(points[32:])]))
    assert sizes.tolist()[:-1] == [2] * len(spaces)
    some = parts.to_pylist()
    assert [some[i] for i in places[-sizes[-1] :] if some[i]] == "".join(points[32:]).split()


def test_small_files_give_the_same_rows(spark):
    table = docs(spark, [(i, prose(i, 30)) for i in range(40)])
    one = token_files.token_offsets(spark, table, PATH).orderBy("start").collect()
    manifest = token_files.write_token_files(table, new_folder(spark, "t"), PATH, 2, file_bytes=64)
    assert manifest.count() > 10
    assert token_files.read_token_files(manifest).orderBy("start").collect() == one


def test_no_documents_give_no_rows(spark):
    empty = docs(spark, []).where("false")
    assert token_files.token_offsets(spark, empty, PATH).count() == 0
    assert bpe.encoded_documents(empty, PATH).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_blocks_encode_and_decode_like_the_library(spark, monkeypatch):
    library = load(PATH)
    wanted = sorted(
        (str(d), len(ids := expected_ids(t)), digest(" ".join(map(str, ids))))
        + (digest(library.decode(ids, skip_special_tokens=False)),)
        for d, t in ODD
    )
    for chars in (bpe.BLOCK_CHARS, 300):
        monkeypatch.setattr(bpe.word_blocks, "__defaults__", (chars,))
        found = bpe.encoded_documents(docs(spark, ODD), PATH).collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == wanted


def test_words_travel_packed_to_their_ids_and_back(spark):
    words = [prose(i, 1) + chr(97 + i % 26) + str(i) for i in range(3000)] + ["", "\xe9\n\u65e5 x"]
    rows = [(block, place, word) for block in (3, 1 << 33) for place, word in enumerate(sorted(words))]
    used = spark.createDataFrame(rows, "block long, place int, word string")
    own = {word: (" ".join(str(ord(c) * 50) for c in word), " ".join(word)) for word in words}
    table = spark.createDataFrame([(w, *own[w]) for w in words], "word string, numbers string, text string")
    found = bpe.returned_words(used, table, 3).toPandas().groupby("block")["packed"].apply(list)
    for block, packets in found.items():
        wanted = [(place, *own[word]) for at, place, word in rows if at == block]
        assert [tuple(r.values()) for r in bpe.unpacked(packets).to_pylist()] == wanted
    assert set(found.index) == {3, 1 << 33} and bpe.unpacked([]).num_rows == 0
    sent = [len(r["packed"]) for r in bpe.packed(used.coalesce(1), "block").collect()]
    plain = pa.BufferOutputStream()
    with pa.ipc.new_stream(plain, used.toArrow().schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(used.toArrow())
    # In Arrow's own form, offsets and places took more than the words.
    assert len(sent) == 2 and sum(sent) < 0.7 * plain.getvalue().size


def test_added_tokens_are_found_as_the_text_writes_them(spark):
    library = load(PATH)
    texts = ["A <|ENDOFTEXT|> B", "x<|EndOfText|>.", "<|endoftext|>! Yes<|STARTOFTEXT|>no.", "<|EndOfText|>"]
    found = bpe.decoded_documents(docs(spark, list(enumerate(texts))), PATH).orderBy("doc_id").collect()
    assert [r["ids"] for r in found] == [expected_ids(text) for text in texts]
    assert [r["decoded"] for r in found] == [
        library.decode(expected_ids(text), skip_special_tokens=False) for text in texts
    ]


def test_decoded_documents_are_texts(spark):
    library = load(PATH)
    rows = bpe.decoded_documents(docs(spark, ODD), PATH).where("doc_id = 9").collect()
    ids = expected_ids(ODD[11][1])
    assert rows[0]["ids"] == ids
    assert rows[0]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_a_tokenizer_with_a_decoder_is_refused(spark):
    with pytest.raises(ValueError, match="decoder"):
        bpe.check_decoder(public_tokenizers.path("byte_bpe_50k.json"))
