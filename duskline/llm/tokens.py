"""Encoding with a tokenizer file, one piece of text between white space at a time."""

from __future__ import annotations

import json
import os
import re
import string
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Control characters that Python takes for white space and the tokenizers do not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def listed(column: pa.Array) -> list[str]:
    """A column's texts; this way to a list is much the shorter one."""
    return column.to_numpy(zero_copy_only=False).tolist()


def distinct_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct parts of some texts, the place of every part among them, and how many each text has.

    A part is what a tokenizer which drops white space encodes alone; it may be empty, which
    encodes to nothing. A text with ``ODD_SPACES`` is one part: joined again by a space, its
    parts would not be the same text.
    """
    texts = texts.fill_null("")
    parts = pc.utf8_split_whitespace(texts)
    odd = pc.match_substring_regex(texts, f"[{ODD_SPACES}]")
    if pc.any(odd).as_py():
        alone = [[text] if one else None for text, one in zip(texts.to_pylist(), odd.to_pylist())]
        parts = pc.coalesce(pa.array(alone, parts.type), parts)
    coded = parts.flatten().dictionary_encode()
    return (
        coded.dictionary,
        coded.indices.to_numpy(zero_copy_only=False),
        pc.list_value_length(parts).to_numpy(zero_copy_only=False),
    )


# Marks that end a word. After a letter or digit they are a match of the pattern of their own.
_ENDS = string.punctuation
_REMEMBERED = 10_000


def added_texts(path: str) -> tuple[str, ...]:
    """Texts, in lower case, that the library looks for before it changes anything."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    return tuple(sorted({token["content"].lower() for token in said.get("added_tokens") or []}))


def plain_words(piece: str, added: tuple[str, ...] = ()) -> list[str]:
    """The words of a piece, with fewer distinct ones: in lower case and end marks apart.

    For tokenizers that change to lower case and part letters and digits from other
    characters. Lower case is taken where every library agrees on it, as in Latin letters. A
    piece that holds an added token stays, as that is looked for in the text as it stands.
    """
    low = piece.lower()
    if any(text in low for text in added):
        return [piece]
    word = low if piece.isascii() or max(piece) < "\u0130" else piece
    core = word.rstrip(_ENDS)
    if core != word and core and core[-1].isalnum():
        return [core, word[len(core) :]]
    return [word] if word else []


# The parts of a tokenizer file for which ``WordEncoder`` knows a shorter way.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next free one."""
    hidden = [byte for byte in range(256) if byte not in _PRINTED]
    return {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of pieces of text without white space.

    The library takes a text through its normaliser, its pattern and its merges. A word of
    Latin letters only is one match of the pattern, and all that changes is its case, so
    the library's merges are asked for directly. All else goes the whole way.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.tokenize = self.tokenizer.model.tokenize
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        normal = (said.get("normalizer") or {}).get("normalizers") or []
        parts = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.direct = (
            [part["type"] for part in normal] == _NORMALIZERS
            and (parts[0].get("pattern") or {}).get("Regex") == _PATTERN
            and [part["type"] for part in parts] == ["Split", "ByteLevel"]
        )
        self.letters = _byte_letters()
        self.ends: dict[str, list[int]] = {}

    def _whole(self, found: list[str]) -> list[list[int]]:
        return [one.ids for one in self.tokenizer.encode_batch(found, add_special_tokens=False)]

    def _merged(self, piece: str) -> list[int] | None:
        core = piece.rstrip(_ENDS)
        if not (core.isalpha() and (core.isascii() or max(core) < "\u0130")):
            return None
        word = core.lower()
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        ids = [token.id for token in self.tokenize(word)]
        if core == piece:
            return ids
        end = piece[len(core) :]
        if end not in self.ends:
            if len(self.ends) > _REMEMBERED:
                self.ends = {}
            self.ends[end] = self._whole([end])[0]
        return ids + self.ends[end]

    def encode(self, found: list[str]) -> list[list[int]]:
        ids = [self._merged(piece) if self.direct else None for piece in found]
        rest = [i for i, one in enumerate(ids) if one is None]
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for i, one in zip(some, self._whole([found[i] for i in some])):
                ids[i] = one
        return ids


# Latin letters, for which lower case is the same everywhere.
_LATIN = "".join(c for c in map(chr, range(0x130)) if c.isalpha())


class Encoder:
    """Bytes of the ids of texts, as numbers of a ``kind``; a distinct word is encoded once while it is remembered."""

    def __init__(self, path: str, kind: str, remembered: int = 1_000_000):
        self.words = WordEncoder(path)
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def _coded(self, column: pa.Array) -> pa.Array:
        """The ids of each piece of a column."""
        coded = column.dictionary_encode()
        pieces = listed(coded.dictionary)
        found = list(map(self.known.get, pieces))
        missing = [i for i, one in enumerate(found) if one is None]
        if len(self.known) + len(missing) > self.remembered:
            self.known = {}
        for i, ids in zip(missing, self.words.encode([pieces[i] for i in missing])):
            self.known[pieces[i]] = found[i] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return pa.array(found, pa.large_binary()).take(coded.indices)

    def encode(self, texts: pa.Array) -> list[memoryview]:
        """The ids of every text."""
        parts, places, sizes = distinct_pieces(texts)
        if self.words.direct:
            # A word of Latin letters is known in lower case, and the marks after it apart.
            latin = pc.match_substring_regex(parts, f"^[{_LATIN}]+[{re.escape(_ENDS)}]*$")
            ends = pc.if_else(latin, pc.utf8_ltrim(parts, _LATIN), "")
            cores = pc.if_else(latin, pc.utf8_lower(pc.utf8_rtrim(parts, _ENDS)), parts)
            none = pa.scalar(b"", pa.large_binary())
            coded = pc.binary_join_element_wise(self._coded(cores), self._coded(ends), none)
        else:
            coded = self._coded(parts)
        # Put one after another, the bytes of all pieces are those of the texts.
        joined = coded.take(pa.array(places))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64, len(joined) + 1)[np.r_[0, np.cumsum(sizes)]].tolist()
        view = memoryview(data or b"")
        return [view[a:b] for a, b in zip(ends, ends[1:])]


_KEPT: dict[tuple[str, str], Encoder] = {}


def byte_encoder(path: str, kind: str) -> Encoder:
    """An encoder to bytes of numbers of a ``kind``, kept by the worker from task to task."""
    if (path, kind) not in _KEPT:
        _KEPT[path, kind] = Encoder(path, kind)
    return _KEPT[path, kind]
