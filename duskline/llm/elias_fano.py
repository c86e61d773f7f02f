"""Elias-Fano lists of rising numbers, and token files whose document bounds are such lists."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<qqBI")  # count, first value, width of the low part, bytes of the high part
_FILE = struct.Struct("<5sBqqq")  # magic, bytes of an id, documents, documents without id, ids
MAGIC = b"DLTK1"
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


@dataclass(frozen=True)
class EliasFano:
    """Rising integers in about 2 + log2(range / count) bits each.

    The low bits lie packed side by side. The high parts are a bit string with
    a one for each value; the position of every ``SAMPLE``-th one is kept in 32
    bits, from where ``select`` counts on.
    """

    count: int
    first: int
    width: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: int64, not falling; may be empty or negative."""
        values = np.asarray(values, dtype=np.int64)
        count = len(values)
        if not count:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, 0, empty, empty, np.zeros(0, "<u4"))
        first = int(values[0])
        # Wraps to the true distance even over the whole range of 64 bits.
        rest = values.view(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
        width = max(0, (int(rest[-1]) // count).bit_length() - 1)
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())
        at = (rest >> np.uint64(width)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(count, first, width, low, np.packbits(bits), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.count, self.first, self.width, len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The list that begins at byte ``at``, and where it ends."""
        count, first, width, n_high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        parts = []
        for n, kind in ((-(-count * width // 8), "u1"), (n_high, "u1"), (-(-count // SAMPLE), "<u4")):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        return cls(count, first, width, *parts), at

    def _low(self, i: int) -> int:
        begin = i * self.width
        part = self.low[begin // 8 : (begin + self.width + 7) // 8]
        bits = np.unpackbits(part)[begin % 8 : begin % 8 + self.width]
        return int(sum(int(bit) << k for k, bit in enumerate(bits)))

    def select(self, i: int) -> int:
        """Value ``i``, from one sample and at most ``SAMPLE`` ones after it."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = start // 8
        # Ones before the sample in its own byte count too.
        left += int(np.unpackbits(self.high[byte : byte + 1])[: start % 8].sum())
        while left >= (ones := int(_ONES[self.high[byte]])):
            left -= ones
            byte += 1
        at = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1]))[left])
        return self.first + ((at - i) << self.width | self._low(i))

    def values(self) -> np.ndarray:
        """All values, int64."""
        if not self.count:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.unpackbits(self.high))[: self.count]
        rest = (at - np.arange(self.count)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low)[: self.count * self.width].reshape(self.count, -1)
            rest |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(
                axis=1, dtype=np.uint64
            )
        return (rest + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def token_file(ids: bytes, id_bytes: int, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """A file of documents. ``ids``: all their ids; ``ends``: number of ids up to each one's end.

    Documents without an id come first.
    """
    nameless = sum(doc_id is None for doc_id in doc_ids)
    head = _FILE.pack(MAGIC, id_bytes, len(doc_ids), nameless, len(ids) // id_bytes)
    named = np.array(doc_ids[nameless:], dtype=np.int64)
    return head + EliasFano.of(named).to_bytes() + EliasFano.of(ends).to_bytes() + ids


@dataclass(frozen=True)
class TokenFile:
    """A read token file; ``document(i)`` finds one document without going through the others."""

    nameless: int
    doc_ids: EliasFano
    ends: EliasFano
    ids: np.ndarray

    @classmethod
    def read(cls, data: bytes) -> TokenFile:
        magic, id_bytes, _, nameless, n_ids = _FILE.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        doc_ids, at = EliasFano.from_bytes(data, _FILE.size)
        ends, at = EliasFano.from_bytes(data, at)
        return cls(nameless, doc_ids, ends, np.frombuffer(data, f"<u{id_bytes}", n_ids, at))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nameless else self.doc_ids.select(i - self.nameless)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]
