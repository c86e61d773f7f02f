"""Hashed words and word shingles of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly; different numbers stay different."""
    for shift, factor in _STEPS:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


# Random numbers for each byte at each place of a word; longer words are hashed one by one.
_PLACES = 64
_RANDOM = np.random.default_rng(20240607).integers(0, 1 << 64, _PLACES << 8, np.uint64)
_LETTER = np.ones(256, bool)
_LETTER[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """64-bit hashes of words, in their order.

    The numbers of a word's bytes are summed for all words of a text at once, so a worker
    keeps no list of the words it has seen.
    """

    def hashed(self, words: list[bytes]) -> np.ndarray:
        return self.of(b" ".join(words))

    def of(self, data: bytes) -> np.ndarray:
        """Of the words between white space."""
        raw = np.frombuffer(data, np.uint8)
        inside = _LETTER[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        first = np.cumsum(sizes) - sizes
        at = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
        hashes = np.add.reduceat(_RANDOM[(np.minimum(at, _PLACES - 1) << 8) + raw[inside]], first)
        for i in np.flatnonzero(sizes > _PLACES).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
        return mixed(hashes)


WORDS = Words()


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """Hashes of the words of ``split_words``."""
    return WORDS.of(_bytes(text, lower))


def _bytes(text: str | None, lower: bool) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.lower() if lower else data


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space, in UTF-8; ``lower`` changes A-Z only."""
    return _bytes(text, lower).split()


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(size):
        h = h * _FACTOR + hashes[i : i + count]
    return mixed(h)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, their one sequence."""
    hashes = word_hashes(text, lower=True)
    return np.unique(windows(hashes, min(size, len(hashes)) or 1))
