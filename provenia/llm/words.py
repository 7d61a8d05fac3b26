"""Words of many texts at once, as arrays: hashes, positions, and hashes of runs of words.

A word is a run of bytes other than ASCII white space, A-Z as a-z. A whole batch of texts is
hashed by a few passes over its words, eight bytes of each at a time; nothing is done word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: What stays of eight bytes for a word of 0 to 8.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words above this length are hashed one by one.
LONG = 128
#: Bytes of the texts that are hashed at one go, about; a text is never cut.
SLAB = 1 << 18


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """Words of texts laid end to end: ``hashes``, the first byte of each in its own text, the texts' bounds among them, and the texts themselves."""

    hashes: np.ndarray
    places: np.ndarray
    bounds: np.ndarray
    flat: bytes = b""
    offsets: np.ndarray | None = None

    def code_points(self, at: np.ndarray) -> np.ndarray:
        """The code points before some of the words (by index) in their own texts."""
        before = np.cumsum((np.frombuffer(self.flat, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
        start = self.offsets[np.searchsorted(self.bounds, at, "right") - 1]
        return before[start + self.places[at]] - before[start]

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run of ``k`` words from each word on, and whether it lies in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        owner = self.owner
        return run_hashes(self.hashes, k), owner[:n] == owner[k - 1 :]


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words. Long runs are made of two overlapping runs of half the length."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 8:
        half = 1 << ((k - 1).bit_length() - 1)
        own = run_hashes(words, half)
        return mixed(own[:n] * _BASE + own[k - half :][:n])
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mixed((h ^ words[i : i + n]) * _BASE)
    return h


def _hashed(flat: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words of ``flat``, which has eight more bytes at its end."""
    eights = np.ndarray(max(0, len(flat) - 7), np.uint64, flat, strides=(1,))
    h = mixed((eights[starts] & _HEAD[np.minimum(lengths, 8)]) * _BASE + lengths.astype(np.uint64))
    rest = np.flatnonzero((lengths > 8) & (lengths <= LONG))
    done = 8
    while len(rest):
        left = lengths[rest] - done
        h[rest] = mixed((h[rest] ^ (eights[starts[rest] + done] & _HEAD[np.minimum(left, 8)])) * _BASE)
        rest, done = rest[left > 8], done + 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(flat[starts[i] : starts[i] + lengths[i]])
    return h


def words_of(raws: list[bytes | None]) -> Words:
    """The words of some texts, None counting as empty."""
    flat = b"\n".join([b"", *[r or b"" for r in raws], b" " * 8]).lower()
    space = _SPACE[np.frombuffer(flat, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edges[::2]
    offsets = 1 + np.r_[0, np.cumsum([len(r or b"") + 1 for r in raws], dtype=np.int64)]
    bounds = np.searchsorted(starts, offsets)
    return Words(_hashed(flat, starts, edges[1::2] - starts), starts - np.repeat(offsets[:-1], np.diff(bounds)), bounds, flat, offsets)


def batches_of(raws: list[bytes | None], most: int = SLAB) -> Iterator[tuple[int, Words]]:
    """The words of consecutive texts, so many at a time that they have about ``most`` bytes; with the index of the first text."""
    at = size = 0
    for i, raw in enumerate(raws):
        if size and size + len(raw or b"") > most:
            yield at, words_of(raws[at:i])
            at, size = i, 0
        size += len(raw or b"") + 1
    if at < len(raws):
        yield at, words_of(raws[at:])
