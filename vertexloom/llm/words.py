"""Words of many texts at once: boundaries and 64-bit hashes by array arithmetic on their UTF-8 bytes.

A word's hash is a polynomial over random values of its bytes, taken from one running sum over the batch, so that the cost
for a byte does not depend on the number or length of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    both = []
    for base in (_P, inverse):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least size of each."""
    return _powers(_SEGMENT if size <= _SEGMENT else 1 << int(size - 1).bit_length())


def byte_tables(separator: np.ndarray, lower: bool, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(is part of a word, value) of each byte."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return ~separator, values


def _space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


def _not_alphanumeric() -> np.ndarray:
    out = np.zeros(256, bool)
    out[:0x80] = True
    for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
        out[a : b + 1] = False
    return out


SPACED = _space()
ALPHANUMERIC = _not_alphanumeric()


@dataclass
class Words:
    """Words of a batch: data are its bytes, doc the first word of each text (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    text_at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), self.counts)


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text each, so that arrays made from them stay small; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, separator: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of bytes that are not separators, in each text."""
    data, at = text_bytes(texts)
    inside, values = byte_tables(separator, lower)
    word = inside[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64), at)
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:], after[-1], after[:-1] = False, word[:-1], False, word[1:]
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT - 1, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[data[a:b]] * up[: b - a], out=total[1:])
        hashes[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
        i = j
    return Words(data, starts, ends, mix(hashes), np.searchsorted(starts, at), at)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every n consecutive words of one text."""
    if len(w.hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(len(w.hashes) - n + 1, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w.hashes[k : k + len(h)]
    left = np.repeat(w.doc[1:], w.counts)[: len(h)]
    first = np.flatnonzero(np.arange(len(h)) + n <= left)
    return first, mix(h[first] + np.uint64(n))
