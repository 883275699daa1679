"""Words and word hashes of a batch of texts, as flat numpy arrays.

Texts stay UTF-8 bytes. A word is a run of bytes of a class; both classes used here hold
every byte of a multi-byte character or none of them, so words are the same as with a
character pattern. Temporary arrays cover at most ``CHUNK`` bytes at a time (or one word,
if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
CHUNK = 1 << 20
LONG_WORD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# [^\x20\x09-\x0D]: all but ASCII white space
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F], lower-cased: ASCII letters and digits, and all else beyond ASCII
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit moves every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of an odd number modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and where each begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """``starts``, ``ends``: byte range of each word in ``data``; ``first``: index of each
    document's first word, and one more at the end; ``hash``: of the word's bytes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, first: int, last: int) -> bytes:
        """The words ``first`` to ``last - 1``, joined by single spaces."""
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, last))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits per word. Sums of powers modulo 2**64 cannot tell some long words apart, so
    words of over ``LONG_WORD`` bytes are hashed one by one."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        n = int(ends[j - 1] - base)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[base : base + n]] * powers(BASE, n), out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * powers(INVERSE, n)[a]
        i = j
    out = mix(out + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def word_spans(column: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``data, starts, ends, first`` of ``Words``."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = letters[data]
    begins = inside[1:-1] & ~inside[:-2]
    stops = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    stops[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def words(column: pa.Array, letters: np.ndarray) -> Words:
    """Words of the class ``letters`` after lower-casing A-Z. Null texts have none."""
    data, starts, ends, first = word_spans(column, letters)
    return Words(data, starts, ends, first, word_hashes(data, starts, ends))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside a document, and the index of its first word."""
    n = len(found.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.full(n, size, np.uint64)
    for i in range(size):
        value = mix(value * np.uint64(BASE) + found.hash[i : i + n])
    doc = found.doc
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return value[at], at
