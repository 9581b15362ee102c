"""Texts as flat numpy arrays, and Arrow plumbing shared by the operators.

A batch of texts becomes one byte array with document offsets; words, hashes
and counts are then whole-array operations. Nothing here knows Spark's plans:
operators call these helpers inside ``mapInArrow`` tasks.

Null texts count as empty. Batches are cut by bytes, so memory stays bounded
by ``SLICE_BYTES`` or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
# bytes that end a word: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
BASE = int(_rng.integers(1 << 40, 1 << 62)) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
STEP = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) << U64(1)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        _powers[base] = have = np.multiply.accumulate(table)
    return have[:n]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its ``len + 1`` offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batches, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds at most ``limit`` text bytes or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at document borders."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (polynomial over random byte values, mixed)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * power_table(BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * power_table(BASE_INVERSE, len(data))[starts]
               + (ends - starts).astype(np.uint64))


class Words:
    """Words of a batch of texts: byte spans, hashes and each document's range."""

    def __init__(self, column, lower: bool = True):
        self.data, self.offs = flat(column)
        low = LOWER[self.data] if lower else self.data
        self.starts, self.ends = spans(~SPACE[low], self.offs)
        self.hashes = span_hashes(low, self.starts, self.ends)
        self.range = np.searchsorted(self.starts, self.offs)  # document d: range[d]..range[d+1]
        self.counts = np.diff(self.range)


def shingles(hashes: np.ndarray, rng: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words for each document, and their ranges.

    A document with fewer words, but at least one, gives one hash of them all;
    a document without words gives none.
    """
    counts = np.diff(rng)
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(out)]).astype(np.int64)
    if ends[-1] == 0:
        return np.zeros(0, np.uint64), ends
    doc = np.repeat(np.arange(len(counts)), out)
    at = rng[:-1][doc] + np.arange(ends[-1]) - ends[:-1][doc]
    last = rng[1:][doc]
    total = np.zeros(ends[-1], np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for k in range(size):
        total += np.where(at + k < last, padded[at + k], U64(0x9E3779B97F4A7C15)) * STEP[k]
    return mix(total), ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def per_document(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many true values each document's range holds."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def distinct_per_document(values: np.ndarray, rng: np.ndarray) -> list[np.ndarray]:
    return [np.unique(values[a:b]) for a, b in zip(rng[:-1], rng[1:])]
