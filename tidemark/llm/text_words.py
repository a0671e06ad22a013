"""Words of Arrow text columns as arrays of 64-bit hashes, for whole batches at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 1_000_000  # text taken at once: arrays take some fifty times as much
BLOCK_BYTES = 1 << 20  # text hashed at once
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    return tuple(
        np.multiply.accumulate(np.concatenate([[U(1)], np.full(BLOCK_BYTES, b, U)])) for b in (BASE, inverse)
    )


@dataclass
class Words:
    hashes: np.ndarray  # of all words, text after text
    first: np.ndarray  # index of each text's first word, and the total at the end

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of n words in one text, and the index of its first word."""
        runs, width = {1: self.hashes}, 1  # hashes of runs of 1, 2, 4, ... words
        while 2 * width <= n:
            h = runs[width]
            runs[2 * width] = mix(h[:max(len(h) - width, 0)] * U(5) + h[width:])
            width *= 2
        sums, done = np.zeros(max(len(self.hashes) - n + 1, 0), U), 0
        for width in sorted(runs, reverse=True):
            if n & width:
                sums = mix(sums * U(3) + runs[width][done:done + len(sums)])
                done += width
        last = np.repeat(self.first[1:], np.diff(self.first))
        start = np.flatnonzero(np.arange(len(sums)) + n <= last[:len(sums)])
        return sums[start], start


def _hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each byte range, in blocks of bounded size."""
    power, inverse = _powers()
    out = np.empty(len(begin), U)
    i = 0
    while i < len(begin):
        j = max(int(np.searchsorted(end, begin[i] + BLOCK_BYTES, "right")), i + 1)
        a, b = int(begin[i]), int(end[j - 1])
        if b - a > BLOCK_BYTES:  # one huge word
            total, step = U(0), a
            while step < b:
                stop = min(step + BLOCK_BYTES, b)
                part = (data[step:stop].astype(U) + U(1)) * power[:stop - step]
                total = mix(part.sum(dtype=U, keepdims=True) + total)[0]
                step = stop
            out[i] = total
        else:
            sums = np.concatenate([[U(0)], np.cumsum((data[a:b].astype(U) + U(1)) * power[:b - a], dtype=U)])
            left = begin[i:j] - a
            out[i:j] = (sums[end[i:j] - a] - sums[left]) * inverse[left]
        i = j
    return mix(out + (end - begin).astype(U))


def words_of(texts: pa.Array) -> Words:
    """Words of a column without NULLs."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(letter[1:] & (~letter[:-1] | edge))
    end = np.flatnonzero(letter[:-1] & (~letter[1:] | edge))
    return Words(_hash(data, begin, end), np.searchsorted(begin, offsets))


def runs(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``most`` together; a larger row may be taken with a few others."""
    group = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, b


def slices(batch: pa.RecordBatch, *text_cols: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes in the columns named."""
    size = np.zeros(len(batch), np.int64)
    for name in text_cols:
        size += pa.compute.binary_length(batch.column(name)).to_numpy(zero_copy_only=False)
    for a, b in runs(size, most):
        yield batch.slice(a, b - a)
