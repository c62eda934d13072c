"""Words and word shingles of Arrow string arrays as 64-bit numbers, without a Python loop per word.

Words are runs of bytes other than space and 0x09-0x0D in the UTF-8 text after
lower-casing A-Z, so multi-byte characters stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  #: bytes hashed at a time, to bound memory
SHORT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x2545F4914F6CDD1D)


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit numbers that follow from the seed alone."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * SHORT + np.uint64(seed * 0x632BE59B % (1 << 64)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE = splitmix(256, 1)[LOWER]  #: a random number per byte, the same for A and a
PLACE = splitmix(64, 2) | np.uint64(1)  #: a factor per place in a shingle


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(int(BASE)), run(pow(int(BASE), -1, 1 << 64))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts in them; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and for each text where its words start among them."""
    hashes, starts, at, n = [], [], 0, len(data)
    heads = offsets[:-1]
    while at < n:
        end = min(at + PIECE, n)
        if end < n:
            gaps = np.flatnonzero(SPACE[data[at:end]])
            while not len(gaps) and end < n:  # a word longer than a piece
                more = min(end + PIECE, n)
                gaps = np.flatnonzero(SPACE[data[end:more]]) + (end - at)
                end = more
            end = at + int(gaps[-1]) + 1 if len(gaps) else n
        part = data[at:end]
        inside = ~SPACE[part]
        breaks = np.zeros(len(part) + 1, bool)
        breaks[0] = breaks[-1] = True
        cut = heads[np.searchsorted(heads, at) : np.searchsorted(heads, end)] - at
        breaks[cut] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | breaks[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | breaks[1:-1]
        head, tail = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = 1 << max(12, int(len(part)).bit_length())
        up, down = _powers(size)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE[part] * up[: len(part)], out=total[1:])
        hashes.append(mixed((total[tail] - total[head]) * down[head] + (tail - head).astype(np.uint64) * SHORT))
        starts.append(head + at)
        at = end
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(where, offsets)


def _length_mark(n: int) -> np.uint64:
    """Keeps sequences of different lengths apart."""
    return np.uint64(n * int(SHORT) % (1 << 64))


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingles; the whole sequence as one if it has fewer words; empty without words."""
    for low in range(0, len(column), 256):
        words, at = word_hashes(*string_bytes(column.slice(low, 256)))
        whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            whole += words[j : j + len(whole)] * PLACE[j]
        whole = mixed(whole + _length_mark(k))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield mixed((words[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _length_mark(b - a))
            else:
                yield words[:0]
