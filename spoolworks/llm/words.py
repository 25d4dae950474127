"""Words and word shingles, as 64-bit hashes in NumPy arrays.

A word is a maximal run of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased: what bytes.lower()
and bytes.split() do. In UTF-8 no byte of a longer character is white space or a letter of ASCII, so working on
bytes equals working on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of `rows` rows and `size` bytes at most (a row alone may be larger), so that only so much
    text is Python objects at a time."""
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            count = min(rows, batch.num_rows - first)
            while count > 1 and batch.slice(first, count).nbytes > size:
                count //= 2
            yield batch.slice(first, count)
            first += count


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads every bit over all others."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingle_hashes(found: list[bytes], width: int = WIDTH) -> np.ndarray:
    """The hash of each run of `width` words in their order, repeats included, as int64.

    Fewer words make one shingle of the whole sequence; no words make none.
    """
    if not found:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    span = min(width, len(hashes))
    total = hashes[: len(hashes) - span + 1].copy()
    for i in range(1, span):
        total = total * FACTOR + hashes[i : len(hashes) - span + 1 + i]
    return mixed(total + np.uint64(span)).view(np.int64)


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending, as int64."""
    return np.unique(shingle_hashes(words(text), width))
