"""Words as 64-bit hashes, batch by batch, over the UTF-8 bytes of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

from paywake.llm.store import worker_cache

CACHE = 400_000     # words that a Python worker remembers
BATCH_BYTES = 4 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                dtype=np.uint64)


class WordHashes(dict):
    """Hash by word, remembered for at most CACHE words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def hashed(words: list[bytes]) -> np.ndarray:
    known = worker_cache("words", WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct `size`-word shingles of a text; of all its words where it has fewer."""
    words = hashed(text.translate(LOWER).split()) if text else np.empty(0, np.uint64)
    n = len(words)
    if not n:
        return words
    length = min(n, size)
    total = np.full(n - length + 1, length, np.uint64) * _ODD[4]
    for k in range(length):
        total += words[k:n - length + 1 + k] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
    return np.unique(mixed(total))


def binary(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist(), dtype=np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
