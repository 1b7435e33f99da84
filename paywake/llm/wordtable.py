"""The words of a batch of texts as NumPy arrays: codes into the batch's distinct words, no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


def byte_table(kept: bytes) -> np.ndarray:
    """For each byte of UTF-8: itself, A-Z lower-cased, where it belongs to words; 0 where it separates them.

    `kept` has the ASCII bytes of words; every byte of a character beyond ASCII belongs to them.
    """
    table = np.zeros(256, np.uint8)
    for b in (*kept, *range(0x80, 0x100)):
        table[b] = b
    table[0x41:0x5B] = table[0x61:0x7B]
    return table


LETTERS = byte_table(bytes(range(0x61, 0x7B)))
LETTERS_DIGITS = byte_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B)]))


class WordTable:
    """Words of a column of texts, nulls having none.

    `code` and `row` have one entry per word, in order of the texts; `words` are the distinct words by code, and
    `data`, `start` and `length` hold their bytes.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray):
        self.table = table
        texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        raw = np.empty(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        edge = np.zeros(len(raw) + 1, bool)     # places between two texts
        edge[self.offsets] = True
        lowered = table[raw]
        inside, first = self.words_in(raw, edge)
        ending = first | ~inside
        last = inside.copy()
        last[:-1] &= ending[1:]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, begin, "right") - 1
        places = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=places[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(lowered[inside])])
        coded = words.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        ends = np.frombuffer(self.words.buffers()[1], np.int64)[:len(self.words) + 1]
        data = self.words.buffers()[2]
        self.data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
        self.start, self.length = ends[:-1], np.diff(ends)

    def words_in(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes belong to words, and which begin one; `edge` marks the places where a text begins or ends."""
        inside = self.table[raw] != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        return inside, first

    def per_text(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.row, minlength=len(self.offsets) - 1)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers, in order of first appearance, and the code of each value among them."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
