"""Sequence packing as a cutting-stock problem solved by column generation."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywake.llm.store import Scratch, released, worker_cache
from paywake.llm.words import slices
from paywake.llm.wordtable import WordTable

CAPACITY = 2048     # tokens of a sequence
EXACT = 128         # tokens of a piece up to which each length is a class of its own
UNIT = 8            # tokens between the classes beyond
END = 1             # id after each document
SETS, WAYS = 1 << 18, 4     # of the parts that a Python worker remembers: 48 MB
LONGEST = 7         # ids of such a part
STEP = 2000         # parts that are coded together
BATCH = 1 << 20     # bytes of text that are coded together

_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xc4\xb0")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _character_classes() -> np.ndarray:
    """Class of each character below U+0300. _WHOLE: a chunk that has it is left to the tokenizer as it is."""
    classes = np.full(0x300, _OTHER, np.uint8)
    for code in range(0x300):
        kind = unicodedata.category(chr(code))
        if chr(code) in " \t\n\r\x0b\x0c":
            classes[code] = _SPACE
        elif chr(code).isspace() and code > 0x7F or chr(code) in "'\u0130":    # a mark comes out of the latter's lower case
            classes[code] = _WHOLE
        elif kind[0] in "LN":
            classes[code] = _LETTER if kind[0] == "L" else _DIGIT
    return classes


_CLASSES = _character_classes()


class PartTable(WordTable):
    """The parts of texts that the vocabulary codes apart: runs of letters, single digits, runs of other characters.

    Letters and digits are those of all characters below U+0300, which nothing composes with each other. A chunk
    between ASCII white space that has any other character, an apostrophe or `<|` is one part.
    """

    def words_in(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASSES[raw]        # of ASCII; other lead bytes next, and what follows them is as they are
        lead = np.flatnonzero(raw >= 0xC0)
        code = (raw[lead].astype(np.int32) & 0x1F) << 6 | (raw[np.minimum(lead + 1, len(raw) - 1)] & 0x3F)
        known = raw[lead] < 0xCC
        kind[lead] = np.where(known, _CLASSES[np.where(known, code, 0)], _WHOLE)
        follows = np.flatnonzero((raw & 0xC0) == 0x80)
        kind[follows] = kind[np.maximum(follows - 1, 0)]    # right for two bytes; longer characters are _WHOLE anyway
        kind[follows[(raw[np.maximum(follows - 1, 0)] & 0xC0) == 0x80]] = _WHOLE
        kind[:-1][(raw[:-1] == 0x3C) & (raw[1:] == 0x7C)] = _WHOLE
        inside = kind != _SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        chunk = np.cumsum(first) - 1
        whole = np.bincount(chunk[kind == _WHOLE], minlength=int(first.sum())) > 0
        apart = inside[1:] & ((kind[1:] != kind[:-1]) | ((kind[1:] == _DIGIT) & ((raw[1:] & 0xC0) != 0x80)))
        first[1:] |= apart & ~whole[np.maximum(chunk[1:], 0)] if len(whole) else apart
        return inside, first


class TokenIds:
    """Token ids of the parts of a PartTable.

    New parts that are runs of one class are coded many to a text, as each ends with a token that ends a word. Parts
    of at most LONGEST ids are remembered by a 128-bit hash, seeded anew in each worker, in a table of SETS sets of
    WAYS entries, where a new part takes a free entry of its set or one at random.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 3, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.seed = int.from_bytes(os.urandom(8), "little")
        self.keys = np.zeros((SETS * WAYS, 2), np.uint64)
        self.ids = np.zeros((SETS * WAYS, LONGEST), np.uint32)
        self.size = np.zeros(SETS * WAYS, np.uint8)

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of runs of one class."""
        ids = self._coded([b" ".join(parts).decode()])[0]
        bounds = np.flatnonzero(self.ends[ids]) + 1
        if len(bounds) == len(parts) and bounds[-1] == len(ids):
            return ids, np.diff(bounds, prepend=0)
        return self._apart(parts)

    def _apart(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._coded([part.decode() for part in parts])
        return np.concatenate(found), np.array([len(ids) for ids in found])

    def _learned(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _together, for parts of any kind."""
        odd = np.array([b"'" in p or b"<|" in p or max(p) >= 0xCC or bool(_ODD.search(p)) for p in parts], bool)
        ids, sizes = [np.empty(0, np.uint32)], np.zeros(len(parts), np.int64)
        order = np.argsort(odd, kind="stable")
        plain = len(parts) - int(odd.sum())
        for at in [*range(0, plain, STEP), *range(plain, len(parts), STEP)]:
            some = order[at:min(at + STEP, plain) if at < plain else at + STEP]
            coded, sizes[some] = (self._together if at < plain else self._apart)([parts[k] for k in some])
            ids.append(coded)
        return _regrouped(np.concatenate(ids), sizes[order], np.argsort(order)), sizes

    def __call__(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each)."""
        seed = self.seed
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(part, seed) for part in parts]), np.uint64).reshape(-1, 2)
        slots = ((names[:, 0] % np.uint64(SETS)).astype(np.int64) * WAYS)[:, None] + np.arange(WAYS)
        same = (self.keys[slots] == names[:, None, :]).all(axis=2) & (self.size[slots] > 0)
        known = same.any(axis=1)
        slot = slots[np.arange(len(parts)), same.argmax(axis=1)]
        sizes = self.size[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        coded, sizes[new] = self._learned([parts[k] for k in new]) if len(new) else (np.empty(0, np.uint32), 0)
        held = sizes[known]
        old = self.ids[np.repeat(slot[known], held), np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held)]
        order = np.concatenate([np.flatnonzero(known), new])
        ids = _regrouped(np.concatenate([old, coded]), sizes[order], np.argsort(order))
        self._remember(names[new], slots[new], coded, sizes[new])
        return ids, sizes

    def _remember(self, names: np.ndarray, slots: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = np.cumsum(sizes) - sizes
        free = self.size[slots] == 0
        way = np.where(free.any(axis=1), free.argmax(axis=1), (names[:, 1] % np.uint64(WAYS)).astype(np.int64))
        slot, at = np.unique(slots[np.arange(len(slots)), way], return_index=True)
        fits = (sizes[at] <= LONGEST) & (sizes[at] > 0)
        slot, at = slot[fits], at[fits]
        place = np.minimum(first[at][:, None] + np.arange(LONGEST), max(len(ids) - 1, 0))
        if len(at):
            self.keys[slot], self.ids[slot], self.size[slot] = names[at], ids[place], sizes[at]


def _regrouped(values: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The groups of consecutive values, of the given sizes, in another order."""
    first = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    return values[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def pieces(docs: DataFrame, tokenizer_path: str, keep_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of (doc_id, text), cut every CAPACITY tokens.

    Each distinct part of a batch is coded once; the ids of the texts are gathered from those by index.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_cache(f"packing {tokenizer_path}", lambda: TokenIds(tokenizer_path))
        for batch in slices(batches, "text", BATCH):
            table = PartTable(batch.column(1), _LOWER)
            flat, sizes = coder(table.words.to_pylist())
            first = np.cumsum(sizes) - sizes
            n = sizes[table.code]
            tokens = np.bincount(table.row, n, batch.num_rows).astype(np.int64) + 1
            ends = np.cumsum(tokens)
            ids = np.full(int(ends[-1]) if len(ends) else 0, END, "<u4")
            inside = np.ones(len(ids), bool)
            inside[ends - 1] = False
            ids[inside] = flat[np.repeat(first[table.code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            cuts = -(-tokens // CAPACITY)      # pieces of each document
            doc = np.repeat(np.arange(len(tokens)), cuts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * CAPACITY
            length = np.minimum(tokens[doc] - start, CAPACITY)
            raw = memoryview(ids.tobytes())
            bounds = np.concatenate([[0], np.cumsum(length) * 4])
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = [batch.column(0).take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, tokens[doc]))]
            if keep_ids:
                columns.append(pa.Array.from_buffers(pa.binary(), len(doc), [
                    None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)]))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.mapInArrow(lambda batches: released(rows(batches)), schema + ", ids binary" * keep_ids)


def priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: (worth of the best pattern, patterns as rows).

    Any number of each item may be taken, in steps of 1, 2, 4, … copies. The rows are the best pattern and, for each
    item, the best one that has it.
    """
    worth, steps = np.zeros(capacity + 1), []
    for k, (value, size) in enumerate(zip(values.tolist(), sizes.tolist())):
        copies = 1
        while size * copies <= capacity:
            weight = size * copies
            taken = worth[:-weight] + value * copies
            better = taken > worth[weight:] + 1e-12
            np.copyto(worth[weight:], taken, where=better)
            steps.append((k, copies, weight, better))
            copies *= 2
    rooms = np.concatenate([[capacity], capacity - sizes])
    rows = np.concatenate([np.zeros((1, len(sizes)), np.int64), np.eye(len(sizes), dtype=np.int64)])
    for k, copies, weight, better in reversed(steps):
        taken = (rooms >= weight) & better[np.maximum(rooms - weight, 0)]
        rows[taken, k] += copies
        rooms = rooms - weight * taken
    return float(worth[capacity]), rows


def solved(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 300) -> list[tuple[float, np.ndarray]]:
    """(copies, pattern) of the linear program: fewest sequences whose places hold the demand.

    A piece may take the place of a longer one, which keeps prices from jumping: they rise with the size (exchange
    columns of no cost). Patterns are priced by the knapsack, as many at a time as there are sizes, at prices between
    those of the basis and those of the best lower bound so far, until the gap is below a thousandth, or one sequence.
    """
    m = len(sizes)
    whole = capacity // sizes
    exchange = -np.eye(m, dtype=np.int64)       # a place of size k given up for one of the next smaller size
    exchange[np.arange(1, m), np.arange(m - 1)] = 1
    columns, costs = np.concatenate([exchange, np.diag(whole)]), np.repeat([0.0, 1.0], m)
    basis = np.arange(m, 2 * m)     # rows of columns
    inverse, copies = np.diag(1.0 / whole), demand / whole
    center, reached, trust = sizes / capacity, 0.0, 0.9
    for turn in range(rounds):
        before = copies @ costs[basis]
        prices = trust * center + (1 - trust) * np.maximum(costs[basis] @ inverse, 0)
        worth, pool = priced(prices, sizes, capacity)
        if prices @ demand / worth > reached:   # no pattern is worth more than 1 at prices / worth
            center, reached = prices / worth, prices @ demand / worth
        kept = np.concatenate([np.arange(m), np.unique(basis[basis >= m])])     # exchanges, and what the basis uses
        basis = np.searchsorted(kept, basis)
        columns, costs = np.concatenate([columns[kept], pool]), np.concatenate([costs[kept], np.ones(len(pool))])
        wide = columns.astype(float)
        for pivot in range(4 * m):
            gains = wide @ (costs[basis] @ inverse) - costs
            best = int(gains.argmax())
            if gains[best] <= 1e-7:
                break
            column = inverse @ wide[best]
            ratio = np.where(column > 1e-9, copies / np.where(column > 1e-9, column, 1), np.inf)
            out = int(ratio.argmin())
            basis[out] = best
            inverse[out] /= column[out]
            copies[out] /= column[out]
            rest = column.copy()
            rest[out] = 0
            inverse -= np.outer(rest, inverse[out])
            copies = np.maximum(copies - rest * copies[out], 0)
        inverse = 2 * inverse - inverse @ wide[basis].T @ inverse   # a Newton step takes the rounding errors out
        copies = np.maximum(inverse @ demand, 0)
        used = copies @ costs[basis]
        if used - max(reached, sizes @ demand / capacity) <= max(1.0, used / 1000):     # both are lower bounds
            break
        trust = 0.9 if used < before - 1e-9 * before else trust / 2
    return [(n, columns[k]) for n, k in zip(copies.tolist(), basis.tolist()) if costs[k]]


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(copies, pieces of each size): patterns that hold exactly the demand in about as few sequences as possible.

    The linear program's patterns are rounded down. Their places take the longest pieces left that fit; pieces left
    over, about one pattern per size, are packed first-fit decreasing.
    """
    if not len(sizes):
        return []
    order = np.argsort(sizes)
    sizes, left = sizes[order], demand[order].astype(np.int64)
    found: list[tuple[int, np.ndarray]] = []
    for copies, pattern in sorted(solved(sizes, left.astype(float), capacity), key=lambda p: -p[0]):
        n = int(copies + 1e-6)
        while n:    # copies that take the same pieces; each turn but the last uses up a size
            taken = np.zeros(len(sizes), np.int64)
            for k in np.flatnonzero(pattern)[::-1]:
                j, places = int(k), int(pattern[k])
                while places and j >= 0:
                    some = min(places, int(left[j] - taken[j]))
                    taken[j] += some
                    places -= some
                    j -= 1
            own = taken > 0
            if not own.any():
                break
            same = min(n, int((left[own] // taken[own]).min()))
            left -= same * taken
            found.append((same, taken))
            n -= same
    bins: list[list] = []       # room and pieces of each size
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            at = next((b for b in bins if b[0] >= sizes[k]), None)
            if at is None:
                bins.append(at := [capacity, np.zeros(len(sizes), np.int64)])
            at[0] -= sizes[k]
            at[1][k] += 1
    back = np.argsort(order)
    return [(n, p[back]) for n, p in [*found, *((1, b[1]) for b in bins)]]


def ranked(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """df with `rank` from 0 in each group. Groups of any size: sqrt(rows) parts are numbered apart, then shifted."""
    parts = max(1, int(np.ceil(np.sqrt(df.count()))))
    df = df.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = df.groupBy(group, "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"))
    numbered = df.withColumn("rank", F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1)
    return numbered.join(shifts, [group, "part"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")


def size_class(length: Column) -> Column:
    """Tokens that the linear program counts for a piece: its length, beyond EXACT rounded up to UNIT tokens."""
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / UNIT) * UNIT)


def pack(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack documents into sequences of at most CAPACITY tokens; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids (binary,
    little-endian unsigned 32-bit). Every document ends with END, so a null or empty text is one token. Longer
    documents are cut every CAPACITY tokens; remainders count as size_class for the linear program only. Only its
    histogram, some hundred numbers, reaches the driver. Pieces are ranked in their class, and patterns take ranks in
    turn, so the assignment is the same for any order of rows. Repeated rows are packed as often as given, a null
    doc_id stays null, no rows give no rows, other columns are ignored.

    Rows are placed without their ids, which meet their places in one join at the end.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    plain = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stored = scratch.keep(pieces(plain, tokenizer_path, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    cut = stored.drop("ids").withColumn("size", size_class(F.col("length")))
    histogram = cut.groupBy("size").agg(F.count("*").alias("n")).toPandas()     # one row per class at most
    sizes, demand = histogram["size"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64)
    taken, sequence, shares = np.zeros(len(sizes), np.int64), 0, []
    for copies, pattern in patterns(sizes, demand, CAPACITY):
        for k in np.flatnonzero(pattern):
            shares.append((int(sizes[k]), int(taken[k]), int(pattern[k]), int(taken[k] + copies * pattern[k]), sequence))
            taken[k] += copies * pattern[k]
        sequence += copies
    # bounded: a basis pattern for each class at most and fewer left-over sequences, each with few of the classes
    shares = spark.createDataFrame(shares, "size bigint, lowest bigint, each bigint, upto bigint, sequence bigint")
    rows = ranked(cut, "size", ["doc_id", "start", "ids_crc32"], scratch)
    placed = rows.join(F.broadcast(shares), "size").where("rank >= lowest and rank < upto").withColumn(
        "sequence_id", F.expr("sequence + (rank - lowest) div each"))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    places = placed.select(
        "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))
    return (places.join(stored.select("row", "ids"), "row") if keep_ids else places).drop("row")
