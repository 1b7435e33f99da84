"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywake.llm.components import components, labels
from paywake.llm.store import Scratch, released
from paywake.llm.words import binary, mixed, shingle_set, slices

BINS = 128          # of the one permutation
ROWS = 4            # bins in a band: 32 bands find a pair of similarity 0.75 but for 5 in a million
PAIRED = 16         # buckets of at most so many documents are paired row by row, larger ones part by part
MEMBERS = 64        # documents that one task compares with a centre before the centre is sent to another task
PART = 256          # documents that a part of a larger bucket has about, and
PART_SHINGLES = 500_000     # shingles that they have together
COLUMNS = 4096      # shingles counted at a time in two parts
ROW = "_neardup_row"

_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: For every bin the order in which it asks other bins for a value while it has none.
_ASKS = np.stack([np.random.default_rng(seed).permutation(BINS) for seed in range(BINS)])
_WEIGHTS = np.random.default_rng(BINS).integers(1, 2**63, (BINS // ROWS, ROWS), dtype=np.uint64) | np.uint64(1)


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification: each empty bin takes the value of the first filled bin in its own random order."""
    out, empty = values.copy(), ~filled & filled.any(axis=1)[:, None]
    for turn in range(BINS):
        row, bin_ = np.nonzero(empty)
        if not len(row):
            break
        asked = _ASKS[bin_, turn]
        found = filled[row, asked]
        out[row[found], bin_[found]] = values[row[found], asked[found]]
        empty[row[found], bin_[found]] = False
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One key per set and band; the band stands in the lowest bits."""
    values, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for row, hashes in enumerate(sets):
        bins = (hashes >> _SHIFT).astype(np.int64)      # the hashes are sorted: the first of a bin is its least
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        values[row, bins[first]], filled[row, bins[first]] = hashes[first], True
    parts = densified(values, filled).reshape(len(sets), BINS // ROWS, ROWS)
    bands = np.arange(BINS // ROWS, dtype=np.uint64)
    return mixed((parts * _WEIGHTS).sum(axis=2, dtype=np.uint64) + bands) & ~np.uint64(BINS // ROWS - 1) | bands


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands) of each row of (doc_id, text_hash, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(text) for text in binary(batch.column(2))]
            keys = band_keys(sets).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "text_hash": batch.column(1),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([xxhash.xxh3_128_digest(s) if len(s) else None for s in sets], pa.binary()),
                "bands": pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64()))})

    return docs.mapInArrow(
        lambda batches: released(rows(batches)), "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _comparable(a: str, b: str):
    """Sets whose sizes alone allow a similarity of 0.75."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """The rows of one bucket of each member set of two or more; of equal buckets that of the first band.

    Texts that share many bands meet in many buckets of the same members, each of which would give the same pairs.
    """
    band = F.col("key").bitwiseAND(F.lit(BINS // ROWS - 1))
    met = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor("node").alias("a"), F.bit_xor(F.xxhash64("node")).alias("b"))
    first = met.where("size > 1").groupBy("size", "a", "b").agg(F.min(F.struct(band.alias("band"), "key")).alias("first"))
    return rows.join(first.select("first.key"), "key", "left_semi")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(centre, member): each set of a bucket with the one of least doc_id."""
    centres = (buckets.groupBy("key").agg(F.min(F.struct("doc_id", "node", "n")).alias("c"))
               .select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    joined = buckets.join(centres, "key").where("node <> centre").where(_comparable("n", "centre_n"))
    return joined.select("centre", F.col("node").alias("member")).distinct()


def cross_pairs(buckets: DataFrame) -> DataFrame:
    """(centre, member): pairs of small buckets whose sets are in different components so far."""
    other = buckets.select("key", F.col("node").alias("centre"), F.col("n").alias("m"), F.col("component").alias("c"))
    pairs = buckets.join(other, "key").where("centre < node and component <> c").where(_comparable("n", "m"))
    return pairs.select("centre", F.col("node").alias("member")).distinct()


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose sets are in more than one component, with component and bucket size."""
    named = buckets.join(labels, "node", "left").select(
        "key", "node", "doc_id", "n", F.coalesce("component", "node").alias("component"))
    left = named.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"))
    return named.join(left.where("a <> b").select("key", "size"), "key")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (centre, member) whose full shingle sets have 100 * intersection >= 75 * union.

    The members of a centre are dealt out in groups of MEMBERS, each with a copy of the centre's text, so that no
    task gets more because a centre is popular. A group streams by: only the centre's set is held.
    """
    groups = pairs.groupBy("centre").agg(F.count("*").alias("members"))
    dealt = pairs.join(groups, "centre").select(
        "centre", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("members") / MEMBERS)).alias("part"))
    member = dealt.join(texts.select(F.col("node").alias("member"), "text"), "member").select(
        "centre", "part", "member", "text")
    centre = dealt.select("centre", "part").distinct().join(
        texts.select(F.col("node").alias("centre"), "text"), "centre").select(
        "centre", "part", F.lit(None).cast("bigint").alias("member"), "text")
    rows = member.unionByName(centre).repartition("centre", "part").sortWithinPartitions(
        "centre", "part", F.col("member").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in slices(batches, "text"):
            found: list[tuple[int, int]] = []
            for c, m, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), binary(batch.column(3))):
                own = shingle_set(text)
                if m is None:
                    held = own
                    continue
                common = len(np.intersect1d(held, own, assume_unique=True))
                if 100 * common >= 75 * (len(held) + len(own) - common):
                    found.append((c, m))
            yield pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in found], pa.int64()),
                                              "v": pa.array([b for _, b in found], pa.int64())})

    return rows.mapInArrow(lambda batches: released(compare(batches)), "u bigint, v bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of `left` has in common with each of `right`."""
    def entries(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.concatenate(sets)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    (a, a_row), (b, b_row) = entries(left), entries(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, len(both), COLUMNS):
        columns = both[start:start + COLUMNS]
        marks = []
        for hashes, row, sets in ((a, a_row, left), (b, b_row, right)):
            some = slice(np.searchsorted(hashes, columns[0]), np.searchsorted(hashes, columns[-1], "right"))
            at = np.minimum(np.searchsorted(columns, hashes[some]), len(columns) - 1)
            shared = columns[at] == hashes[some]
            mark = np.zeros((len(sets), len(columns)), np.float32)
            mark[row[some][shared], at[shared]] = 1
            marks.append(mark)
        out += (marks[0] @ marks[1].T).astype(np.int64)     # at most COLUMNS each: exact
    return out


def joined(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Links that join the components of the similar (component, set) of both lists, none twice."""
    names = [np.array([c for c, _ in side], np.int64) for side in (left, right)]
    sizes = [np.array([len(s) for _, s in side], np.int64) for side in (left, right)]
    common = overlaps([s for _, s in left], [s for _, s in right])
    similar = 100 * common >= 75 * (sizes[0][:, None] + sizes[1][None, :] - common)
    rows, columns = np.nonzero(similar & (names[0][:, None] != names[1][None, :]))
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while c in above:
            above[c] = c = above.get(above[c], above[c])
        return c

    for a, b in zip(names[0][rows].tolist(), names[1][columns].tolist()):
        a, b = top(a), top(b)
        if a != b:
            above[max(a, b)] = min(a, b)
            yield a, b


def parts(large: DataFrame) -> DataFrame:
    """(key, part, sole, node, component): buckets dealt into parts of about PART sets and PART_SHINGLES shingles.

    A component that is larger than a part has parts of its own and is their `sole` component.
    """
    def needed(count, shingles):
        return F.ceil(F.greatest(count / PART, shingles / PART_SHINGLES))

    own = large.groupBy("key", "component").agg(needed(F.count("*"), F.sum("n")).alias("own"),
                                                F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    rest = own.where("own = 1").groupBy("key").agg(needed(F.sum("sets"), F.sum("shingles")).alias("rest"))
    sole = F.when(F.col("own") > 1, F.col("component"))
    dealt = large.join(own.select("key", "component", "own"), ["key", "component"]).join(rest, "key", "left")
    turn = F.pmod(F.xxhash64("node"), F.when(F.col("own") > 1, F.col("own")).otherwise(F.col("rest")))
    return dealt.select("key", F.xxhash64(F.col("own") > 1, sole, turn).alias("part"), sole.alias("sole"), "node", "component")


def linked_across(large: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): components that a pair of similar sets in one bucket joins, by all pairs across components.

    A bucket's parts meet two by two, each two in a task that holds their sets only, and two parts of one component
    not at all. So each set is sent as often as its bucket has parts, a PART-th of the pairs it is in, and the links
    of two parts are fewer than their sets.
    """
    dealt = scratch.keep(parts(large), "parts")
    all_parts = dealt.groupBy("key", "part").agg(F.any_value("sole").alias("sole"))
    other = all_parts.select("key", F.col("part").alias("right"), F.col("sole").alias("other"))
    meetings = all_parts.withColumnRenamed("part", "left").join(other, "key").where(
        "left <= right and coalesce(sole <> other, true)").select("key", "left", "right")
    sides = meetings.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("part"))
    rows = dealt.drop("sole").join(sides, ["key", "part"]).join(texts, "node").select(
        "key", "left", "right", (F.col("part") == F.col("right")).alias("second"), "component", "text")
    rows = rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> pa.RecordBatch:
            first, second = held
            found = list(joined(first or second, second))     # a part that meets itself is all second
            return pa.RecordBatch.from_pydict({"u": pa.array([a for a, _ in found], pa.int64()),
                                               "v": pa.array([b for _, b in found], pa.int64())})

        meeting, held = None, ([], [])
        for batch in slices(batches, "text"):
            fields = [batch.column(k).to_pylist() for k in range(5)]
            for *now, second, component, text in zip(*fields, binary(batch.column(5))):
                if now != meeting:
                    if meeting is not None:
                        yield links()
                    meeting, held = now, ([], [])
                held[second].append((component, shingle_set(text)))
        if meeting is not None:
            yield links()

    return rows.mapInArrow(lambda batches: released(compare(batches)), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    scratch: Scratch | None = None) -> DataFrame:
    """Every row's component of documents linked by a similarity of 0.75 or more of their 5-word shingle sets.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept. Equal sets are one class from the
    start, so groups of copies of any size cost one row per copy. Classes that share a band's key meet in a bucket,
    and each is compared with the bucket's least doc_id (star). Buckets that the links found so far leave in more than
    one component compare all their pairs across components: small ones as rows, larger ones part by part. So every
    two texts that share a band are compared, unless other links join them already; buckets of any size are whole.

    Texts null, empty or without words have an empty set and are linked with nothing. Rows without doc_id are
    returned with n_shingles, no component and kept. Rows that repeat a doc_id are returned as often as given; with
    equal texts they are one document, with different texts each has its own links. Empty input gives no rows.
    Other columns are ignored.
    """
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    rows = scratch.keep(signatures(docs), "signatures")
    sets = rows.where("doc_id is not null and set_key is not null")
    classes = scratch.keep(
        sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"),
                                    F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
        .select("set_key", "first.*", "n", "bands", F.xxhash64("set_key").alias("node")), "classes")
    bands = classes.select("node", "doc_id", "n", F.explode("bands").alias("key"))
    buckets = scratch.keep(distinct_buckets(bands), "buckets")
    classes = classes.drop("bands")
    meeting = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("doc_id", "text_hash", "node")
    # a repeated row may give a node two equal texts, which does no harm
    texts = scratch.keep(docs.join(meeting, ["doc_id", "text_hash"]).select("node", "text"), "texts")

    tested = scratch.keep(star_pairs(buckets), "pairs")
    stars = components(linked(tested, texts), scratch)
    left = scratch.keep(open_buckets(buckets, labels(stars)), "open")
    pairs = scratch.keep(
        cross_pairs(left.where(f"size <= {PAIRED}")).join(tested, ["centre", "member"], "left_anti"), "pairs")
    if not pairs.isEmpty():
        stars = components(stars.unionByName(linked(pairs, texts)), scratch)
    large = left.where(f"size > {PAIRED}")
    if not large.isEmpty():
        large = scratch.keep(open_buckets(large.drop("component", "size"), labels(stars)), "open")
        stars = components(stars.unionByName(linked_across(large, texts, scratch)), scratch)

    named = classes.join(labels(stars), "node", "left").select(
        "set_key", "doc_id", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("set_key", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group, with all its columns: that of the least doc_id, then the least text hash.

    Decided row by row: rows that share a doc_id and have different texts are judged by their texts, of repeated rows
    and of copies without doc_id (which come last) one stays, and rows without words all stay.
    """
    scratch, passing = (Scratch(docs.sparkSession, "neardup") for _ in range(2))
    # written, so that a row keeps its number in every pass
    rows = scratch.keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    groups = scratch.keep(near_duplicates(rows, ROW, text_column, passing).where("n_shingles > 0").select(
        F.col("doc_id").alias(ROW), "component_id"), "groups")
    passing.clear()     # only the numbers of rows are needed from here on
    shared = groups.groupBy("component_id").agg(F.count("*").alias("members")).where("members > 1").select("component_id")
    members = groups.join(shared, "component_id").join(
        rows.select(ROW, F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash")), ROW)
    place = F.struct(F.col("id").isNull().alias("nameless"), "id", "hash", ROW)
    kept = members.groupBy("component_id").agg(F.min(place).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    dropped = scratch.keep(members.select(ROW).join(kept, ROW, "left_anti"), "dropped")
    return rows.join(dropped, ROW, "left_anti").drop(ROW)
