"""Benchmark decontamination by a positional inverted index over all words of the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch, released
from paywake.llm.words import binary, hashed, slices
from paywake.llm.wordtable import LETTERS_DIGITS, WordTable

WINDOW = 10                 # words of a phrase
ROW = "_decontaminate_row"
ANCHORS = 3                 # lists that are intersected one after the other, from the rarest term on, before the rest
SHARD_BYTES = 4 << 20       # of texts that are inverted together

#: A-Z lower-cased; digits, a-z and all bytes of other characters kept; the rest separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def word_ids(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    return hashed(text.translate(_WORD_BYTES).split()).view(np.int64) if text else np.empty(0, np.int64)


def item_windows(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, window, terms) with the distinct windows of each item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({
                "item_id": batch.column(0),
                "ids": pa.array([word_ids(t) for t in binary(batch.column(1))], pa.list_(pa.int64()))})

    ids = benchmark.select(F.col(item).cast("string").alias("item_id"), F.col(text).cast("string").alias("text")
                           ).mapInArrow(rows, "item_id string, ids array<bigint>").where("size(ids) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ids") - (WINDOW - 1)))
    return (ids.select("item_id", "ids", F.explode(starts).alias("at"))
            .select("item_id", F.expr(f"slice(ids, at, {WINDOW})").alias("terms")).distinct()
            .withColumn("window", F.xxhash64("terms")))


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of (row, doc_id, text): shard, id, n, places, and for its documents rows, doc_ids, n_words.

    A shard is SHARD_BYTES of texts of one task, or one text. It has a row for each of its words, with the places at
    which the word stands, as document in the shard << 32 | position, in order; and a row without id that lists its
    documents. All words of all documents are in it, whatever is looked for later.
    """
    names = ["shard", "id", "n", "places", "rows", "doc_ids", "n_words"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SHARD_BYTES):
            table = WordTable(batch.column(2), LETTERS_DIGITS)
            per_text = table.per_text()
            begin = np.cumsum(per_text) - per_text
            place = (table.row << 32) + np.arange(len(table.code)) - begin[table.row]
            n = np.bincount(table.code, minlength=len(table.words))
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0, 0], np.cumsum(n)]).astype(np.int32), place[np.argsort(table.code, kind="stable")])
            ids = hashed(table.words.to_pylist()).view(np.int64)
            size = len(ids) + 1

            def once(values: pa.Array) -> pa.Array:
                """The list of the shard's documents, then nothing for its words."""
                return pa.ListArray.from_arrays(np.concatenate([[0], np.full(size, len(values))]).astype(np.int32), values)

            first = np.zeros(size, bool)
            first[0] = True
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(size, number)), pa.array(np.concatenate([[0], ids]), mask=first),
                pa.array(np.concatenate([[0], n])), lists, once(batch.column(0)), once(batch.column(1)),
                once(pa.array(per_text.astype(np.int64)))], names)
            number += 1

    kinds = "shard bigint, id bigint, n bigint, places array<bigint>, rows array<bigint>, doc_ids array<bigint>, n_words array<bigint>"
    return docs.mapInArrow(lambda batches: released(rows(batches)), kinds)


def documents(index: DataFrame) -> DataFrame:
    """(shard, at, row, doc_id, n_words): the documents of the index and their places in its shards."""
    listed = index.where("id is null").select("shard", F.posexplode(F.arrays_zip("rows", "doc_ids", "n_words")).alias("at", "d"))
    return listed.select("shard", F.col("at").cast("bigint").alias("at"), "d.rows", "d.doc_ids", "d.n_words").toDF(
        "shard", "at", "row", "doc_id", "n_words")


def _moved(places: Column, by: Column, slop: int) -> Column:
    """Places at which a window could begin that has the word `by` words further on."""
    starts = F.transform(places, lambda p: p - by)
    if not slop:
        return starts
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s - slop, s))))


def _ordered(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(window, length, steps): the (place, id) of each window, those of the rarest terms first; none if a term is absent."""
    placed = windows.select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("place", "id"))
    counts = index.where("id is not null").groupBy("id").agg(F.sum("n").alias("count"))
    steps = placed.join(counts, "id").groupBy("window", "length").agg(
        F.array_sort(F.collect_list(F.struct("count", F.col("place").cast("bigint").alias("place"), "id"))).alias("steps"))
    return steps.where("size(steps) = length").select(
        "window", "length", F.transform("steps", lambda s: F.struct(s["place"], s["id"])).alias("steps"))


def matches(index: DataFrame, windows: DataFrame, scratch: Scratch, slop: int = 0) -> DataFrame:
    """(shard, window, spans): where the windows (window, terms) occur, as arrays of (start, end) in places.

    The lists of each window's terms, moved back by the term's place in it, are intersected shard by shard: that of
    its rarest term with the next rarest, ANCHORS one after the other. What is left asks the lists of all its other
    terms at once, and each list is intersected with the places that all windows ask for. One plan for any number of
    windows; the lists of their terms are dealt by (shard, id) once and met by ever fewer candidates. With `slop` up to
    so many other words may stand between the terms, in order (proximity).
    """
    ordered = scratch.keep(_ordered(windows, index), "ordered")
    steps = ordered.select(F.explode("steps").alias("s"))
    words = index.where("id is not null").select("shard", "id", "places")
    rarest = words.join(ordered.select(F.col("steps")[0]["id"].alias("id")).distinct(), "id", "left_semi")
    listed = words.join(steps.select("s.id").distinct(), "id", "left_semi")
    step = F.col("steps")[0]
    found = ordered.select("*", step["id"].alias("id")).join(rarest, "id").select(
        "shard", "window", "length", "steps", _moved(F.col("places"), step["place"], slop).alias("starts"))
    for k in range(1, ANCHORS):
        step = F.get("steps", F.lit(k))
        asked = found.select("*", step["id"].alias("id"))
        met = asked.join(listed, ["shard", "id"], "left").select("shard", "window", "length", "steps", F.when(
            F.col("length") <= k, F.col("starts")).otherwise(F.array_intersect(
                "starts", _moved(F.col("places"), step["place"], slop))).alias("starts"))
        found = met.where("size(starts) > 0")
    found = scratch.keep(found, "candidates")
    if slop:
        rest = found.select("shard", "window", "length", "starts", F.explode("steps").alias("s"))
        return _in_order(rest.select("shard", "window", "length", "starts", "s.place", "s.id").join(listed, ["shard", "id"]), slop)
    asks = found.select("shard", "window", F.explode("starts").alias("start"), F.slice("steps", ANCHORS + 1, WINDOW).alias("rest"))
    asks = asks.select("shard", "window", "start", F.explode("rest").alias("s")).select(
        "shard", "window", "start", "s.id", (F.col("start") + F.col("s.place")).alias("place"))
    wanted = asks.groupBy("shard", "id").agg(F.collect_set("place").alias("wanted"))
    there = wanted.join(listed, ["shard", "id"]).select("shard", "id", F.explode(F.array_intersect("wanted", "places")).alias("place"))
    met = asks.join(there, ["shard", "id", "place"]).groupBy("shard", "window", "start").agg(F.count("*").alias("met"))
    left = found.select("shard", "window", "length", F.explode("starts").alias("start")).join(met, ["shard", "window", "start"], "left")
    whole = left.where(F.coalesce("met", F.lit(0)) == F.greatest(F.col("length") - ANCHORS, F.lit(0)))
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    return whole.groupBy("shard", "window").agg(F.collect_list(span).alias("spans"))


def _in_order(lists: DataFrame, slop: int) -> DataFrame:
    """The spans of windows whose terms stand in order, each at its first place behind the one before, within the slop."""
    near = F.filter("places", lambda p: F.exists("starts", lambda s: (p >= s) & (p < s + F.col("length") + slop)))
    by_window = lists.groupBy("shard", "window", "length", "starts").agg(
        F.array_sort(F.collect_list(F.struct("place", near.alias("near")))).alias("lists"))
    nowhere = F.lit(None).cast("bigint")

    def last(start: Column) -> Column:
        first = F.when(F.array_contains(F.col("lists")[0]["near"], start), start)
        return F.aggregate(F.slice("lists", 2, WINDOW), first, lambda at, one: F.coalesce(
            F.array_min(F.filter(one["near"], lambda p: p > at)), nowhere))

    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), (last(s) + 1).alias("end")))
    within = F.filter(spans, lambda s: s["end"] - s["start"] <= F.col("length") + slop)
    return by_window.select("shard", "window", within.alias("spans")).where("size(spans) > 0")


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0, doc: str = "doc_id", item: str = "item_id",
                  text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted item ids as strings), contaminated.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII, compared by 64-bit hashes. A window
    is 10 consecutive words of an item, or all of a shorter one; an item is counted if any of its windows occurs.
    Null and empty texts have no words: such documents come back with zeros, such items have no window. A repeated
    row is returned as often as given, judged on its own; a null doc_id stays null; an item whose item_id is null is
    matched, but not listed. Without documents no rows, without items nothing is hit. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    index = scratch.keep(build_index(_plain(docs, F.monotonically_increasing_id(), doc, text)), "index")
    return search(index, benchmark, slop, item, text)


def search(index: DataFrame, benchmark: DataFrame, slop: int = 0, item: str = "item_id", text: str = "text") -> DataFrame:
    """As contamination(), on a stored index, which serves any number of benchmarks."""
    listed, found = _searched(index, benchmark, slop, item, text)
    spans = found.select("shard", "window", F.inline("spans")).withColumn("at", F.shiftright("start", 32))
    hit = spans.select("shard", "at", F.explode(F.sequence("start", F.col("end") - 1)).alias("place")).distinct()
    hits = hit.groupBy("shard", "at").agg(F.count("*").alias("n_hit"))
    items = (spans.select("shard", "at", "window").distinct().join(listed.select("window", "item_id"), "window")
             .groupBy("shard", "at").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    whole = documents(index).join(hits, ["shard", "at"], "left").join(items, ["shard", "at"], "left")
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id",
                      text: str = "text") -> DataFrame:
    """The rows, with all columns, that hold no window of the benchmark. Each row is judged on its own text."""
    scratch, passing = (Scratch(docs.sparkSession, "decontaminate") for _ in range(2))
    # written, so that a row keeps its number in every pass
    rows = scratch.keep(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    index = passing.keep(build_index(_plain(rows, F.col(ROW), doc, text)), "index")
    _, found = _searched(index, benchmark, 0, item, text, passing)
    places = found.select("shard", F.explode("spans").alias("s")).select("shard", F.shiftright("s.start", 32).alias("at")).distinct()
    dirty = scratch.keep(documents(index).join(places, ["shard", "at"], "left_semi").select(F.col("row").alias(ROW)), "dirty")
    passing.clear()     # only the numbers of dirty rows are needed from here on
    return rows.join(dirty, ROW, "left_anti").drop(ROW)


def _plain(docs: DataFrame, row: Column, doc: str, text: str) -> DataFrame:
    return docs.select(row.alias("row"), F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def _searched(index: DataFrame, benchmark: DataFrame, slop: int, item: str, text: str,
              scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The items' windows and where they occur, both written."""
    scratch = scratch or Scratch(index.sparkSession, "decontaminate")
    listed = scratch.keep(item_windows(benchmark, item, text), "items")
    windows = scratch.keep(listed.groupBy("window").agg(F.any_value("terms").alias("terms")), "windows")
    return listed, scratch.keep(matches(index, windows, scratch, slop), "matches")
