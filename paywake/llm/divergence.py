"""How sources of a language differ in their words: counts by fixed-width digests, texts joined back at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywake.llm.store import Scratch
from paywake.llm.words import slices
from paywake.llm.wordtable import LETTERS, WordTable, distinct

LEAST_DOCS = 3      # documents of a language that have a kept term
RANKS = 200         # terms reported per group
SCALE = 1_000_000_000
BITS = 64           # of a digest
BATCH = 8 << 20     # bytes of text whose counts are combined before they are sent
PAIRS = 1 << 21     # pairs of counts that a task computes at a time
SALTS = 16          # parts in which the groups of a language meet each other


def _digests(words: pa.Array, bits: int) -> np.ndarray:
    found = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    return (found >> np.uint64(64 - bits)).view(np.int64)


def _counts(docs: DataFrame, bits: int, by_text: bool) -> DataFrame:
    """(lang_id, group_id, digest, n, docs, term): partial counts, combined over BATCH bytes of text.

    `term` is set once for each text of a digest in a batch. With `by_text` every row counts a text, not a digest,
    and has it.
    """
    names = ["lang_id", "group_id", "digest", "n", "docs", "term"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            table = WordTable(batch.column(2), LETTERS)
            if not len(table.code):
                continue
            digest = _digests(table.words, bits)
            unit = np.arange(len(digest)) if by_text else distinct(digest)[1]
            spelled = np.unique(unit, return_index=True)[1]     # a text of each unit
            width = len(spelled)
            groups, group = distinct(batch.column(1).to_numpy())
            lang_of = np.zeros(len(groups), np.int64)
            lang_of[group] = batch.column(0).to_numpy()
            held, uses = np.unique(table.row * width + unit[table.code], return_counts=True)     # by document
            key, at = np.unique(group[held // width] * width + held % width, return_inverse=True)
            n = np.bincount(at, uses, len(key)).astype(np.int64)
            own, of = key % width, key // width
            said = np.ones(len(key), bool) if by_text else np.zeros(len(key), bool)
            said[np.unique(own, return_index=True)[1]] = True
            term = table.words.take(pa.array(spelled[own], mask=~said))
            extra = np.setdiff1d(np.arange(len(digest)), spelled)    # texts that collide within the batch
            none = np.zeros(len(extra), np.int64)
            numbers = [(lang_of[of], none), (groups[of], none), (digest[spelled[own]], digest[extra]), (n, none),
                       (np.bincount(at, minlength=len(key)), none)]
            term = pa.concat_arrays([term, table.words.take(pa.array(extra))]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c), pa.int64()) for c in numbers), term], names)

    return docs.select("lang_id", "group_id", "text").mapInArrow(
        rows, "lang_id bigint, group_id bigint, digest bigint, n bigint, docs bigint, term string")


def _named(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(docs with lang_id and group_id, groups): 64-bit names of the languages and of the (lang, source) that occur.

    The names are hashes, with the first seed under which no two of them are the same.
    """
    groups = scratch.keep(docs.select("lang", "source").distinct(), "names")
    for seed in range(64):
        ids = {"lang_id": F.xxhash64(F.lit(seed), "lang"), "group_id": F.xxhash64(F.lit(seed), "lang", F.lit(0), "source")}
        found = groups.withColumns(ids)
        n, ns, langs, ids_ = found.agg(F.count("*"), F.countDistinct("group_id"), F.countDistinct("lang"),
                                       F.countDistinct("lang_id")).first()
        if n == ns and langs == ids_:
            return docs.withColumns(ids), found
    raise ValueError("no seed keeps the names of all groups apart")


def _terms(docs: DataFrame, scratch: Scratch, bits: int, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(terms, texts): the kept terms (lang_id, digest, split, total, cells) and (digest, low, high).

    `cells` holds (group_id, n) of the groups that have the term. A digest that stands for several texts has a least
    and a greatest one; such digests are counted once more by text, and `split` is that text.
    """
    partial = scratch.keep(_counts(docs, bits, False), "partial")

    def kept(counts: DataFrame, term: list[str]) -> DataFrame:
        cells = counts.where("n > 0").groupBy("lang_id", "group_id", *term).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        found = cells.groupBy("lang_id", *term).agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"),
                                                    F.collect_list(F.struct("group_id", "n")).alias("cells"))
        return found.where(F.col("docs") >= least_docs).drop("docs")

    # documents that have any text of a digest are no fewer than those that have one of them, so none is missed
    merged = scratch.keep(kept(partial.drop("term"), ["digest"]), "merged")
    texts = scratch.keep(
        partial.where("term is not null").join(merged.select("digest").distinct(), "digest", "left_semi")
        .groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "texts")
    collided = texts.where("low <> high").select("digest")
    whole = merged.withColumn("split", F.lit(None).cast("string"))
    if not collided.isEmpty():
        again = _counts(docs, bits, True).join(collided, "digest", "left_semi").withColumnRenamed("term", "split")
        whole = whole.join(collided, "digest", "left_anti").unionByName(scratch.keep(kept(again, ["digest", "split"]), "split"))
    return whole, texts


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """p of a count in whole billionths, exact for all 64-bit counts."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return 1 + F.call_function("div", wide, (total + kinds).cast("decimal(19,0)"))


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); both are at most 10**9 + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(cells: DataFrame) -> DataFrame:
    """(group_id, other_id, value): what the terms that both groups have add to the sums over each one's own terms.

    A task holds PAIRS pairs at a time, or those of one count, and sends one row per pair of groups and batch.
    """
    names = ["group_id", "other_id", "value"]

    def batch_rows(group: np.ndarray, p: np.ndarray, p0: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        groups, code = distinct(group)
        keys, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        upto = np.cumsum(size)
        at = 0
        while at < len(group):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            k = size[at:stop]
            a = np.repeat(np.arange(at, stop), k)
            b = np.repeat(start[at:stop], k) + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            a, b = a[a != b], b[a != b]
            pa_, pb, a0, b0 = p[a], p[b], p0[a], p0[b]
            value = (pa_ - pb) ** 2 // pb - (pa_ - b0) ** 2 // b0 - (a0 - pb) ** 2 // pb + (a0 - b0) ** 2 // b0
            key, of = distinct(code[a] * len(groups) + code[b])
            total = np.zeros(len(key), np.int64)
            np.add.at(total, of, value)
            keys.append(key)
            values.append(total)
            at = stop
        key, of = distinct(np.concatenate(keys))
        total = np.zeros(len(key), np.int64)
        np.add.at(total, of, np.concatenate(values))
        return pa.RecordBatch.from_arrays([*map(pa.array, (groups[key // len(groups)], groups[key % len(groups)], total))], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            n = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            if not len(flat):
                continue
            fields = [flat.field(k).to_numpy() for k in range(3)]
            first = np.cumsum(n) - n
            yield batch_rows(*fields, np.repeat(first, n), np.repeat(n, n))

    by_term = cells.groupBy("lang_id", "digest", "split").agg(F.collect_list(F.struct("group_id", "p", "p0")).alias("cells"))
    return by_term.where(F.size("cells") > 1).select("cells").mapInArrow(rows, "group_id bigint, other_id bigint, value bigint")


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, other_id, value): the distance of each group to each other one of its language, over all kept terms.

    Over terms that neither group has, and over those that one has, the sums follow from the groups' sizes and from
    the number of terms by share; only terms that both have are looked at together.
    """
    side = groups.select("lang_id", "group_id", "kinds", "p0", "held")
    other = side.select("lang_id", F.col("group_id").alias("other_id"), F.col("p0").alias("other_p0"), F.col("held").alias("other_held"),
                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = side.withColumn("salt", F.pmod("group_id", F.lit(SALTS)).cast("int")).join(other, ["lang_id", "salt"]).where(
        "group_id <> other_id").drop("salt")
    neither = both.select("group_id", "other_id", F.coalesce(_distance(F.col("p0"), F.col("other_p0")) * (
        F.col("kinds") - F.col("held") - F.col("other_held")), F.lit(0)).alias("value"))
    shares = cells.groupBy("group_id", "p").agg(F.count("*").alias("terms"))
    one = shares.join(both.select("group_id", "other_id", "other_p0"), "group_id").groupBy("group_id", "other_id").agg(
        F.sum(F.col("terms") * _distance(F.col("p"), F.col("other_p0"))).alias("to"),
        F.sum(F.col("terms") * _distance(F.col("other_p0"), F.col("p"))).alias("from"))
    ends = [F.struct(F.col(a).alias("group_id"), F.col(b).alias("other_id"), F.col(v).alias("value"))
            for a, b, v in (("group_id", "other_id", "to"), ("other_id", "group_id", "from"))]
    parts = neither.unionByName(one.select(F.inline(F.array(*ends)))).unionByName(_shared(cells))
    return parts.groupBy("group_id", "other_id").agg(F.sum("value").alias("value"))


def _leading(cells: DataFrame, texts: DataFrame, ranks: int) -> DataFrame:
    """(group_id, item, value, rank): terms that a group has more often than its language, to `ranks` per group.

    The least value that can be reported is found from the numbers alone; only terms from it on get their text. Both
    windows rank at most `ranks` rows per group and map task.
    """
    more = cells.where("p > q").withColumn("value", _distance(F.col("p"), F.col("q")))
    values = more.groupBy("group_id", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group_id").orderBy(F.desc("value"))
    top = values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ranks)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = top.withColumn("before", before).where(F.col("before") < ranks).groupBy("group_id").agg(F.min("value").alias("least"))
    near = more.join(least, "group_id").where("value >= least").join(texts.select("digest", "low"), "digest")
    named = near.select("group_id", F.coalesce("split", "low").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("value"), "item"))
    return named.withColumn("rank", place).where(F.col("rank") <= ranks)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", ranks: int = RANKS,
          least_docs: int = LEAST_DOCS, bits: int = BITS) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language differ in the words of whole texts.

    Part `pair`: every other source of the language and the distance to it; part `term`: the words that mark the
    source. Words are runs of letters, A-Z lower-cased; a language keeps those in `least_docs` of its documents.

    Nulls are empty names and texts; a source without words is a group like any other; repeated rows are documents
    of their own; other columns are ignored; no rows give no rows. Counts shuffle 64-bit digests (`bits` is for
    tests of collisions); texts of kept digests go by themselves, once per batch of texts.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
                          for c, name in ((lang, "lang"), (source, "source"), (text, "text"))))
    plain, names = _named(plain, scratch)
    terms, texts = _terms(plain, scratch, bits, least_docs)
    langs = terms.groupBy("lang_id").agg(F.count("*").alias("kinds"), F.sum("total").alias("lang_total"))
    sizes = terms.select(F.inline("cells")).groupBy("group_id").agg(F.sum("n").alias("group_total"), F.count("*").alias("held"))
    numbers = {c: F.coalesce(c, F.lit(0)) for c in ("kinds", "lang_total", "group_total", "held")}
    groups = names.join(langs, "lang_id", "left").join(sizes, "group_id", "left").withColumns(numbers)
    p0 = F.when(F.col("kinds") > 0, _share(F.lit(0).cast("bigint"), F.col("group_total"), F.col("kinds")))
    groups = scratch.keep(groups.withColumn("p0", p0), "groups")
    each = terms.select("lang_id", "digest", "split", "total", F.inline("cells")).join(
        groups.select("group_id", "kinds", "lang_total", "group_total", "p0"), "group_id")
    cells = scratch.keep(each.select(
        "lang_id", "group_id", "digest", "split", _share(F.col("n"), F.col("group_total"), F.col("kinds")).alias("p"),
        _share(F.col("total"), F.col("lang_total"), F.col("kinds")).alias("q"), "p0"), "cells")
    own = groups.select("group_id", "lang", "source")
    others = groups.select(F.col("group_id").alias("other_id"), F.col("source").alias("item"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("value"), "item"))
    pairs = _pairs(cells, groups).join(others, "other_id").withColumn("rank", place)
    both = pairs.select("group_id", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(
        _leading(cells, texts, ranks).select("group_id", F.lit("term").alias("part"), "item", "value", "rank"))
    return both.join(own, "group_id").select("lang", "source", "part", "item", "value", "rank")
