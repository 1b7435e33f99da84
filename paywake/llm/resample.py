"""Importance resampling towards a target: hashed n-gram features, weighed by two bags, drawn with Gumbel noise."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch
from paywake.llm.words import slices
from paywake.llm.wordtable import LETTERS_DIGITS, WordTable, distinct
from paywake.plans.positions import split_positions

BUCKETS = 10_000    # of feature hashes
MIN_WORDS = 20      # of a document that may be drawn
PERCENT = 25        # of those documents are drawn
SEED = 7
MATRIX = 256        # bytes of a feature up to which features share a matrix with others of their length

_CRC = np.zeros(256, np.uint32)
for _byte in range(256):
    _value = _byte
    for _ in range(8):
        _value = _value >> 1 ^ (0xEDB88320 if _value & 1 else 0)
    _CRC[_byte] = _value


def matrix_crc(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of each feature of a uint8 matrix that holds one feature a column: all CRCs advance byte by byte."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for byte in columns:
        crc = _CRC[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def feature_crcs(table: WordTable, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of words, or of two words with a space between, given by code.

    Features of equal length fill one matrix, and their CRCs go back to the features' places. Features of more
    than MATRIX bytes, whose lengths are rarely shared, are hashed one by one: the time stays linear in their bytes.
    """
    length = table.length[first] if second is None else table.length[first] + 1 + table.length[second]
    out = np.empty(len(first), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, at = np.unique(length[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, at[1:])):
        a = first[rows]
        if size > MATRIX:
            words = table.words
            out[rows] = [zlib.crc32(words[i].as_py() if second is None else words[i].as_py() + b" " + words[j].as_py())
                         for i, j in zip(a.tolist(), a.tolist() if second is None else second[rows].tolist())]
            continue
        byte = np.arange(size)[:, None]
        if second is None:
            out[rows] = matrix_crc(table.data[table.start[a] + byte])
            continue
        b, split = second[rows], table.length[a]
        place = np.where(byte < split, table.start[a] + byte, table.start[b] + byte - split - 1)
        columns = table.data[np.minimum(np.maximum(place, 0), len(table.data) - 1)]
        columns[split, np.arange(len(rows))] = 0x20
        out[rows] = matrix_crc(columns)
    return out


def _features(texts: pa.Array, buckets: int) -> tuple[WordTable, np.ndarray, np.ndarray]:
    """(words, bucket of each word, bucket of the pair that begins at each word or -1)."""
    table = WordTable(texts, LETTERS_DIGITS)
    kinds = len(table.words)
    single = feature_crcs(table, np.arange(kinds)).astype(np.int64) % buckets
    pair = np.full(len(table.code), -1, np.int64)
    joined = np.flatnonzero(table.row[1:] == table.row[:-1])
    if len(joined):
        pairs, code = distinct(table.code[joined] * kinds + table.code[joined + 1])
        pair[joined] = (feature_crcs(table, pairs // kinds, pairs % kinds).astype(np.int64) % buckets)[code]
    return table, single[table.code], pair


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of features of all texts. Each task sends one row per bucket at most."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            _, single, pair = _features(batch.column(0), buckets)
            total += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found), "n": pa.array(total[found])})

    counted = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(rows, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's smoothed log ratio of target to raw, in thousandths, rounded down. Both tables have `buckets` rows at most."""
    s, t = [0] * buckets, [0] * buckets
    for counts, table in ((s, raw), (t, target)):
        for row in table.collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets))))
                     for a, b in zip(s, t)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs, which have a column `text`, with n_words, n_features and weight in its place."""
    buckets = len(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = batch.schema.get_field_index("text")
            table, single, pair = _features(batch.column(at), buckets)
            worth = gain[single] + np.where(pair >= 0, gain[pair], 0)
            upto = np.concatenate([[0], np.cumsum(worth)])
            n_words = table.per_text()
            ends = np.cumsum(n_words)
            total = upto[ends] - upto[ends - n_words]
            n_features = n_words + np.maximum(n_words - 1, 0)
            weight = np.where(n_words > 0, total // np.maximum(n_features, 1), 0)
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (n_words, n_features, weight))], names)

    kept = [c for c in docs.columns if c != "text"]
    names = [*kept, "n_words", "n_features", "weight"]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(rows, ", ".join([*fields, "n_words bigint", "n_features bigint", "weight bigint"]))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, doc: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Draw documents by how like the target's texts they are, without replacement.

    Features are all words and pairs of consecutive words, counted in hash buckets. A document's weight is the mean
    gain of its features, rounded down; Gumbel noise from its doc_id makes the highest scores a draw. Returns one
    row per row of docs: doc_id, n_features, weight, score, rank (from 1; null where not drawn) and, with `whole`,
    `document`, a struct of all its columns, so that no name can clash.

    Null and empty texts have no features and weight 0; documents of fewer than `min_words` words are scored but
    not drawn. Ties go to the smaller doc_id; rows that repeat one are drawn each by itself, and a null doc_id has
    the noise of an empty name and stands first among ties. No rows give no rows; with an empty target every text
    is weighed against a uniform one.

    To the driver come the bucket counts and the number of documents by score. Scores are whole numbers within
    some 42 * 1000 of 0 for gains of any corpus below 10**18 features and -3,130 to 22,900 for the noise, so there
    are at most some 110,000. Only drawn rows and ties at the last score are numbered, across range partitions.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets)
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")] if whole else []
    plain = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *own)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(name, "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.keep(weigh(plain, gain).withColumn("score", F.col("weight") + noise).withColumn("tie", F.rand(seed)), "scored")
    open_ = F.col("n_words") >= min_words
    counts = sorted(((r["score"], r["n"]) for r in scored.where(open_).groupBy("score").agg(F.count("*").alias("n")).collect()),
                    reverse=True)
    quota, least, upto = percent * sum(n for _, n in counts) // 100, None, 0
    for least, n in counts:
        upto += n
        if upto >= quota:
            break
    columns = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    rest = [F.col("document")] * whole
    if not quota:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"), *rest)
    drawn = open_ & (F.col("score") >= least)
    placed = split_positions(scored.where(drawn), [], [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("tie")], "place")
    rank = F.when(F.col("place") <= quota, F.col("place"))
    return placed.select(*columns, rank.cast("bigint").alias("rank"), *rest).unionByName(
        scored.where(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank"), *rest))
