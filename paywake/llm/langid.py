"""Language identification: known words by their log frequency in each language, others by shorter and shorter n-grams."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch, released, worker_cache
from paywake.llm.words import slices

SAMPLE = 12_000         # labelled texts that the tables are counted in, whole; rows of equal text and label count as one
WORDS = 60_000          # most frequent words of the sample that are known
GRAMS = 20_000          # most frequent n-grams of each length
LONGEST = 4             # characters of the longest n-gram
CACHE = 200_000         # words that a Python worker remembers, but for a text with more
FLOOR = 0.5             # count of what a language lacks
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """n-grams of <word>; single marks, which every word has, are none."""
    padded = f"<{word}>" if n > 1 else word
    return [padded[k:k + n] for k in range(len(padded) - n + 1)]


class Model:
    """Log frequencies per language of known words and of n-grams of each length.

    Evidence of each word met is remembered as a row of a matrix, so that a text costs one product.
    """

    def __init__(self, languages: list[str], tables: list[tuple[dict[str, int], np.ndarray]]):
        self.languages = languages
        self.tables = tables            # [words, LONGEST-grams, ..., 1-grams]: row by term, and the rows
        self.place: dict[str, int] = {}
        self.evidence = np.zeros((1024, len(languages)))
        self.known = np.zeros(1024, bool)

    def _scores(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a known word its own; else of the longest n-grams of which any is known, the mean; else zeros, unknown."""
        known = np.zeros(len(new), bool)
        out, left = np.zeros((len(new), len(self.languages))), range(len(new))
        for n, (place, logs) in zip((0, *range(LONGEST, 0, -1)), self.tables):
            rows, sizes, scored, later = [], [], [], []
            for k in left:
                found = [place[g] for g in (grams(new[k], n) if n else (new[k],)) if g in place]
                if found:
                    rows += found
                    sizes.append(len(found))
                    scored.append(k)
                else:
                    later.append(k)
            if scored:
                mean = np.add.reduceat(logs[rows], np.cumsum([0, *sizes[:-1]]), axis=0) / np.array(sizes)[:, None]
                out[scored] = mean - mean.max(axis=1, keepdims=True)
                known[scored] = True
            left = later
        return out, known

    def _remember(self, found: Iterable[str]) -> None:
        new = [word for word in found if word not in self.place]
        if len(self.place) + len(new) > CACHE:
            self.place.clear()
            new = list(found)
        if len(self.place) + len(new) > len(self.evidence):
            grown = np.zeros((2 * (len(self.place) + len(new)), len(self.languages)))
            grown[:len(self.place)] = self.evidence[:len(self.place)]
            self.evidence = grown
            self.known = np.resize(self.known, len(grown))
        if new:
            own = slice(len(self.place), len(self.place) + len(new))
            self.evidence[own], self.known[own] = self._scores(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its share of the evidence, and whether any word or letter is known.

        UNKNOWN and 0 where there is no letter; the first language where nothing is known.
        """
        counted = Counter(words(text or ""))
        if not counted or not self.languages:
            return UNKNOWN, 0.0, False
        self._remember(counted.keys())
        times = np.fromiter(counted.values(), float, len(counted))
        rows = np.fromiter(map(self.place.__getitem__, counted), np.int64, len(counted))
        total = times @ self.evidence[rows]
        # words of a text depend on each other: evidence grows with the root of their number
        shares = np.exp((total - total.max()) / math.sqrt(times.sum()))
        best = int(shares.argmax())
        return self.languages[best], float(shares[best] / shares.sum()), bool(self.known[rows].any())

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its share of the evidence."""
        return self.judge(text)[:2]


def held_out(doc_id) -> F.Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def _grams(size: int) -> F.Column:
    """(level, term) of the n-grams of `size` characters of <word>; every word has one letter at least."""
    ends = F.char_length("word") + (3 - size if size > 1 else 0)
    starts = F.when(ends > 0, F.sequence(F.lit(1), F.greatest(ends, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    padded = F.concat(F.lit("<"), "word", F.lit(">")) if size > 1 else F.col("word")
    return F.transform(starts, lambda at: F.struct(
        F.lit(1 + LONGEST - size).alias("level"), F.substring(padded, at, F.lit(size)).alias("term")))


def learn(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Tables counted by Spark over the whole texts of a sample of labelled rows outside the held-out fold.

    The sample is the labelled texts whose hash of text and label is among the SAMPLE least; copies of a text count once
    and take one place. What reaches the driver is bounded: one hash, then WORDS words and GRAMS n-grams of each length with their counts by language. Rows
    without text, language or doc_id are not learned from.
    """
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc).isNotNull() & ~held_out(F.col(doc)))
    usable = usable.select(F.xxhash64(text, lang).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    greatest = usable.select("h").distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts: Counter[tuple[str, str]] = Counter()
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, times in Counter(words(t)).items():
                    counts[label, word] += times
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([label for label, _ in counts], pa.string()),
                "word": pa.array([word for _, word in counts], pa.string()),
                "n": pa.array(list(counts.values()), pa.int64())})

    scratch = Scratch(docs.sparkSession, "language")
    sample = usable.where(F.lit(False) if greatest is None else F.col("h") <= greatest).dropDuplicates(["h"]).select("lang", "text")
    known = scratch.keep(sample.mapInArrow(lambda batches: released(counted(batches)), "lang string, word string, n bigint")
                         .groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    levels = F.concat(F.array(F.struct(F.lit(0).alias("level"), F.col("word").alias("term"))),
                      *(_grams(size) for size in range(LONGEST, 0, -1)))
    counts = known.select("lang", "n", F.explode(levels).alias("t")).groupBy("lang", "t.level", "t.term").agg(F.sum("n").alias("n"))
    # one entry per language
    terms = scratch.keep(counts.groupBy("level", "term").agg(F.sum("n").alias("total"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by")), "terms")
    by = terms.select("level", F.explode("by").alias("lang", "n")).groupBy("level", "lang").agg(F.sum("n").alias("n"))
    sizes = {(r["level"], r["lang"]): r["n"] for r in by.collect()}
    languages = sorted({label for _, label in sizes})
    leading = [terms.where(F.col("level") == level).orderBy(F.desc("total"), "term").limit(GRAMS if level else WORDS)
               for level in range(1 + LONGEST)]
    rows = reduce(DataFrame.unionByName, leading).collect()
    tables = []
    for level in range(1 + LONGEST):
        found = [r for r in rows if r["level"] == level]
        whole = np.array([sizes.get((level, label), 0) + FLOOR * len(found) for label in languages])
        by = np.array([[r["by"].get(label, 0) for label in languages] for r in found], float).reshape(len(found), len(languages))
        tables.append(({r["term"]: at for at, r in enumerate(found)}, np.log((by + FLOOR) / whole)))
    return Model(languages, tables)


def identify(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text.

    Null texts and texts without a letter are `und` with score 0, as is everything where nothing could be learned.
    Ties go to the first language by name. Repeated rows come back as often as given, a null doc_id stays null, no
    rows give no rows, and other columns, language and source among them, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)      # bounded by WORDS and GRAMS
    name = f"language {uuid.uuid4().hex}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker_cache(name, lambda: sent.value)
        for batch in slices(batches, "text"):
            found = [judge.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64())})

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        lambda batches: released(rows(batches)), "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, minimum: float = 0.0, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose text has a language with a score of at least `minimum`.

    Null texts, texts without a letter and texts of which no word, n-gram or letter was learned go. Rows are judged
    one by one, whatever their other columns hold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = f"language {uuid.uuid4().hex}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = worker_cache(name, lambda: sent.value)
        for batch in slices(batches, text):
            found = [judge.judge(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and known and score >= minimum for lang, score, known in found], pa.bool_()))

    return docs.mapInArrow(lambda batches: released(rows(batches)), docs.schema)
