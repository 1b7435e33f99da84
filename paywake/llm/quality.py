"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch
from paywake.llm.words import slices

SAMPLE = 20_000         # labelled documents that the model is fitted to, at most
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS = 150, 60
LEAVES = 3              # of a shallow tree
PAIRS = 8               # interactions
RATE = 0.1
THRESHOLD = 0.3

FEATURES = ("chars", "words", "word_length", "longest_word", "upper", "digit", "space", "punctuation", "symbol", "other",
            "distinct_words", "top_word", "repeated_pairs", "lines", "line_length", "repeated_lines", "end_marks",
            "commas", "short_words", "title_words", "symbol_words")
_SYMBOLS = re.compile(r"[#$%&*<>=|{}\[\]@~^\\/_+]")
_MARKS = re.compile(r"[.,;:!?'\"()\-]")
_ENDS = re.compile(r"[.!?](?:\s|$)")


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES of a whole text; null is empty."""
    text = text or ""
    n, words, lines = len(text), text.split(), text.split("\n")
    k, chars = max(1, len(words)), max(1, n)
    lengths = [len(w) for w in words] or [0]
    counted = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    filled = [line for line in lines if line.strip()]
    plain = text.encode("utf-8", "replace")
    upper = sum(map(plain.count, _UPPER))
    digit = sum(map(plain.count, _DIGIT))
    symbols, marks = len(_SYMBOLS.findall(text)), len(_MARKS.findall(text))
    return [
        np.log1p(n), np.log1p(len(words)), sum(lengths) / k, np.log1p(max(lengths)), upper / chars, digit / chars,
        (n - sum(lengths)) / chars, marks / chars, symbols / chars, (len(plain) - n) / chars, len(counted) / k,
        (counted.most_common(1)[0][1] if counted else 0) / k, 1 - len(pairs) / max(1, len(words) - 1) if pairs else 0.0,
        np.log1p(len(filled)), np.log1p(n / max(1, len(filled))), 1 - len(set(filled)) / max(1, len(filled)),
        len(_ENDS.findall(text)) / k, text.count(",") / k, sum(x <= 3 for x in lengths) / k,
        sum(w.istitle() for w in words) / k, sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / k]


_UPPER = [bytes([c]) for c in range(65, 91)]
_DIGIT = [bytes([c]) for c in range(48, 58)]


class Tables:
    """The fitted model: cut points, a lookup table per feature and per pair of features."""

    def __init__(self, base: float, cuts: list[np.ndarray], tables: np.ndarray,
                 pairs: list[tuple[int, int]], pair_cuts: list[np.ndarray], pair_tables: np.ndarray):
        self.base, self.cuts, self.tables = base, cuts, tables
        self.pairs, self.pair_cuts, self.pair_tables = pairs, pair_cuts, pair_tables

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1: bins looked up and added, a column at a time."""
        total = np.full(len(rows), self.base)
        for f, cuts in enumerate(self.cuts):
            total += self.tables[f][np.searchsorted(cuts, rows[:, f], "right")]
        coarse = [np.searchsorted(cuts, rows[:, f], "right") for f, cuts in enumerate(self.pair_cuts)]
        for table, (a, b) in zip(self.pair_tables, self.pairs):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _step(bins: np.ndarray, size: int, residual: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A shallow tree over one feature's bins: at most LEAVES runs of bins, each with its Newton step."""
    gradient, curve = np.bincount(bins, residual, size), np.bincount(bins, weight, size) + 1e-9
    g, h = np.concatenate([[0], gradient.cumsum()]), np.concatenate([[0], curve.cumsum()])
    edges = [0, size]
    for _ in range(LEAVES - 1):
        best, at = 0.0, None
        for a, b in zip(edges, edges[1:]):
            mid = np.arange(a + 1, b)
            if len(mid):
                gain = ((g[mid] - g[a]) ** 2 / (h[mid] - h[a] + 1) + (g[b] - g[mid]) ** 2 / (h[b] - h[mid] + 1)
                        - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1))
                if gain.max() > best:
                    best, at = float(gain.max()), int(mid[gain.argmax()])
        if at is None:
            break
        edges = sorted([*edges, at])
    out = np.zeros(size)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _pair_step(a: np.ndarray, b: np.ndarray, residual: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two features: the best cut of each makes four cells. Also the gain."""
    flat, cells = a * PAIR_BINS + b, PAIR_BINS * PAIR_BINS
    g = np.bincount(flat, residual, cells).reshape(PAIR_BINS, PAIR_BINS)
    h = np.bincount(flat, weight, cells).reshape(PAIR_BINS, PAIR_BINS)
    out, best = np.zeros((PAIR_BINS, PAIR_BINS)), 0.0
    for i in range(1, PAIR_BINS):
        for j in range(1, PAIR_BINS):
            parts = [(s, t) for s in (slice(0, i), slice(i, None)) for t in (slice(0, j), slice(j, None))]
            steps = [(g[p].sum(), h[p].sum() + 1) for p in parts]
            gain = sum(x * x / y for x, y in steps)
            if gain > best:
                best, out = gain, np.zeros((PAIR_BINS, PAIR_BINS))
                for p, (x, y) in zip(parts, steps):
                    out[p] = x / y
    return out, best


def fit(rows: np.ndarray, labels: np.ndarray) -> Tables:
    """Cyclic boosting: in each round every feature in turn gets a shallow tree on what the others leave.

    Then the pairs of features with the largest gain are boosted the same way. With one label only, or no rows, the
    score is the same for all.
    """
    n, m = rows.shape
    share = (labels.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    pair_cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    tables = np.zeros((m, BINS))
    if not n or labels.min() == labels.max():
        return Tables(base, cuts, tables, [], pair_cuts, np.zeros((0, PAIR_BINS, PAIR_BINS)))
    bins = [np.searchsorted(c, rows[:, f], "right") for f, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, rows[:, f], "right") for f, c in enumerate(pair_cuts)]
    total = np.full(n, base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(m):
            step = RATE * _step(bins[f], BINS, *slope())
            tables[f] += step
            total += step[bins[f]]
    left = slope()
    gains = {(a, b): _pair_step(coarse[a], coarse[b], *left)[1] for a, b in combinations(range(m), 2)}
    pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            step = RATE * _pair_step(coarse[a], coarse[b], *slope())[0]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return Tables(base, cuts, tables, pairs, pair_cuts, pair_tables)


def held_out(doc_id) -> F.Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def described(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and features of every whole text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "features": pa.array(
                [features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float32()))})

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        rows, "doc_id bigint, features array<float>")


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, len(FEATURES)).astype(np.float64)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 from THRESHOLD on) of every document.

    The features of all texts are computed once and written; the model is fitted to at most SAMPLE labelled rows
    outside the held-out fold, those least in a hash of doc_id, and looked up for all. A null text is an empty one
    and gets a score. Labels that are null, or whose doc_id is null or unknown, teach nothing; a doc_id with
    different labels has their maximum. Repeated rows come back as often as given, a null doc_id stays null and is
    not held out, no rows give no rows, and other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(described(docs), "features")
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label")))
    sample = rows.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "features").limit(SAMPLE).select("features", "label").toPandas()
    points = np.array(sample["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    sent = docs.sparkSession.sparkContext.broadcast(fit(points, sample["label"].to_numpy(float)))   # a few tables

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(
                sent.value.score(_matrix(batch.column(1))), pa.float64())})

    scored = rows.mapInArrow(scores, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
