"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from paywake.llm import registry, resample
from paywake.llm.wordtable import LETTERS, LETTERS_DIGITS, WordTable

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, weight string, document int"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    found = words_of(text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def brute_force(docs, target, percent=25, least=20):
    s, t = np.zeros(10_000, int).tolist(), np.zeros(10_000, int).tolist()
    for bag, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text):
                bag[zlib.crc32(f.encode()) % 10_000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text, *_ in docs:
        found = features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in found) // len(found) if found else 0
        name = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                     len(words_of(text))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[:percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def texts(n, seed=0, kinds=300):
    rng = np.random.default_rng(seed)
    return [" ".join(f"W{k}" for k in rng.integers(0, kinds, int(rng.integers(1, 60)))) for _ in range(n)]


def documents():
    odd = [None, "", " \t", "one", "É é\U0001f600x 7up A_b-C", "x" * 70_000, "ab " * 30_000, "\x00\x7f", "y" * 256 + " z " + "y" * 255]
    rows = [(k, t, "en", "w", k) for k, t in enumerate([*texts(300), *odd])]
    return [*rows, rows[7], rows[7], (None, rows[3][1], None, None, None), (900, rows[3][1], None, None, None)]


TARGET = [*texts(20, 5, 40), None, "", "Target words beyond the corpus"]


@pytest.mark.parametrize("percent", [25, 0, 100])
def test_draw_equals_brute_force(spark, percent):
    docs = spark.createDataFrame(documents(), SCHEMA).repartition(5)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, weight int")
    found = resample.resample(docs, target, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_force(documents(), TARGET, percent)


def test_whole_rows_and_empty_tables(spark):
    docs, none = spark.createDataFrame(documents(), SCHEMA), spark.createDataFrame([], SCHEMA)
    whole = resample.resample(docs, none, whole=True)
    assert whole.schema["document"].dataType == docs.schema
    assert sorted(map(str, (r["document"] for r in whole.collect()))) == sorted(map(str, docs.collect()))
    assert sorted(map(tuple, whole.drop("document").collect()), key=str) == brute_force(documents(), [])
    assert resample.resample(none, docs).count() == 0


def test_ties_go_to_the_smaller_doc_id(spark, monkeypatch):
    """Without noise all documents of one text tie."""
    monkeypatch.setattr(resample.F, "log", lambda c: resample.F.lit(-1.0) + 0 * c)
    docs = spark.createDataFrame([(k, "a " * 30) for k in range(40)], "doc_id bigint, text string").repartition(4)
    found = resample.resample(docs, docs).where("rank is not null").collect()
    assert sorted((r["rank"], r["doc_id"]) for r in found) == [(k + 1, k) for k in range(10)]


def test_matrix_crc_of_every_length(spark):
    lengths = [1, 2, 3, 10, 127, 255, 256, 257, 300]
    text = " ".join(chr(0x61 + k % 26) * n for k, n in enumerate(lengths * 2))
    table = WordTable(pa.array([text]), LETTERS_DIGITS)
    kinds = [w.as_py() for w in table.words]
    assert resample.feature_crcs(table, np.arange(len(kinds))).tolist() == [zlib.crc32(w) for w in kinds]
    a, b = table.code[:-1], table.code[1:]
    assert resample.feature_crcs(table, a, b).tolist() == [zlib.crc32(kinds[i] + b" " + kinds[j]) for i, j in zip(a, b)]


def test_word_table_of_sliced_batches():
    column = pa.array(["skipped", None, "a1B", "", "Ünï çode  x", "b", "c-"]).slice(1)
    for table, pattern in ((LETTERS_DIGITS, WORD), (LETTERS, re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"))):
        found = WordTable(column, table)
        got = [[] for _ in column]
        for row, code in zip(found.row, found.code):
            got[row].append(found.words[int(code)].as_py().decode())
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [pattern.findall((t or "").translate(lower)) for t in column.to_pylist()]
        assert found.per_text().tolist() == [len(g) for g in got]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = registry.QUERIES["op11_resample"](spark, folder).collect()
    assert sorted(map(tuple, found), key=str) == brute_force([tuple(r) for r in docs], target)
