"""Rows that the stages keep, and the whole pipeline on a small folder, against brute force."""

import ctypes
import os
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paywake.llm import decontaminate, langid, neardup, pii, store
from paywake.llm import words as word_hashes
from tests.llm.test_operators import brute_words, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN = "the cat and the dog were in the house with a bird of that man"
DE = "der hund und die katze waren in dem haus mit einem vogel von diesem mann"


def mixed(base, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(base.split(), n)) + f" n{seed}"


def documents():
    rows = [(k, mixed(EN if k % 3 else DE, 60 + k, k), "en" if k % 3 else "de", f"s{k % 2}", 0) for k in range(40)]
    copy = rows[5][1]
    near = copy.split()
    near[30] = "changed"
    passage = mixed(EN, 30, 99)
    rows += [
        (100, copy, "en", "s", 0), (101, " ".join(near), "en", "s", 0), (None, copy, "en", "s", 0), (None, copy, None, None, None),
        (7, copy, "en", "s", 0),            # a doc_id that stands for two texts, one a copy
        rows[8], rows[8],                   # repeated rows
        (102, f"{mixed(EN, 40, 50)} {passage} {mixed(EN, 40, 51)}", "en", "s", 0), (9, f"{mixed(DE, 30, 52)} {passage}", "de", "s", 0),
        (None, f"{passage} end", "en", "s", 0),
        (103, None, "en", "s", 0), (104, "", "en", "s", 0), (105, "12 !!", "en", "s", 0), (106, "こんにちは 世界", None, "s", 0),
        (107, mixed(EN, 50, 53) + " mail a.b@c.de, card 4111 1111 1111 1111", "en", "s", 0),
    ]
    return rows, passage


def first_of_groups(rows):
    """Rows that stay when one of each group of near copies does."""
    sets = [neardup.shingle_set((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    kept = []
    for g in set(group):
        members = [r for r, own in zip(rows, group) if own == g]
        kept.append(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
    return kept


def clean(rows, items):
    def hit(text):
        w = brute_words(text)
        windows = [brute_words(i)[k:k + 10] for i in items for k in range(max(1, len(brute_words(i)) - 9))]
        return any(w[k:k + len(x)] == x for x in windows for k in range(len(w) - len(x) + 1))

    return [r for r in rows if not hit(r[1])]


def texts_of(found):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in found)


def expected(rows):
    return sorted((str(r[0]), str(r[1])) for r in rows)


def test_near_duplicates_stage_keeps_one_row_of_each_group(spark):
    rows, _ = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert texts_of(kept.collect()) == expected(first_of_groups(rows))
    assert neardup.keep_first(docs.limit(0)).count() == 0


def test_decontamination_stage_judges_rows(spark):
    rows, passage = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id int, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and texts_of(kept.collect()) == expected(clean(rows, [passage]))


def test_language_stage_rejects_what_was_never_learned(spark):
    rows, _ = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = langid.learn(docs)
    kept = {(r["doc_id"], r["text"]) for r in langid.keep_identified(docs, model).collect()}
    assert kept == {(r[0], r[1]) for r in rows if r[0] not in (103, 104, 105, 106)}
    assert model.judge("Привет мир")[2] is False and model.judge("the привет")[2] is True
    assert model.predict("Привет мир")[0] in model.languages      # the query names a learned language all the same


def test_copies_take_one_place_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 30)
    ids = [k for k in range(1000, 3000) if zlib.crc32(str(k).encode()) % 3 != 1][:400]      # of the folds that are learned from
    hot = [(k, "hot text " + EN, "en", "s", 0) for k in ids]
    rows = [(k, mixed(EN if k % 2 else DE, 30, k), "en" if k % 2 else "de", "s", 0) for k in range(200)]
    once = langid.learn(spark.createDataFrame([*rows, *hot[:1]], SCHEMA)).tables
    many = langid.learn(spark.createDataFrame([*rows, *hot], SCHEMA).repartition(5)).tables
    assert all(a[0] == b[0] and np.allclose(a[1], b[1]) for a, b in zip(once, many))
    assert len(once[0][0]) > 20


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [r for r in rows if r[0] not in (103, 104, 105, 106)]
    left = clean(first_of_groups(left), [passage])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sorted((str(r[0]), tokenizer.encode(pii.redacted(r[1]), add_special_tokens=False).ids + [1]) for r in left)
    assert all(r["start"] == 0 and r["doc_tokens"] == r["length"] for r in found)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in found) == wanted
    assert len(corpus_pipeline.STAGES) == 5 and os.path.isdir(f"{tmp_path}/documents.parquet")
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(s)[k][0] == sum(n for _, n in sorted(s)[:k]) for s in sequences.values() for k in range(len(s)))


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, tmp_path, stage):
    rows, passage = documents()
    spark.createDataFrame([(1, passage)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA + ", `row` string")
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path)).schema == docs.schema


def test_a_worker_keeps_the_cache_of_one_operator(monkeypatch):
    monkeypatch.setattr(store, "_CACHE", {})
    first = word_hashes.hashed([b"a", b"b", b"a"])
    assert store.worker_cache("packing", dict) == {} and list(store._CACHE) == ["packing"]
    assert (word_hashes.hashed([b"a", b"b", b"a"]) == first).all() and list(store._CACHE) == ["words"]


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="only glibc gives memory back on request")
def test_freed_memory_goes_back_after_a_partition():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    held = []

    def batches():
        arrays = [np.ones(1000) for _ in range(20_000)]     # 160 MB
        held.extend(arrays[::200])                          # what lies between these stays with the C library
        yield from "ab"

    before = resident()
    assert list(store.released(batches())) == ["a", "b"] and len(held) == 100
    assert resident() - before < 60e6
