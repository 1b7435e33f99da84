"""The registered queries on whole tables against brute force written from their definitions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywake.llm import langid, pii, quality, registry, url_filter

FOLDER = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(number))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(part) <= 255 for part in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_personal_data_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}
    found = {r["doc_id"]: r for r in registry.op3(spark, FOLDER).collect()}
    assert found.keys() == texts.keys()
    total = 0
    for doc_id, text in texts.items():
        spans = base_spans(text)
        assert found[doc_id]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [found[doc_id][f"n_{kind}"] for kind in pii.BASE] == [sum(s[0] == kind for s in spans) for kind in pii.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found[doc_id]["spans"].split(","))
        total += len(spans)
    assert total > 20


def test_personal_data_beside_nulls_and_clashing_columns(spark):
    rows = [(None, "a@b.cd", None, None), (1, None, "x", "y"), (1, "a@b.cd", None, "z"), (1, "a@b.cd", None, "z")]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string, spans string, kind string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in found) == [(0, 1), (1, 0), (1, 1), (1, 1)]


def test_url_rules_of_all_pages(spark):
    def expected(url):
        if url is None or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(name + start, verdict) for name, start, verdict in url_filter.RULES
                if (host == name or host.endswith("." + name)) and path.startswith(start)]
        return host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None))

    urls = {r["page_id"]: r["url"] for r in table(spark, "pages").collect()}
    found = {r["page_id"]: r for r in registry.op6(spark, FOLDER).collect()}
    assert found.keys() == urls.keys()
    ruled = 0
    for page_id, url in urls.items():
        host, path, rule, verdict = expected(url)
        row = found[page_id]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] in ("allow", "block") and verdict in (None, row["verdict"])
        ruled += rule is not None
    assert ruled


def test_languages_follow_from_the_tables(spark):
    """Known words, else the longest n-grams that are known, each word apart and without the remembered evidence."""
    docs = table(spark, "documents")
    model = langid.learn(docs)
    places, logs = [t[0] for t in model.tables], [t[1] for t in model.tables]

    def evidence(word):
        for level, size in enumerate((0, 4, 3, 2, 1)):
            padded = f"<{word}>" if size > 1 else word
            terms = [word] if not size else [padded[k:k + size] for k in range(len(padded) - size + 1)]
            rows = [logs[level][places[level][t]] for t in terms if t in places[level]]
            if rows:
                mean = sum(rows) / len(rows)
                return mean - mean.max()
        return np.zeros(len(model.languages))

    found = {r["doc_id"]: r for r in registry.op7(spark, FOLDER).collect()}
    right = held = 0
    for row in docs.collect():
        words = re.findall(r"[^\W\d_]+", (row["text"] or "").lower())
        got = found[row["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        if not words:
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        total = sum(evidence(w) for w in words)
        share = np.exp((total - total.max()) / np.sqrt(len(words)))
        assert got["score"] == pytest.approx(share.max() / share.sum(), rel=1e-6)
        assert got["lang_pred"] == model.languages[int(share.argmax())]
        if got["held_out"]:
            held += 1
            right += got["lang_pred"] == row["lang"]
    assert right > 0.95 * held > 0


def test_quality_scores_follow_from_the_tables(spark):
    """Each bin by counting the cuts at or below the value, one document at a time; labels of the held-out fold change nothing."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    found = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert {k: r["score"] for k, r in found.items()} == {r["doc_id"]: r["score"] for r in quality.quality(docs, flipped).collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {k: np.array(quality.features(t), np.float32).astype(float) for k, t in texts.items()}
    learned = [k for k in texts if k in known and zlib.crc32(str(k).encode()) % 5]
    tables = quality.fit(np.array([rows[k] for k in learned]), np.array([known[k] for k in learned], float))
    for k, values in rows.items():
        total = tables.base
        for f, cuts in enumerate(tables.cuts):
            total += tables.tables[f][sum(c <= values[f] for c in cuts)]
        for pair, (a, b) in zip(tables.pair_tables, tables.pairs):
            total += pair[sum(c <= values[a] for c in tables.pair_cuts[a])][sum(c <= values[b] for c in tables.pair_cuts[b])]
        assert found[k]["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=0.02)
        assert found[k]["predicted"] == (found[k]["score"] >= 0.3) and found[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0)
    judged = [(found[k]["score"], known[k]) for k in known if k in found and found[k]["held_out"]]
    good, bad = [s for s, q in judged if q], [s for s, q in judged if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_beside_clashing_columns(spark):
    rows = [(k, "good words here " * 5 if k % 2 else "### $$$", 0, 0.5, "f") for k in range(40)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int, score double, features string")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(40)], "doc_id bigint, quality int, features string")
    found = quality.quality(docs, labels).collect()
    assert len(found) == 41 and {r["predicted"] for r in found if r["doc_id"] is not None and r["doc_id"] % 2} == {1}
