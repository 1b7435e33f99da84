"""The divergence audit against counting, digests that collide included."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from paywake.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, value int, item string, digest string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(docs, ranks=200, least=3):
    count, within, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(LOWER) for t in TERM.findall(text or "")]
        count[lang, source].update(found)
        within[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in within[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // total for t in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for a in sources:
            parts = {"pair": [(b, sum((p[a][t] - p[b][t]) ** 2 // p[b][t] for t in kept)) for b in sources if b != a],
                     "term": [(t, (p[a][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, a][t] and p[a][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out += [(lang, a, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < ranks]
    return sorted(out)


def documents(n=200, seed=4):
    rng = np.random.default_rng(seed)
    words = [a + b for a in "abcdefghij" for b in ("x", "Éy", "zz", "\U0001f600", "ß")]
    rows = []
    for k in range(n):
        source = f"s{min(int(rng.exponential(2)), 6)}"
        picked = rng.choice(words, int(rng.integers(0, 40)), p=np.arange(1, 51) / 1275)
        rows.append((k, " ".join(picked).upper() if k % 3 else ", ".join(picked), ("en", "de", None)[k % 3 if k % 5 else 0], source, 1, "i", "d"))
    odd = [("fr", "alone", "mot mot mot"), ("fr", "alone", None), ("fr", "", "mot"), ("es", None, ""), ("es", "s1", "123 !!"), ("en", "quiet", "42"),
           ("en", "s1", "ax " * 20_000), ("de", "s0", "q" * 70_000), (None, None, None), ("it", "x", "uno"), ("it", "y", "uno"), ("it", "z", "uno")]
    rows += [(1000 + k, t, lang, source, None, None, None) for k, (lang, source, t) in enumerate(odd)]
    return [*rows, rows[1], rows[1]]


@pytest.mark.parametrize("bits, ranks", [(64, 200), (5, 200), (64, 4)])
def test_audit_equals_counting(spark, monkeypatch, bits, ranks):
    monkeypatch.setattr(divergence, "PAIRS", 50)
    monkeypatch.setattr(divergence, "BATCH", 4000)
    found = divergence.audit(spark.createDataFrame(documents(), SCHEMA).repartition(4), bits=bits, ranks=ranks)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_force(documents(), ranks)


def test_empty_table_and_a_single_group(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(k, "same words here", "en", "s", 1, "", "") for k in range(5)]
    assert divergence.audit(spark.createDataFrame(rows, SCHEMA)).count() == 0       # no other source, nothing above the language


def test_other_columns_and_least_documents(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    swapped = [(r[0], r[1], r[3], r[2]) for r in rows]
    found = divergence.audit(docs, lang="source", source="lang", least_docs=1)
    assert sorted(map(tuple, found.collect())) == brute_force(swapped, least=1)
