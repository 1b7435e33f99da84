"""The training-data operators on small inputs, against brute force."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paywake.llm import decontaminate, imatch, langid, neardup, packing, perspectives, pii, quality, registry, url_filter, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, `row` string, node string"


def words(n, seed=0, kinds=50):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, kinds, n))


def documents():
    """Nulls, empty and long texts, exact and near copies, a repeated row, characters beyond the first plane."""
    base = words(300, 1, 5000)
    near = base.split()
    near[150] = "changed"
    texts = [base, base, " ".join(near), words(300, 2, 5000), None, "", "   ", "Three short words", "three SHORT words",
             "It's <|endoftext|> 'tis É́té ß 42!! a b \U0001f600", words(20_000, 3), words(9, 5), "!!! ###"]
    rows = [(10 + k, t, "en", "s", 1, "x", "y") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, empty):
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(documents())
    component = {r["doc_id"]: r["component_id"] for r in found}
    sets = {d[0]: neardup.shingle_set((d[1] or "").encode()) for d in documents() if d[0] is not None}
    expected = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        common = len(np.intersect1d(sets[a], sets[b]))
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            expected[b] = min(expected[b], expected[a])
    assert {i: component[i] for i in sets} == expected
    assert expected[11] == expected[12] == 10 and expected[18] == 17
    nobody = next(r for r in found if r["doc_id"] is None)
    assert nobody["component_id"] is None and nobody["kept"]
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    # one row of each group: the repeated row and the copy without doc_id go too
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in expected if expected[i] == i)


def test_a_chain_of_near_copies_is_one_component(spark):
    """Neighbours in the chain are similar, its ends are not; many unrelated texts share a passage with it."""
    base, rows = words(200, 9, 100_000).split(), []
    for k in range(60):
        base = [*base]
        base[(k * 7) % 200] = f"edit{k}"
        rows.append((k, " ".join(base)))
    passage = words(60, 11, 100_000)
    rows += [(1000 + k, f"{passage} {words(40, 100 + k, 100_000)}") for k in range(80)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {found[k] for k in range(60)} == {0}
    assert all(found[k] == k for k in found if k >= 1000)


def mixed_family(pairs, length=1200, edits=21, shared=11):
    """Two copies each of many variants of one text: similarity about 0.77 between the two, about 0.70 to all others."""
    rng, base, rows = np.random.default_rng(21), words(length, 21, 100_000).split(), []
    for k in range(pairs):
        places = rng.permutation(length // 5)[:2 * edits - shared] * 5
        for copy, own in enumerate((places[:edits], np.concatenate([places[:shared], places[edits:]]))):
            text = [*base]
            for place in own.tolist():
                text[place] = f"e{k}x{place}" if place in places[:shared] else f"e{k}x{place}y{copy}"
            rows.append((int(rng.integers(1 << 40)), " ".join(text)))
    return rows


def test_large_mixed_buckets_lose_no_link(spark, monkeypatch):
    """Pairs that meet in large buckets only, whose ends are similar to neither, and copies beside them."""
    monkeypatch.setattr(neardup, "PART", 40, raising=False)
    rows = mixed_family(250)
    copies = words(1200, 22, 100_000).split()
    rows += [((1 << 41) + k, " ".join([*copies[:4 * k], f"c{k}", *copies[4 * k + 1:]])) for k in range(100)]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    sets = [neardup.shingle_set(t.encode()) for _, t in rows]
    expected = {i: i for i, _ in rows}
    for a, b in combinations(range(len(rows)), 2):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            old, new = sorted((expected[rows[a][0]], expected[rows[b][0]]), reverse=True)
            expected = {i: new if c == old else c for i, c in expected.items()}
    assert found == expected
    assert len(set(expected.values())) > 200


def test_densified_bins_take_values_of_filled_ones():
    values, filled = np.zeros((2, neardup.BINS), np.uint64), np.zeros((2, neardup.BINS), bool)
    values[0, [3, 90]], filled[0, [3, 90]] = [7, 8], True
    out = neardup.densified(values, filled)
    assert set(out[0].tolist()) == {7, 8} and not out[1].any()


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination(spark, docs, empty, monkeypatch):
    short = "three short words"
    items = [(1, documents()[0][1][40:300]), (2, None), (3, ""), (4, short), (None, short), (5, words(12, 77)), (4, short)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    expected = []
    for doc in documents():
        w, hit, seen = brute_words(doc[1]), set(), set()
        for item, text in items:
            phrase = brute_words(text)
            for k in range(max(1, len(phrase) - 9)) if phrase else ():
                window = phrase[k:k + 10]
                for at in range(len(w) - len(window) + 1):
                    if w[at:at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        seen |= {str(item)} - {"None"}
        expected.append((doc[0] or -1, len(w), len(hit), sorted(seen), bool(hit)))
    for size in (decontaminate.SHARD_BYTES, 3000):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        found = decontaminate.contamination(docs, bench).collect()
        assert sorted((r["doc_id"] or -1, *r[1:]) for r in found) == sorted(expected)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] or -1 for r in clean.collect()) == sorted(e[0] for e in expected if not e[4])


def test_proximity_allows_words_between(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b x y z c d"), (3, "d c b a"), (4, "a b c d"), (5, "a x b c y d"), (6, "a a b c d")],
                                 "doc_id int, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id int, text string")
    for slop, hit in ((0, {4: 4, 6: 4}), (1, {1: 5, 4: 4, 6: 5}), (2, {1: 5, 4: 4, 5: 6, 6: 5}), (3, {1: 5, 2: 7, 4: 4, 5: 6, 6: 5})):
        near = decontaminate.contamination(docs, bench, slop=slop)
        assert {r["doc_id"]: r["n_hit"] for r in near.where("contaminated").collect()} == hit


def test_proximity_equals_brute_force(spark):
    """Random short texts of few words: spans begin anywhere and take each term at its first place behind the last."""
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(list("abcde"), int(rng.integers(0, 40)))) for _ in range(60)]
    items = [" ".join(rng.choice(list("abcde"), n)) for n in (1, 3, 5, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for slop in (0, 2):
        expected = {}
        for k, text in enumerate(texts):
            w, hit = text.split(), set()
            for item in items:
                p = item.split()
                for window in (p[j:j + 10] for j in range(max(1, len(p) - 9))):
                    for start in range(len(w)):
                        at = start if w[start] == window[0] else None
                        for term in window[1:]:
                            at = None if at is None else next((j for j in range(at + 1, len(w)) if w[j] == term), None)
                        if at is not None and at + 1 - start <= len(window) + slop:
                            hit.update(range(start, at + 1))
            expected[k] = len(hit)
        assert {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(docs, bench, slop=slop).collect()} == expected


def test_an_index_serves_any_benchmark(spark, docs):
    """All words of all documents are in it, with their places."""
    plain = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    index = decontaminate.build_index(plain).cache()
    held = {r["row"]: (r["doc_id"], r["n_words"], (r["shard"], r["at"])) for r in decontaminate.documents(index).collect()}
    lists = {}
    for r in index.where("id is not null").collect():
        assert r["n"] == len(r["places"]) and r["places"] == sorted(r["places"])
        for place in r["places"]:
            lists.setdefault((r["shard"], place >> 32), {})[place & 0xFFFFFFFF] = r["id"]
    for row in plain.collect():
        ids = decontaminate.word_ids((row["text"] or "").encode()).tolist()
        doc_id, n_words, at = held[row["row"]]
        assert doc_id == row["doc_id"] and n_words == len(ids)
        assert [v for _, v in sorted(lists.get(at, {}).items())] == ids
    for phrase in ("three short words", documents()[0][1][:200]):
        bench = spark.createDataFrame([(1, phrase)], "item_id int, text string")
        one, other = decontaminate.search(index, bench), decontaminate.contamination(docs, bench)
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    index.unpersist()


def test_packing_is_whole_and_tight(spark, docs, empty):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack(docs, TOKENIZER).collect()
    ids = {d[0]: np.array(coder.encode(d[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for d in documents()}
    seen: dict = {}
    for r in rows:
        part = ids[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]
        assert bytes(r["ids"]) == part and zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]]) // 4
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[d[0]]) // 4 for d in documents())
    for parts in seen.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= packing.CAPACITY
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_patterns_hold_the_demand():
    sizes, demand = np.array([100, 7, 60, 256]), np.array([90, 1000, 41, 3])
    found = packing.patterns(sizes, demand, 256)
    assert (sum(n * p for n, p in found) == demand).all()
    assert all((p * sizes).sum() <= 256 for _, p in found)
    assert sum(n for n, _ in found) <= (sizes * demand).sum() / 256 * 1.05 + 4


def test_linear_programs_of_many_sizes_end_near_the_bound():
    rng = np.random.default_rng(5)
    for lengths in (rng.integers(1, 2049, 30_000), np.minimum(rng.exponential(60, 30_000).astype(int) + 1, 2048)):
        classes = np.where(lengths <= packing.EXACT, lengths, -(-lengths // packing.UNIT) * packing.UNIT)
        sizes, demand = np.unique(classes, return_counts=True)
        found = packing.patterns(sizes[::-1], demand[::-1], 2048)
        assert (sum(n * p for n, p in found) == demand[::-1]).all() and all((p * sizes[::-1]).sum() <= 2048 for _, p in found)
        assert sum(n for n, _ in found) <= (sizes * demand).sum() / 2048 * 1.02 + 2
    assert packing.patterns(np.empty(0, np.int64), np.empty(0, np.int64), 2048) == []


@pytest.mark.parametrize("text, tokens", [("", 1), (" ".join("a" * 16), 17)])
def test_short_texts_fill_their_sequences(spark, text, tokens):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    rows = packing.pack(docs, TOKENIZER, keep_ids=False).collect()
    assert {r["length"] for r in rows} == {tokens} and len(rows) == 4000
    assert len({r["sequence_id"] for r in rows}) <= 4000 * tokens / (0.97 * packing.CAPACITY) + 1


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 1000)
    trap = "x" * 900 + "\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "y" * 3000
    rows = [(1, "http://a/ b", trap), (2, None, trap), (3, "u", None), (4, "u", ""), (5, "u", "é" * 60), (6, "u", "é" * 60),
            (7, "u" * 5000, "small"), (8, "u", "small"), (None, "u", trap), (2, None, trap)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    found = warc.round_trip(pages, payloads=True).collect()
    assert len(found) == len(rows)
    for r in found:
        html = next(h or "" for i, _, h in rows if i == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r["record_type"], r["refers_to"]) == {2: ("revisit", 1), 6: ("revisit", 5)}.get(r["page_id"], ("response", None))
        assert r["payload"] == (html if r["record_type"] == "response" else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pages_that_share_an_id_are_judged_by_their_payloads(spark):
    a, b = "a" * 200, "b" * 200
    rows = [(1, "u", a), (2, "u", b), (5, "u", a), (5, "u", "short"), (6, "u", a), (6, "u", b), (7, "u", a), (7, "u", "c" * 200)]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id int, url string, html string"), payloads=True).collect()
    first = {a: 1, b: 2}
    assert sorted((r["page_id"], r["payload_digest"], r["refers_to"] or 0, r["payload"] or "") for r in found) == sorted(
        (i, hashlib.sha256(h.encode()).hexdigest(), *((first[h], "") if first.get(h, i) != i else (0, h))) for i, _, h in rows)


def test_pii_spans():
    text = "Mail a.b@c.de now, @x.yz b@c, ip 10.0.0.256 or 10.0.0.1.5; card 4111 1111 1111 1111, phone +49 (30) 123-45-67."
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == [
        ("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-45-67")]
    assert pii.spans("my iban is DE89370400440532013000 ok")[-1][0] == "iban"
    assert pii.spans("DE88370400440532013000") == pii.spans(None) == pii.spans("") == []
    assert [s[0] for s in pii.spans("SSN 123-45-6789")] == ["ssn"] and not pii.spans("order 123-45-6789")
    assert pii.redacted("to a@b.cd, +49 30 1234567") == "to <email>, <phone>"
    assert pii.spans("a" * 200_000 + " " + "1" * 200_000 + "." + "é@" * 1000) == []


def test_ibans_end_at_their_countrys_length():
    def ibans(text):
        return [text[a:b] for k, a, b, _ in pii.spans(text) if k == "iban"]

    german, spaced, french = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "FR1420041010050500013M02606"
    for behind in ("", ".", " EUR 120", " BIC COBADEFF.", " BIC: X", " 12", f" {french}"):
        assert ibans(f"{german}{behind}") == [german, *([french] if french in behind else [])]
        assert ibans(f"to {spaced}{behind}")[0] == spaced
    assert ibans(f"AB12 {german} EUR") == [german] and ibans("NO9386011117947 NOK 5") == ["NO9386011117947"]
    assert ibans(f"{german}EUR") == ibans(f"X{german}") == ibans("DE88370400440532013000 EUR 120") == []
    assert pii.redacted(f"pay {german} EUR 120") == "pay <iban> EUR 120"
    unlisted = next(f"ZZ{k:02}12345678901234" for k in range(2, 99) if pii.mod97(f"ZZ{k:02}12345678901234"))
    assert ibans(f"{unlisted} BIC") == [unlisted]


def test_leading_zeros_of_any_number_are_read():
    text = f"{'0' * 5000}10.0.0.{'0' * 5000}"
    assert [s[:3] for s in pii.spans(text)] == [("ip", 0, len(text))]


def test_pii_query_counts_what_the_base_patterns_find(spark, tmp_path):
    text = "a@b.cd e.f@g.hi 10.0.0.1, 4111 1111 1111 1111, +49 30 1234567 DE89370400440532013000"
    spark.createDataFrame([(1, text), (2, None), (3, "\U0001f600 x@y.zz")], "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in registry.op3(spark, str(tmp_path)).collect()}
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"10\.0\.0\.1", "card": r"4111[ 1]+1", "phone": r"\+49 30 1234567"}
    spans = [f"{kind}:{m.start()}:{m.end()}" for kind, pattern in base.items() for m in re.finditer(pattern, text)]
    assert [found[1][f"n_{kind}"] for kind in base] == [2, 1, 1, 1]
    assert found[1]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
    assert found[1]["spans"] == ",".join([*spans, f"iban:{len(text) - 22}:{len(text)}"])
    assert found[2][1:] == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert found[3]["spans"] == "email:2:8"


def test_redaction_keeps_rows(docs, empty):
    assert pii.redact(docs).count() == docs.count() and pii.redact(docs).schema == docs.schema
    assert pii.find_pii(empty).count() == pii.redact(empty).count() == 0
    assert pii.find_pii(docs).where("size(spans) > 0").count() == 0


def test_fingerprints(docs, empty):
    found = imatch.edited_fingerprints(docs).collect()
    order = sorted((d for d in documents() if d[0] is not None), key=lambda d: (-d[0], d[1] or ""))
    expected = []
    for k, doc in enumerate(order):
        text, after = doc[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        expected.append((doc[0], len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found if r["doc_id"] is not None) == sorted(expected)
    prints = {r["doc_id"]: r["fingerprint"] for r in found}
    assert prints[10] == prints[11] == prints[None] != prints[13] and prints[14] == prints[15] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert imatch.edited_fingerprints(empty).count() == 0
    assert imatch.fingerprints(docs).count() == len(documents())


def test_fingerprints_by_brute_force(spark):
    """Terms of the band, drawn into each lexicon by a hash, sorted and hashed; likeness by lexicons."""
    rng = np.random.default_rng(31)
    texts = [" ".join(f"t{k}" for k in np.unique(rng.zipf(1.3, 60) % 500)) for _ in range(120)] + ["only once here", "", "t1", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [set(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    vocabulary = sorted(set().union(*sets))
    frequency = {w: sum(w in s for s in sets) for w in vocabulary}
    band = [w for w in vocabulary if 2 <= frequency[w] <= 8]
    hashed = {w: h for w, h in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w")).collect()}
    pairs = spark.createDataFrame([(hashed[w],) for w in band], "t bigint").select(
        "t", F.explode(F.sequence(F.lit(0), F.lit(len(imatch.DRAWN) - 1))).alias("no")).select(
        "t", "no", F.pmod(F.xxhash64("t", F.col("no").cast("int")), F.lit(1024))).collect()
    member = {(t, no): value < imatch.DRAWN[no] for t, no, value in pairs}

    def lists(words):
        terms = sorted(hashed[w] for w in words if w in set(band))
        return [(no, [t for t in terms if member[t, no]]) for no in range(len(imatch.DRAWN))]

    wanted = [(k, no, held) for k, s in enumerate(sets) for no, held in lists(s) if held]
    digest = spark.createDataFrame(wanted, "k int, no int, held array<bigint>").select(
        "k", "no", F.xxhash64("held").bitwiseAND(F.lit(0xFFFF))).collect()
    expected = {k: {} for k, _ in rows}
    for k, no, value in digest:
        expected[k][no] = f"{no << 16 | value:06x}"
    found = {r["doc_id"]: r for r in imatch.edited_fingerprints(docs).collect()}
    for k, text in rows:
        whole = "".join(expected[k][no] for no in sorted(expected[k]))
        assert found[k]["fingerprint"] == (whole or (imatch.NO_TERMS if text else ""))
        after = expected[(k - 1) % len(rows)]
        either = set(expected[k]) | set(after)
        same = sum(expected[k].get(no) == after.get(no) for no in either)
        assert found[k]["near_next"] == (same / len(either) if either else float((text or "") == (texts[k - 1] or "")))
    assert found[120]["fingerprint"] == imatch.NO_TERMS and sum(r["near_edited"] for r in found.values()) > 3 * sum(r["near_next"] for r in found.values())


def test_the_lexicon_is_no_column(docs):
    plan = imatch.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "AS _table" not in plan and "Python" not in plan


def test_url_rules_and_trees(spark):
    urls = ["https://a.example.org/en/12", "http://EXAMPLE.org/en/2", "x.com/fr/", "http://com/fr/", "http://a.com/de/?q", "http://acom/de/",
            "http://n.net/p", None, "http://example.org", "http://b.example.org/es/1#f"] * 8
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id int, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert [found[k][:3] for k in range(10)] == [
        ("a.example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("", "", None),
        ("com", "/fr/", "com/fr/"), ("a.com", "/de/", "com/de/"), ("acom", "/de/", None), ("n.net", "/p", None), ("", "", None),
        ("example.org", "", None), ("b.example.org", "/es/1", "example.org/es/")]
    assert [found[k][3] for k in (0, 1, 3, 4, 9)] == ["block", "allow", "allow", "block", "block"]
    assert {v[3] for v in found.values()} == {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_language(spark, docs, empty):
    rows = [(k, ("the cat and the dog" if k % 2 else "der hund und die katze") + f" {k}", "en" if k % 2 else "de") for k in range(60)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert model.predict("the dogs")[0] == "en" and model.predict("katzen")[0] == "de"
    assert model.predict(None) == model.predict("12 !") == ("und", 0.0)
    found = langid.identify(docs, model).collect()
    assert len(found) == len(documents()) and all(0 <= r["score"] <= 1 for r in found)
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}
    assert langid.keep_identified(docs, model).where("trim(coalesce(text, '')) = ''").count() == 0


def test_quality_learns(spark, docs, empty):
    rows = [(k, words(60, k) if k % 2 else "### !!! " * 30, k % 2) for k in range(200)]
    train = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")
    labels = spark.createDataFrame([*[(r[0], r[2]) for r in rows], (None, 1), (3, None)], "doc_id int, quality int")
    found = {r["doc_id"]: r for r in quality.quality(train, labels).collect()}
    assert all(found[k]["predicted"] == k % 2 for k in range(200) if found[k]["held_out"])
    assert quality.quality(empty, labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).count() == len(documents())


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (1, 70, None, "late"), (2, 0, "user", "alone"),
            (None, None, "user", "stray"), (2, 0, "user", "alone"), (3, 0, "system", "nobody else")]
    schema = "conv_id int, turn int, role string, text string"
    found = perspectives.examples(spark.createDataFrame(rows, schema)).collect()
    assert {(r["conv_id"], r["perspective"], r["part"]) for r in found} == {
        *((1, side, 0) for side in ("user", "assistant", "unknown")), (2, "user", 0), (None, "user", 0), (3, None, 0)}
    for r in found:
        trained = [r["rendered"][s["start"]:s["end"]] for s in r["mask"]]
        if r["perspective"] == "user" and r["conv_id"] == 1:
            assert trained == ["hi<|end|>\n"] and "<|start|>user name=assistant\n" in r["rendered"]
        assert "".join(trained).count("<|end|>") == r["rendered"].count("<|start|>assistant\n")
    assert next(r for r in found if r["conv_id"] == 2)["n_messages"] == 2
    assert perspectives.examples(spark.createDataFrame([], schema)).count() == 0


def test_long_dialogues_are_shown_part_by_part(spark):
    """Parts by number of messages, not by turn: each shows the system message and what came just before."""
    rows = [(1, 0, "system", "be kind", "x")] + [(1, k, ("user", "assistant")[k % 2], f"m{k:03}", "x") for k in range(1, 200)]
    rows += [(2, 5, "user", f"same turn {k:03}", "x") for k in range(130)] + [(3, 1, "user", "long " * 50_000, "x")]
    rows += [(None, None, None, f"n{k:03}", None) for k in range(70)]
    docs = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, part string").repartition(3)
    found = {(r["conv_id"], r["perspective"], r["part"]): r for r in perspectives.examples(docs).collect()}
    assert {k for k in found} == {
        *((1, side, part) for side in ("user", "assistant") for part in range(4)), *((2, "user", part) for part in range(3)),
        (3, "user", 0), (None, "unknown", 0), (None, "unknown", 1)}
    for part in range(4):
        r = found[1, "assistant", part]
        assert r["rendered"].startswith("<|start|>system\nbe kind<|end|>\n") and r["rendered"].count("be kind") == 1
        shown = re.findall("m([0-9]{3})<", r["rendered"])
        assert shown == [f"{k:03}" for k in range(max(1, 64 * part - 8), min(200, 64 * part + 64))]
        trained = [r["rendered"][s["start"]:s["end"]] for s in r["mask"]]
        assert trained == [f"m{k:03}<|end|>\n" for k in range(max(1, 64 * part), min(200, 64 * part + 64)) if k % 2]
        assert r["n_messages"] == len(shown) + 1
    assert [found[2, "user", part]["n_messages"] for part in range(3)] == [64, 72, 10]
    assert found[None, "unknown", 1]["n_messages"] == 14 and len(found[None, "unknown", 1]["mask"]) == 6


def test_archive_blocks_are_read_by_many_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 2000)
    schema = "page_id int, url string, html string, `value` string, path string, size int"
    pages = spark.createDataFrame([(k, "u", f"{k} " * 200, "v", "p", 1) for k in range(400)], schema).repartition(3)
    warc.write_archives(pages, f"{tmp_path}/archives")
    dealt, tasks = warc.blocks(spark, f"{tmp_path}/archives")
    assert tasks == dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    read = warc.read_archives(spark, f"{tmp_path}/archives")
    assert read.rdd.getNumPartitions() == tasks
    assert sorted((r["page_id"], r["payload"]) for r in read.collect()) == sorted((k, f"{k} " * 200) for k in range(400))
    busy = read.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in busy) > tasks // 2


def test_payloads_full_of_magic(spark):
    magic = "WARC/1.0\r\n"
    rows = [(1, "u", magic * 20_000), (2, "u", (magic + "a: b\r\n") * 5000), (3, "u", magic + "Content-Length: 1\r\n\r\n" + "x" * 50)]
    found = warc.round_trip(spark.createDataFrame(rows, "page_id int, url string, html string"), payloads=True).collect()
    assert sorted((r["page_id"], r["payload"]) for r in found) == [(i, h) for i, _, h in rows]


def test_url_entropy_of_whole_urls(spark):
    rng = np.random.default_rng(4)
    urls = ["", None, "aaaa", "abab", "http://x.y/" + "q" * 5000 + "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 5000))), "\U0001f600é\U0001f600"]
    found = [r[0] for r in spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").orderBy("k").select(
        url_filter._entropy(F.coalesce("u", F.lit("")))).collect()]
    for url, got in zip(urls, found):
        counts = np.unique(list(url or " "), return_counts=True)[1] if url else np.array([1])
        share = counts / counts.sum()
        assert abs(got - float(-(share * np.log2(share)).sum())) < 1e-9


def test_url_samples_hold_no_more_of_a_hot_url_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SAMPLE", 100)
    rows = [(k, "http://hot.com/de/", 1, 2, 3) for k in range(300)] + [(1000 + k, f"http://x{k}.org/{k}", 1, 2, 3) for k in range(300)]
    rows += [(None, None, None, None, None), (5, "http://far.net/" + "p" * 3000, 1, 2, 3), (5, "http://far.net/" + "p" * 3000, 1, 2, 3)]
    found = url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, label int, score int, features int")).collect()
    assert len(found) == len(rows) and all(r["score"] is not None for r in found)      # labels of both kinds are in the sample


def test_null_documents_do_not_clash(docs):
    assert docs.where(F.col("doc_id").isNull()).count() == 1
