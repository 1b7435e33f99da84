"""I-Match document fingerprints, by DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paywake.llm.store import Scratch

LOWEST, HIGHEST = 0.001, 0.01   # shares of the documents that a lexicon term is in: idf from 4.6 to 6.9
#: Of every 1024 lexicon terms, how many each randomised lexicon draws: the first hold most of the band and change with
#: any edit that touches it, the last outlast large edits.
DRAWN = (*[900] * 8, *[768] * 8, *[256] * 16, *[64] * 16, *[16] * 16)
NO_TERMS = "-"                  # fingerprint of a text without terms in the band
CELLS = 16_384                  # of the lookup table of the lexicon
RANGES = 4096                   # of doc_id in which neighbours are looked up, at most


def terms(text: Column) -> Column:
    """Hashes of the distinct words, in any order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(cells): one row, an array of CELLS arrays with the terms whose document frequency lies in the band.

    A term is in at least LOWEST of all documents, so there are at most (distinct terms per document) / LOWEST:
    some 300,000 for documents of 300 distinct words, however many documents there are. Below 1,000 documents the
    band is that of 2 to 8 documents, as a share of fewer would be that of single ones.
    """
    n = docs.count()
    lowest, highest = max(2, math.ceil(LOWEST * n)), max(8, math.floor(HIGHEST * n))
    listed = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("documents"))
    band = listed.where(F.col("documents").between(lowest, highest))
    cells = band.groupBy(F.pmod("term", F.lit(CELLS)).alias("cell")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = docs.sparkSession.range(CELLS).select(F.col("id").alias("cell"))
    filled = every.join(cells, "cell", "left").select(
        F.struct("cell", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")).alias("c"))
    return scratch.keep(filled.agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["terms"]).alias("cells")), "lexicon")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def with_fingerprint(docs: DataFrame, text: str, name: str, lexicon_: DataFrame) -> DataFrame:
    """docs with `name`: array of (lexicon << 16 | 16 bits of hash), one for each lexicon that has terms of the text.

    The distinct terms in the band are sorted. Each randomised lexicon is a draw of its own from the band, by a hash of
    term and lexicon; the terms of the text that are in it are hashed together, in order. A text without terms in the
    band has no hashes.
    """
    columns, t = docs.columns, F.col(text)
    found = docs.withColumn("_found", terms(t))
    # the optimizer makes the table an argument of the function that reads it, so that no row carries a copy of it
    looked = found.select(*columns, "_found", F.array_repeat(lexicon_.scalar(), F.size("_found")).alias("_table"))
    banded = looked.select(*columns, F.array_sort(F.array_compact(F.zip_with("_found", "_table", lambda h, cells: F.when(
        F.array_contains(F.element_at(cells, (F.pmod(h, F.lit(CELLS)) + 1).cast("int")), h), h)))).alias("_band"))
    draws = F.array(*(F.struct(F.lit(no).alias("no"), F.lit(drawn).alias("drawn")) for no, drawn in enumerate(DRAWN)))

    def hashed(band: Column) -> Column:
        def one(draw: Column) -> Column:
            held = F.filter(band, lambda term: F.pmod(F.xxhash64(term, draw["no"]), F.lit(1024)) < draw["drawn"])
            return _let(held, lambda held: F.when(F.size(held) > 0, F.shiftleft(draw["no"], 16).bitwiseOR(
                F.xxhash64(held).bitwiseAND(F.lit(0xFFFF)).cast("int"))))

        return F.array_compact(F.transform(draws, one))

    none = F.array().cast("array<int>")
    return banded.select(*columns, _let(F.col("_band"), lambda band: F.when(F.size(band) == 0, none).otherwise(hashed(band))).alias(name))


def likeness(a: str | Column, b: str | Column, same: Column) -> Column:
    """Equal hashes by lexicons that have terms of either text; where none has, 1 if the texts are the same, else 0."""
    def lexicons(x: str | Column) -> Column:
        return F.transform(x, lambda h: F.shiftright(h, 16))

    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    common = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(lexicons(a), lexicons(b)))
    return F.when(either == 0, F.coalesce(same, F.lit(False)).cast("double")).otherwise(common / either)


def text_form(hashes: str, text: str | Column) -> Column:
    """Six hexadecimal digits for each lexicon's hash; NO_TERMS without any, and nothing for an empty text."""
    digits = F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 6, "0")), ""))
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text == "", "").when(F.size(hashes) == 0, NO_TERMS).otherwise(digits)


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text; equal texts have equal ones.

    Null is an empty text with an empty fingerprint; a text without lexicon terms has NO_TERMS. Repeated rows come back as often as given, a null doc_id stays
    null, no rows give no rows, other columns are ignored.
    """
    docs = _plain(docs, doc, text)
    found = with_fingerprint(docs, "text", "hashes", lexicon(docs, Scratch(docs.sparkSession, "imatch")))
    return found.select("doc_id", text_form("hashes", "text").alias("fingerprint"))


def _plain(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _dealt(docs: DataFrame) -> DataFrame:
    """docs in ranges of doc_id with columns `part` and `ahead`.

    The bounds are doc_ids themselves, at most RANGES of them. The row at a range's upper bound appears again, with
    `ahead`, in the range above, where it is the next of the lowest row; that of the last range appears in the first.
    """
    n = docs.count()
    parts = max(1, min(RANGES, math.ceil(n / 16)))
    shares = [k / parts for k in range(1, parts + 1)]
    bounds, greatest = docs.agg(F.percentile_approx("doc_id", shares, 10 * RANGES), F.max("doc_id")).first()
    bounds = sorted({*(bounds or []), *([] if greatest is None else [greatest])}) or [0]
    groups = [bounds[k:k + 64] for k in range(0, len(bounds), 64)]
    group = F.size(F.filter(_numbers([g[-1] for g in groups]), lambda b: b < F.col("doc_id")))
    own = F.get(F.array(*map(_numbers, groups)), F.col("_group"))
    below = F.size(F.filter("_own", lambda b: b < F.col("doc_id")))
    part = F.col("_group") * 64 + F.col("_below")
    at_bound = F.array_contains("_own", F.col("doc_id"))
    here = F.struct(part.cast("bigint").alias("part"), F.lit(False).alias("ahead"))
    above = F.struct(((part + 1) % len(bounds)).cast("bigint").alias("part"), F.lit(True).alias("ahead"))
    apart = F.struct((-1 - F.pmod(F.xxhash64(*docs.columns), F.lit(RANGES))).alias("part"), F.lit(False).alias("ahead"))
    copies = F.when(F.col("doc_id").isNull(), F.array(apart)).when(at_bound, F.array(here, above)).otherwise(F.array(here))
    return (docs.withColumn("_group", group).withColumn("_own", own).withColumn("_below", below)
            .select(*docs.columns, F.inline(copies)))


def edited_fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    Edited: the last floor(n_chars / 2) characters replaced by the first as many of the next document, by descending
    doc_id, after the last the first. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Texts move once, into ranges of doc_id that are sorted each by itself. Null is an empty
    text. Among rows that repeat a doc_id the order is that of the texts. Rows without doc_id stand apart: they have
    no next document, so nothing replaces their second half, and near_next is 0. No rows give no rows; a single
    document is its own next. Other columns are ignored.
    """
    docs = _plain(docs, doc, text)
    found = lexicon(docs, Scratch(docs.sparkSession, "imatch"))
    hashed = with_fingerprint(docs, "text", "hashes", found)
    order = Window.partitionBy("part").orderBy("ahead", F.desc("doc_id"), "text")
    following = F.when(F.col("doc_id").isNotNull(), F.lead(F.struct("text", "hashes")).over(order))
    paired = _dealt(hashed).withColumn("following", following).where("not ahead")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"),
                      F.coalesce(F.substring(F.col("following.text"), F.lit(1), half), F.lit("")))
    rows = paired.select("doc_id", n.cast("bigint").alias("n_chars"), "hashes", (F.col("text") == "").alias("empty"),
                         edited.alias("edited"), (edited == F.col("text")).alias("unedited"),
                         F.col("following.hashes").alias("next_hashes"),
                         F.col("text").eqNullSafe(F.col("following.text")).alias("next_equal"))
    rows = with_fingerprint(rows, "edited", "edited_hashes", found)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text_form("hashes", F.when(F.col("empty"), "").otherwise("x")).alias("fingerprint"),
        text_form("edited_hashes", "edited").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes", F.col("unedited")).alias("near_edited"),
        F.when(F.col("next_hashes").isNull(), 0.0).otherwise(likeness("hashes", "next_hashes", F.col("next_equal"))).alias("near_next"))
