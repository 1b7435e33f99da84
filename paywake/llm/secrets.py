"""Secrets: patterns propose candidates, and who holds a value tells copied examples from live credentials.

DataFrame functions alone: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import Scratch

BLOCK = 64          # matches that share a partial sum
OWNERS = 2          # a value with more owners is a copied example
SPREAD = 6          # distinct characters of a value that looks live, at least
HOT = 1000          # a value with more than 1 / HOT of all candidates is looked up by itself


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = ("assign", "access", "hex")

#: Pattern by kind, the base kinds first. A match cannot be extended or moved to mend a failing check, so the least
#: lengths of access and hex stand in their patterns; each is decided within a bounded number of characters.
PATTERNS = {
    "assign": _ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "provider": r"(gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|glpat-|npm_|AIza|SG\.)[A-Za-z0-9_-]{20,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,400}\.eyJ[A-Za-z0-9_-]{10,}",
    "private": r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----[\x20\t\r\n]{1,4}[A-Za-z0-9+/=]{16,}",
    "random": r"[A-Za-z0-9+/_-]{32,}",
}
KINDS = tuple(PATTERNS)
#: A value that has one of these is no credential, however rare it is.
PLACEHOLDER = r"example|sample|dummy|changeme|placeholder|redacted|xxxx|your_|my_|\*\*\*"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where each match begins, from what stands before each and their lengths.

    Sums over blocks come first, so the time is linear for texts of some thousand matches and grows with the power
    of 1.5 beyond; array functions have no running sum.
    """
    steps = F.zip_with(gaps, lengths, lambda g, n: g + n)

    def from_steps(steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))
        return _let(sums, lambda sums: _let(
            F.transform(blocks, lambda b: _total(F.slice(sums, 1, b))),
            lambda before: F.transform(gaps, lambda g, i: g + F.get(before, F.floor(i / BLOCK).cast("int")) + _total(
                F.slice(steps, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))

    return _let(steps, from_steps)


def _found(text: Column, kind: str) -> Column:
    """Array of (start, kind_no, end, value) of the matches of one kind, leftmost and non-overlapping."""
    pattern, no = PATTERNS[kind], KINDS.index(kind)
    nothing = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,value:string>>")

    def placed(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda s: F.char_length(s).cast("bigint"))
        lengths = F.transform(matches, lambda m: F.char_length(m).cast("bigint"))
        starts = _let(gaps, lambda gaps: _let(lengths, lambda lengths: _starts(gaps, lengths)))
        value = (lambda m: F.regexp_extract(m, pattern, 2)) if kind == "assign" else (lambda m: m)
        spans = F.zip_with(matches, starts, lambda m, start: F.struct(
            start.alias("start"), F.lit(no).alias("kind_no"), (start + F.char_length(m)).alias("end"), value(m).alias("value")))
        if kind == "assign":
            spans = F.filter(spans, lambda s: F.char_length(s["value"]) >= 6)
        if kind == "random":
            spans = F.filter(spans, lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
                             & (_characters(s["value"]) >= 16))
        return spans

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                lambda m: F.when(F.size(m) == 0, nothing).otherwise(placed(m)))


def _characters(value: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))


def candidates(docs: DataFrame, repository: str = "doc_id", owner: str = "source", doc: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(doc_id, owner, repository, spans) of every whole text: the proposed spans, values as SHA-256 only.

    spans: array of (start, kind_no, end, hash, plausible), by start and kind; start and end in code points.
    """
    plain = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
                        F.col(repository).cast("string").alias("repository"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = plain.select("doc_id", "owner", "repository", F.concat(*(_found(F.col("text"), kind) for kind in KINDS)).alias("found"))
    return found.select("doc_id", "owner", "repository", F.transform(F.array_sort("found"), lambda s: F.struct(
        s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"),
        F.unhex(F.sha2(F.encode(s["value"], "UTF-8"), 256)).alias("hash"),
        ((_characters(s["value"]) >= SPREAD) & ~F.lower(s["value"]).rlike(PLACEHOLDER)).alias("plausible"))).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, uses) over exploded candidates: who holds each value.

    Three aggregations, each combined before its shuffle: a value that a third of all rows hold arrives as one row
    per map task. A repository is named by its owner and itself; a missing name counts as a name.
    """
    held = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("uses"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"),
                                        F.sum("uses").alias("uses"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", doc: str = "doc_id",
                 text: str = "text", max_owners: int = OWNERS) -> DataFrame:
    """doc_id and spans: array of (start, kind_no, end, owners, repositories, live), by start and kind, over whole texts.

    `live`: at most `max_owners` owners in the whole corpus hold the value, and it looks like a credential; values
    that more owners hold are copied examples. kind_no is a place in KINDS. One row per row of docs: repeated rows
    come back as often as given, null and empty texts have no spans, a null doc_id stays null, a null owner or
    repository counts as one of that name, no rows give no rows, other columns are ignored.

    A value with more than 1 / HOT of all candidates is looked up by a broadcast join: there are fewer than HOT of
    them at any size. The others meet their counts in a shuffle, where none can be hot.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.keep(candidates(docs, repository, owner, doc, text).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.where(F.size("spans") > 0).select("row", "doc_id", "owner", "repository", F.inline("spans"))
    held = scratch.keep(ownership(each), "ownership")
    total = held.agg(F.sum("uses")).first()[0] or 0
    hot = F.col("uses") * HOT > total
    place = ["row", "doc_id", "start", "kind_no", "end", "plausible"]
    counts = ["owners", "repositories"]
    known = held.where(hot).select("hash", *counts)
    looked = each.select(*place, "hash").join(F.broadcast(known), "hash", "left")
    rest = looked.where("owners is null").drop(*counts).join(held.where(~hot).select("hash", *counts), "hash")
    judged = looked.where("owners is not null").select(*place, *counts).unionByName(rest.select(*place, *counts))
    span = F.struct("start", "kind_no", "end", "owners", "repositories",
                    (F.col("plausible") & (F.col("owners") <= max_owners)).alias("live"))
    grouped = judged.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).select("doc_id", "spans")
    none = F.array().cast(grouped.schema["spans"].dataType)
    return grouped.unionByName(rows.where(F.size("spans") == 0).select("doc_id", none.alias("spans")))


def number(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind))).cast("bigint")


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind_no"] < len(BASE))


def reported(spans: Column) -> Column:
    """Base spans and the live ones of the further kinds."""
    return F.filter(spans, lambda s: (s["kind_no"] < len(BASE)) | s["live"])
