"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywake.llm.store import released
from paywake.llm.words import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
NEAR = 40               # characters before and after a span in which context words count
MINIMUM = 0.5           # score from which a span of the further kinds is reported

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match cannot begin inside a run of digits, and giving digits back never helps: possessive, so linear
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Characters of an account number by country.
LENGTH = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}

#: Words that raise the score of a kind, and words that lower the score of any.
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"), "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "build", "example", "isbn", "serial", "order")
#: Score by the pattern, and by the checksum where there is one, before context.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}


def luhn(digits: str) -> bool:
    """The Luhn check of payment card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: the country and check digits moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from their @, as long runs of letters without one would make the pattern slow."""
    after = 0
    if "@" in text:
        for found in _AT.finditer(text):
            start = found.start()
            while start > after and text[start - 1] in _LOCAL:
                start -= 1
            if start < found.start():
                after = found.end()
                yield start, after


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """At the length of the country; where none is known, the longest that the checksum confirms.

    The pattern also runs on into capital words and numbers behind, so each end is tried at a word's end only.
    """
    after = 0
    for found in _IBAN.finditer(text):
        if found.start() < after:
            continue
        places = [at for at in range(*found.span(1)) if text[at] != " "]
        length = LENGTH.get(found[1][:2])
        for n in (length,) if length else range(len(places), 14, -1):
            if n > len(places):
                continue
            end = places[n - 1] + 1
            open_end = end < len(text) and text[end].isascii() and text[end].isalnum()
            if not open_end and mod97(text[found.start():end].replace(" ", "")):
                after = end
                yield found.start(), end
                break


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and checksum hold."""
    for start, end in _emails(text):
        yield "email", start, end
    if not re.search("[0-9]", text):
        return
    for found in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in found[0].split(".")):
            yield "ip", *found.span()
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 16:
            digits = _NOT_DIGIT.sub("", found[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", *found.span()
    for found in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", found[0])) <= 15:
            yield "phone", *found.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for found in _SSN.finditer(text):
        yield "ssn", *found.span()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind and start. Base kinds stay at any score."""
    found = []
    for kind, start, end in _proposed(text or ""):
        words = set(re.findall("[a-z]+", f"{text[max(0, start - NEAR):start]} {text[end:end + NEAR]}".lower()))
        score = SCORE[kind] + 0.2 * bool(words & set(CONTEXT[kind])) - 0.3 * bool(words & set(AGAINST))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE or score >= MINIMUM:
            found.append((kind, start, end, score))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans (array of kind, start, end, score), over whole texts; null and empty texts have none.

    Rows are judged one by one: repeated rows come back as often as given, a null doc_id stays null, no rows give
    no rows, and other columns are ignored. Every pattern takes time in proportion to the text.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "spans": pa.array(found, kind)})

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        rows, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redacted(text: str) -> str:
    """The text with each span, overlapping ones together, replaced by the kind of its first."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with the personal data in `text` replaced; null stays null."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            k = batch.schema.get_field_index(text)
            clean = pa.array([None if t is None else redacted(t) for t in batch.column(k).to_pylist()], pa.string())
            yield batch.set_column(k, pa.field(text, pa.string()), clean)

    return docs.mapInArrow(lambda batches: released(rows(batches)), docs.schema)


def base_digest(found: F.Column) -> F.Column:
    """kind:start:end of the base spans, comma-joined."""
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return F.array_join(F.transform(base, _written), ",")


def number(found: F.Column, kind: str) -> F.Column:
    """How many spans are of a kind."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def all_spans(found: F.Column) -> F.Column:
    return F.array_join(F.transform(found, _written), ",")


def _written(s: F.Column) -> F.Column:
    return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
