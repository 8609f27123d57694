"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are kept whenever their rule holds. Further kinds (iban, ssn, routing) are
kept when their score, raised by a checksum and by words such as "account" nearby, reaches ``MIN_SCORE``.

Edge cases: a null or empty text has no spans; offsets are code points, end exclusive; spans of different kinds may
overlap; null ids and repeated rows pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing")
BASE = KINDS[:4]
MIN_SCORE = 0.6
CONTEXT_CHARS = 48

# Prior score of a proposal that passed its check, and the words that raise it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "routing": 0.3}
CONTEXT = {
    "email": "email mail e-mail contact",
    "ip": "ip address host server",
    "card": "card visa mastercard amex credit debit payment",
    "phone": "phone tel telephone call mobile fax",
    "iban": "iban bank account transfer konto cuenta compte",
    "ssn": "ssn social security taxpayer",
    "routing": "routing aba bank account",
}
CONTEXT_WORDS = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v.split())) + r")\b", re.IGNORECASE) for k, v in CONTEXT.items()}
RAISE = 0.3

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, and only end where one ends.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", re.ASCII)
SSN = re.compile(r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b", re.ASCII)
ROUTING = re.compile(r"\b[0-9]{9}\b", re.ASCII)
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def aba(digits: str) -> bool:
    return sum(int(d) * (3, 7, 1)[k % 3] for k, d in enumerate(digits)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards: linear even on long runs without one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and checksum hold."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(n) <= 3 and int(n or 0) <= 255 for n in (part.lstrip("0") for part in m.group().split("."))):
                yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        yield "ssn", *m.span()
    for m in ROUTING.finditer(text):
        if aba(m.group()):
            yield "routing", *m.span()


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind as listed in ``KINDS``, then start."""
    found = []
    for kind, start, end in _proposals(text or ""):
        near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        score = min(1.0, PRIOR[kind] + RAISE * bool(CONTEXT_WORDS[kind].search(near)))
        if kind in BASE or score >= MIN_SCORE:
            found.append((kind, start, end, score))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
SPANS_SQL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, spans``: the spans of every document, with scores. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, SPANS)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, spans {SPANS_SQL}")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the checksum of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    counts = [of_kind(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select(id_col, *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if text is None:
        return None
    out, at, end = [], 0, 0
    for kind, start, stop, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= end:
            out += [text[at:start], f"[{kind.upper()}]"]
        end = at = max(end, stop)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; the length column follows where there is one."""
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            old = b.column(at).to_pylist()
            new = [redacted(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length_at is not None:
                given = columns[length_at].to_pylist()
                columns[length_at] = pa.array([n if x == y else len(y) for n, x, y in zip(given, old, new)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(clean, docs.schema)
