"""Text and label expressions. Everything here is a plain Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------------------
# Whitespace as Python's str.strip sees it: Unicode White_Space plus U+001C..U+001F.
WHITESPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Words that name an action: two letters or more before -ando, -endo, -iendo or English -ing.
# The word is taken whole and its end checked once, which spares backtracking over every word.
ACTION_WORD = r"\b(\p{L}{2,}+(?<=\p{L}{2}(?:ing|ando|endo)))\b"
# A code starts with a gerund, which may carry enclitic pronouns ("Sintiéndose perdido").
GERUND_START = r"(?iu)^\p{L}*(?:ando|endo|iendo|ándo|éndo|iéndo)(?:me|te|se|nos|os|la|las|le|les|lo|los)*\b"
GERUND_START_EN = r"(?iu)^\p{L}{2,}ing\b"
IN_VIVO = r'(?s)^\[in vivo\] ".+"$'
MAX_CODES = 3
# ------------------------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only knows spaces); looks at the ends alone, not at every space."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def or_default(c: Column, default: str | Column) -> Column:
    """``c``, or the default where it is null or empty."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c, F.lit("")), default)


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def section(title: Column, text: Column) -> Column:
    return F.concat(F.lit("**"), title, F.lit("**\n\n"), text)


def code_id(label: Column) -> Column:
    """Repeatable id from the label's content, so a rerun produces the same codebook."""
    return F.concat(F.lit("code_"), F.substring(F.sha2(label, 256), 1, 32))


def action_labels(text: Column, max_codes: int = MAX_CODES) -> Column:
    """Rule-based open coding: the first distinct action words of a text, in text order."""
    found = F.regexp_extract_all(text, F.lit(ACTION_WORD), F.lit(1))
    return F.slice(F.array_distinct(found), 1, max_codes)


def labels_of(codes: Column) -> Column:
    """The usable labels of a code list: stripped, blank and null ones removed, order kept."""
    return F.filter(F.transform(codes, strip), lambda x: x.isNotNull() & (x != ""))


def is_action_code(code: Column, english: bool = True) -> Column:
    ok = code.rlike(GERUND_START) | code.rlike(IN_VIVO)
    return ok | code.rlike(GERUND_START_EN) if english else ok


def code_violations(codes: Column, max_codes: int = MAX_CODES, english: bool = True) -> Column:
    """Array of ``struct<pos, code, rule>``, one element per broken coding rule."""
    spec = "array<struct<pos:bigint,code:string,rule:string>>"
    shaped = F.filter(
        F.transform(
            codes,
            lambda x, i: F.struct(
                i.cast("bigint").alias("pos"),
                x.alias("code"),
                F.when(x.isNull(), "null_code").when(~is_action_code(x, english), "not_a_gerund").alias("rule"),
            ),
        ),
        lambda s: s["rule"].isNotNull(),
    ).cast(spec)
    too_many = F.when(
        F.size(codes) > max_codes,
        F.array(F.struct(F.size(codes).cast("bigint"), F.lit(None).cast("string"), F.lit("too_many_codes"))).cast(spec),
    ).otherwise(F.array().cast(spec))
    return F.coalesce(F.concat(shaped, too_many), F.array().cast(spec))


def to_json(c: Column) -> Column:
    """JSON text of a struct, array or map with null fields kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def json_scalar(c: Column) -> Column:
    """JSON text of one scalar: quoted and escaped, ``null`` for null."""
    wrapped = to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def indented_object(fields: dict[str, Column], indent: int = 2, level: int = 0) -> Column:
    """A JSON object laid out with indentation; the values are JSON texts already."""
    pad, end = " " * (indent * (level + 1)), " " * (indent * level)
    parts: list[Column] = []
    for n, (key, value) in enumerate(fields.items()):
        parts += [F.lit(("{\n" if n == 0 else ",\n") + f'{pad}"{key}": '), value]
    return F.concat(*parts, F.lit(f"\n{end}}}"))


def indented_list(items: Column, indent: int = 2) -> Column:
    """A JSON list laid out with indentation; the items are JSON texts of that level."""
    pad = " " * indent
    body = F.concat(F.lit(f"[\n{pad}"), F.array_join(items, f",\n{pad}"), F.lit("\n]"))
    return F.when(F.size(items) == 0, F.lit("[]")).otherwise(body)
