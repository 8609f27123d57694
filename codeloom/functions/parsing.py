"""Finding and strictly parsing the JSON block inside a free-text response."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the block is a fenced ```json object or array, else the widest bare one.
JSON_BLOCK = r"(?sU)```json[\s\x1c-\x1f]*(\{.*\}|\[.*\])[\s\x1c-\x1f]*```|(\{.*\}|\[.*\])"

OK, NO_JSON, UNPARSABLE, EMPTY = "ok", "no_json", "unparsable", "empty_json"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is worked out one time, however often it is used; :func:`computed` does that for columns."""
    return F.transform(F.array(value), use)[0]


def json_block(text: Column) -> Column:
    """The JSON-looking part of a text, or null."""
    fenced, bare = F.regexp_extract(text, JSON_BLOCK, 1), F.regexp_extract(text, JSON_BLOCK, 2)
    return once(fenced, lambda f: F.when(f != "", f).otherwise(once(bare, lambda b: F.when(b != "", b))))


def parse_strict(block: Column) -> Column:
    """Parse exactly one JSON value, null otherwise.

    ``try_parse_json`` alone ignores what follows the first value; inside brackets such a
    tail either breaks the syntax or makes a second element.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
    return once(wrapped, lambda w: F.when(F.size(F.try_variant_get(w, "$", "array<variant>")) == 1, F.try_variant_get(w, "$[0]", "variant")))


def is_empty_value(value: Column) -> Column:
    """True for values that count as nothing: ``{}``, ``[]``, ``null``."""
    return F.coalesce(
        F.is_variant_null(value)
        | (F.size(F.try_variant_get(value, "$", "array<variant>")) == 0)
        | (F.size(F.try_variant_get(value, "$", "map<string,variant>")) == 0),
        F.lit(False),
    )


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out exactly once per row.

    A plain ``withColumn`` is inlined wherever the column is used, filters included, which
    repeats costly parsing many times over. Generated columns are not.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_parsed(df: DataFrame, response: str) -> DataFrame:
    """Add ``block`` (string), ``value`` (variant) and ``status`` to a table of responses."""
    out = computed(df, block=json_block(F.col(response)))
    out = computed(out, value=parse_strict(F.col("block")))
    status = (
        F.when(F.col("block").isNull(), NO_JSON)
        .when(F.col("value").isNull(), UNPARSABLE)
        .when(is_empty_value(F.col("value")), EMPTY)
        .otherwise(OK)
    )
    return computed(out, status=status)
