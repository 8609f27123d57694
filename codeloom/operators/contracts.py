"""Strict contracts for parsed values: every row ends up valid or rejected with the paths at fault.

A contract is a small tree of type nodes. Each node turns a Variant column into an array of
error strings (``path:problem``); nothing raises per row. Types are checked on the Variant
before any cast, since a cast would quietly make ``'5'`` of 5 and null of a bad list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import parsing

_NO_ERRORS = "array<string>"

# The texts that count as a boolean, lower case.
TRUE_TEXTS = ["1", "on", "t", "true", "y", "yes"]
FALSE_TEXTS = ["0", "off", "f", "false", "n", "no"]
INTEGER_TEXT = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


class Split(NamedTuple):
    valid: DataFrame
    rejects: DataFrame


def _none() -> Column:
    return F.array().cast(_NO_ERRORS)


def _error(path: Column, problem: str) -> Column:
    return F.array(F.concat(path, F.lit(":" + problem)))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_whole(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return number == F.floor(number)


@dataclass(frozen=True)
class Scalar:
    """A leaf: ``accepts`` says whether a present value is of the type, ``sql_type`` is the cast."""

    sql_type: str
    accepts: Callable[[Column], Column]

    def errors(self, value: Column, path: Column) -> Column:
        return F.when(F.coalesce(self.accepts(value), F.lit(False)), _none()).otherwise(_error(path, "type"))


@dataclass(frozen=True)
class ListOf:
    item: "Scalar | Record | ListOf"

    @property
    def sql_type(self) -> str:
        return f"array<{self.item.sql_type}>"

    def errors(self, value: Column, path: Column) -> Column:
        items = F.try_variant_get(value, "$", "array<variant>")
        inner = F.transform(
            items,
            lambda x, i: self.item.errors(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))),
        )
        return F.when(items.isNull(), _error(path, "type")).otherwise(F.flatten(inner))


@dataclass(frozen=True)
class Key:
    """One key of a record. A missing key is an error only if required; an explicit null only if not nullable."""

    kind: "Scalar | Record | ListOf"
    required: bool = True
    nullable: bool = False
    default: str | None = None  # SQL literal used where the key is missing


@dataclass(frozen=True)
class Record:
    keys: dict[str, Key]

    @property
    def sql_type(self) -> str:
        return "struct<" + ",".join(f"{k}:{v.kind.sql_type}" for k, v in self.keys.items()) + ">"

    def errors(self, value: Column, path: Column) -> Column:
        is_object = F.coalesce(_kind(value).startswith("OBJECT<"), F.lit(False))
        found = []
        for name, key in self.keys.items():
            here = F.concat(path, F.lit(f".{name}"))
            v = F.try_variant_get(value, f"$.{name}", "variant")
            problem = F.when(v.isNull(), _error(here, "missing") if key.required else _none())
            null_case = _none() if key.nullable else _error(here, "null")
            problem = problem.when(F.is_variant_null(v), null_case)
            found.append(problem.otherwise(key.kind.errors(v, here)))
        return F.when(is_object, F.flatten(F.array(*found))).otherwise(_error(path, "type"))

    def columns(self, value: Column) -> dict[str, Column]:
        """Typed top-level columns of a value that passed :meth:`errors`."""
        out = {}
        for name, key in self.keys.items():
            raw = F.try_variant_get(value, f"$.{name}", "variant")
            typed = F.try_variant_get(value, f"$.{name}", key.kind.sql_type)
            if isinstance(key.kind, Scalar) and key.kind.sql_type == "boolean":
                typed = _as_boolean(raw)
            elif isinstance(key.kind, Scalar) and key.kind.sql_type == "bigint":
                typed = F.try_variant_get(raw, "$", "double").cast("bigint")
                text = F.trim(F.regexp_replace(F.try_variant_get(raw, "$", "string"), r"\.0*\s*$", ""))
                typed = F.when(_kind(raw) == "BIGINT", F.try_variant_get(raw, "$", "bigint")).when(
                    _kind(raw) == "STRING", text.try_cast("bigint")
                ).otherwise(typed)
            if key.default is not None:
                typed = F.when(raw.isNull(), F.expr(key.default)).otherwise(typed)
            out[name] = typed
        return out


def _numeric_kind(value: Column) -> Column:
    return _kind(value).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _accepts_boolean(v: Column) -> Column:
    text = F.lower(F.try_variant_get(v, "$", "string"))
    return (
        (_kind(v) == "BOOLEAN")
        | ((_kind(v) == "STRING") & text.isin(TRUE_TEXTS + FALSE_TEXTS))
        | (_numeric_kind(v) & F.try_variant_get(v, "$", "double").isin(0.0, 1.0))
    )


def _as_boolean(v: Column) -> Column:
    text = F.lower(F.try_variant_get(v, "$", "string"))
    return (
        F.when(_kind(v) == "STRING", text.isin(TRUE_TEXTS))
        .when(_numeric_kind(v), F.try_variant_get(v, "$", "double") == 1.0)
        .otherwise(F.try_variant_get(v, "$", "boolean"))
    )


TEXT = Scalar("string", lambda v: _kind(v) == "STRING")
BOOLEAN = Scalar("boolean", _accepts_boolean)
INTEGER = Scalar(
    "bigint",
    lambda v: (_kind(v) == "BOOLEAN")
    | (_numeric_kind(v) & _is_whole(v))
    | ((_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(INTEGER_TEXT)),
)
NUMBER = Scalar(
    "double",
    lambda v: (_kind(v) == "BOOLEAN")
    | _numeric_kind(v)
    | ((_kind(v) == "STRING") & F.try_variant_get(v, "$", "string").rlike(NUMBER_TEXT)),
)

_EMPTY_TEXTS = "cast(array() as array<string>)"

# The record shapes exchanged between the phases ------------------------------
ASSIGNMENT = Record({"code_id": Key(TEXT)})
CODING_RESULT = Record(
    {
        "id_fragmento": Key(TEXT),
        "fragmento_original": Key(TEXT),
        "codigos_abiertos": Key(ListOf(TEXT)),
        "error": Key(TEXT, required=False, nullable=True),
    }
)
_ASSIGNMENTS = Key(
    ListOf(ASSIGNMENT), required=False, default="cast(array() as array<struct<code_id:string>>)"
)
CATEGORY_RESULT = Record(
    {
        "category_name": Key(TEXT),
        "is_new": Key(BOOLEAN),
        "description": Key(TEXT),
        "code_assignments": _ASSIGNMENTS,
    }
)
CATEGORY = Record(
    {
        "category_id": Key(TEXT),
        "category_name": Key(TEXT),
        "description": Key(TEXT, required=False, nullable=True),
        "code_assignments": _ASSIGNMENTS,
    }
)
CODE = Record(
    {
        "id": Key(TEXT),
        "label": Key(TEXT),
        "description": Key(TEXT, required=False, nullable=True),
        "embedding": Key(ListOf(NUMBER), required=False, nullable=True),
        "count": Key(INTEGER, required=False, nullable=True, default="1L"),
    }
)
CODEBOOK = Record({"codes": Key(ListOf(CODE))})
INSIGHT = Record(
    {
        "id_fragmento": Key(TEXT),
        "fragmento_original": Key(TEXT),
        "unified_code_ids": Key(ListOf(TEXT), required=False, default=_EMPTY_TEXTS),
        "context": Key(TEXT, required=False, nullable=True),
        "intervening_conditions": Key(TEXT, required=False, nullable=True),
        "consequences": Key(TEXT, required=False, nullable=True),
    }
)
COMPONENTS = ["causal_conditions", "context", "intervening_conditions", "action_strategies", "consequences"]
_EVIDENCE_IDS = Key(ListOf(TEXT), required=False, default=_EMPTY_TEXTS)
_PARADIGM_ITEM = Record({"description": Key(TEXT), "evidence_insight_ids": _EVIDENCE_IDS})
AXIAL_RESULT = Record(
    {
        "paradigm_model": Key(Record({c: Key(ListOf(_PARADIGM_ITEM), required=False) for c in COMPONENTS})),
        "properties_and_dimensions": Key(
            ListOf(
                Record(
                    {
                        "property_name": Key(TEXT),
                        "property_description": Key(TEXT),
                        "dimensional_range": Key(TEXT),
                        "evidence_insight_ids": _EVIDENCE_IDS,
                    }
                )
            ),
            required=False,
        ),
    }
)
# ------------------------------------------------------------------------------------------


def errors_of(contract: Record | ListOf, value: Column) -> Column:
    return contract.errors(value, F.lit("$"))


def validate(df: DataFrame, contract: Record, value: str = "value", keep: tuple[str, ...] = ()) -> Split:
    """Split on a contract: typed columns for the good rows, ``errors`` for the others."""
    checked = parsing.computed(df, errors=errors_of(contract, F.col(value)))
    good = checked.filter(F.size("errors") == 0)
    bad = checked.filter(F.size("errors") > 0).select(*keep, "errors")
    return Split(good.select(*keep, *[c.alias(n) for n, c in contract.columns(F.col(value)).items()]), bad)


def _checked(df: DataFrame, contract: Record | ListOf, response: str) -> DataFrame:
    parsed = parsing.with_parsed(df, response)
    errors = F.when(F.col("status") == parsing.OK, errors_of(contract, F.col("value")))
    checked = parsing.computed(parsed, errors=errors)
    return checked.withColumn("status", F.when(F.size("errors") > 0, "bad_type").otherwise(F.col("status")))


def validate_responses(df: DataFrame, contract: Record, response: str, keep: tuple[str, ...]) -> Split:
    """Parse free-text responses and validate them; rejects carry one ``reason`` and the paths."""
    checked = _checked(df, contract, response)
    good = checked.filter(F.col("status") == parsing.OK)
    bad = checked.filter(F.col("status") != parsing.OK)
    typed = [c.alias(n) for n, c in contract.columns(F.col("value")).items()]
    return Split(
        good.select(*keep, *typed),
        bad.select(*keep, F.col("status").alias("reason"), F.coalesce("errors", F.array().cast(_NO_ERRORS)).alias("errors")),
    )


def validate_list_responses(df: DataFrame, contract: Record, response: str, keep: tuple[str, ...]) -> Split:
    """As :func:`validate_responses` for a JSON list; one bad item rejects the whole response.

    The items come out as rows with their position ``pos``.
    """
    checked = _checked(df, ListOf(contract), response)
    good = checked.filter(F.col("status") == parsing.OK)
    items = good.select(*keep, F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("pos", "item"))
    typed = [c.alias(n) for n, c in contract.columns(F.col("item")).items()]
    bad = checked.filter(F.col("status") != parsing.OK)
    return Split(
        items.select(*keep, F.col("pos").cast("bigint").alias("pos"), *typed),
        bad.select(*keep, F.col("status").alias("reason"), F.coalesce("errors", F.array().cast(_NO_ERRORS)).alias("errors")),
    )


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> None:
    """Fail before any job starts when the source lacks a column."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")


def echo_mismatches(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Rows whose echoed id or text differ from what was asked (``id``/``text`` per ``key``)."""
    joined = asked.select(F.col(key), "id", "text").join(
        answered.select(F.col(key), "id_fragmento", "fragmento_original"), key
    )
    same_id = F.col("id").eqNullSafe(F.col("id_fragmento"))
    same_text = F.col("text").eqNullSafe(F.col("fragmento_original"))
    return joined.filter(~(same_id & same_text)).select(
        key, (~same_id).alias("id_changed"), (~same_text).alias("text_changed")
    )
