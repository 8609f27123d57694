"""Cleaning the source table into insights, their metadata registry and the run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.contracts import Split, missing_columns, require_columns

REQUIRED = ["ID", "InsightText"]
METADATA = ["Method", "Source"]
UNKNOWN = "unknown"


def has_metadata(src: DataFrame) -> bool:
    """Provenance is kept only when both columns are there."""
    return not missing_columns(src, METADATA)


def _reason() -> Column:
    return (
        F.when(F.col("id").isNull(), "null_id")
        .when(F.col("id") == "", "blank_id")
        .when(F.col("text").isNull(), "null_text")
        .when(F.col("text") == "", "blank_text")
    )


def normalised(src: DataFrame, ord_col: str = "src_ord") -> DataFrame:
    """Stripped string columns plus ``reason``, null for a usable row. A single projection."""
    require_columns(src, REQUIRED)
    if has_metadata(src):
        meta = [F.coalesce(T.strip(F.col(c).cast("string")), F.lit(UNKNOWN)) for c in METADATA]
    else:
        meta = [F.lit(UNKNOWN), F.lit(UNKNOWN)]
    return src.select(
        F.col(ord_col).cast("bigint").alias("src_ord"),
        T.strip(F.col("ID").cast("string")).alias("id"),
        T.strip(F.col("InsightText").cast("string")).alias("text"),
        meta[0].alias("method"),
        meta[1].alias("source"),
    ).withColumn("reason", _reason())


def clean_insights(src: DataFrame, ord_col: str = "src_ord") -> Split:
    rows = normalised(src, ord_col)
    return Split(
        rows.filter(F.col("reason").isNull()).drop("reason"),
        rows.filter(F.col("reason").isNotNull()).select("src_ord", "id", "text", "reason"),
    )


def last_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key. Partial aggregation keeps a hot key small."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_last"))
    return picked.select(key, *[F.col("_last")[c].alias(c) for c in columns])


def metadata_registry(valid: DataFrame) -> DataFrame:
    """One provenance row per id, the last source row winning."""
    return last_per_key(valid, "id", "src_ord", ["method", "source"])


def insight_texts(insights: DataFrame, order: str = "src_ord") -> DataFrame:
    """id -> text over rows that have both, the last row winning."""
    usable = insights.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    return last_per_key(usable, "id", order, ["text"])


def run_report(src: DataFrame, ord_col: str = "src_ord") -> DataFrame:
    """Totals of a preprocessing run in one pass: one row."""
    rows = normalised(src, ord_col)
    reasons = ["null_id", "blank_id", "null_text", "blank_text"]
    return rows.agg(
        F.count(F.lit(1)).alias("total_insights"),
        F.count_if(F.col("reason").isNull()).alias("processed_insights"),
        F.count_if(F.col("reason").isNotNull()).alias("warnings"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in reasons],
        (F.lit(has_metadata(src)) & (F.count_if(F.col("reason").isNull()) > 0)).alias("metadata_generated"),
    )


def source_check(src: DataFrame) -> DataFrame:
    """Row-level check of a source that has the required columns: one row."""
    require_columns(src, REQUIRED)
    missing = ", ".join(missing_columns(src, METADATA))
    return src.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("ID").isNull() | F.col("InsightText").isNull()).alias("n_null_rows"),
        (F.count(F.lit(1)) > 0).alias("is_valid"),
        F.lit(missing).alias("missing_metadata_columns"),
    )


def as_fragments(insights: DataFrame) -> DataFrame:
    """The request form of an insight: ``id_fragmento``, ``fragmento_original``, no codes yet."""
    return insights.withColumnsRenamed({"id": "id_fragmento", "text": "fragmento_original"}).withColumn(
        "codigos_abiertos", F.array().cast("array<string>")
    )


def open_code(insights: DataFrame, text_col: str = "text", max_codes: int = T.MAX_CODES) -> DataFrame:
    """Rule-based open coding: adds ``codigos_abiertos``. No shuffle, no Python."""
    return insights.withColumn("codigos_abiertos", T.action_labels(F.col(text_col), max_codes))


def exploded_codes(coded: DataFrame, keys: list[str], codes: str = "codigos_abiertos") -> DataFrame:
    """One row per label of a code list with its 1-based position; labels are stripped, blanks dropped."""
    out = coded.select(*keys, F.posexplode(codes).alias("_p", "_l"))
    out = out.select(*keys, (F.col("_p") + 1).cast("bigint").alias("pos"), T.strip(F.col("_l")).alias("label"))
    return out.filter(F.col("label").isNotNull() & (F.col("label") != ""))


def distinct_labels(coded: DataFrame, codes: str = "codigos_abiertos") -> DataFrame:
    """Every usable label once, with the number of rows it occurs in as ``n``."""
    per_row = coded.select(F.explode(F.array_distinct(T.labels_of(F.col(codes)))).alias("label"))
    return per_row.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
