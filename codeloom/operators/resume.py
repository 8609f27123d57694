"""Resuming a coding run and merging requests with results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import stored


def processed_ids(done: DataFrame) -> DataFrame:
    """Ids already in the checkpoint; older rows only have ``id_fragmento``."""
    return done.select(F.coalesce(F.nullif("id", F.lit("")), F.col("id_fragmento")).alias("_done_id")).distinct()


def pending(raw: DataFrame, done: DataFrame) -> DataFrame:
    """Insights not yet processed; duplicates among them stay. Null ids match a null checkpoint id.

    Before there is a checkpoint all are, and their texts need not move. Later the ids left over are found without the texts, and where
    these are few, the optimizer broadcasts them.
    """
    if done.isEmpty():
        return raw
    ids = processed_ids(done)
    given = raw.select(F.col("id").alias("_left_id")).distinct()
    left = stored(given.join(ids, given["_left_id"].eqNullSafe(ids["_done_id"]), "left_anti"), "pending")
    return raw.join(left, raw["id"].eqNullSafe(left["_left_id"]), "left_semi")


def with_checkpoint(done: DataFrame, new: DataFrame) -> DataFrame:
    """Checkpointed and newly coded rows together."""
    return done.unionByName(new, allowMissingColumns=True)


def merge_records(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join on ``key`` where the right side's columns replace the left side's of the same name."""
    keep = [c for c in left.columns if c == key or c not in right.columns]
    return left.select(*keep).join(right, key)


def coded_rows(insights: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Insights with their coding result; a result carrying an error keeps no codes."""
    return without_failed_codes(merge_records(insights, results, key))


def without_failed_codes(merged: DataFrame) -> DataFrame:
    """The rule of :func:`coded_rows`, for rows that are together with their result already."""
    codes = F.when(F.col("error").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("codigos_abiertos"))
    return merged.withColumn("codigos_abiertos", codes)


def failed_rows(insights: DataFrame, rejects: DataFrame, key: str = "id") -> DataFrame:
    """Insights whose call or response failed, kept for a later run: ``id, insight_original, error``.

    ``key`` tells rows apart; ids may repeat.
    """
    return as_failed(insights.join(rejects.select(key, "reason"), key))


def as_failed(rows: DataFrame) -> DataFrame:
    """The form of :func:`failed_rows`, for insights that are together with their ``reason`` already."""
    return rows.select("id", F.struct("id", "text").alias("insight_original"), F.col("reason").alias("error"))
