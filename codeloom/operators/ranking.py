"""Exact positions and running sums that survive one group holding most of the rows.

A window over a whole group puts that group into one task. Here the rows are range
partitioned by (group, order), every partition is numbered on its own, and the offsets come
from one small row per (partition, group). No task ever sees more than one range partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import cut_lineage


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_position(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    name: str = "position",
    running: dict[str, str] | None = None,
) -> DataFrame:
    """Add a 1-based ``name`` (and running sums ``{new: column}``) per group in order.

    ``order_by`` should be a total order within the group. The range partitioning samples its
    bounds, so the partition number is written down with the rows before it is used.
    """
    running = running or {}
    order = [_column(c) for c in order_by]
    groups = list(partition_by)
    parted = cut_lineage(
        df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_part", F.spark_partition_id())
    )
    totals = parted.groupBy("_part", *groups).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in running.items()]
    )
    # At most (partitions + groups) rows in all, and at most one per partition in a group.
    before = Window.partitionBy(*groups or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select(
        F.col("_part").alias("_o_part"),
        *[F.col(g).alias(f"_o_{g}") for g in groups],
        F.coalesce(F.sum("_n").over(before), zero).alias("_off"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), zero).alias(f"_off_{k}") for k in running],
    )
    on = F.col("_part") == F.col("_o_part")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    local = Window.partitionBy("_part", *groups).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = parted.join(offsets, on)
    added = {name: (F.col("_off") + F.row_number().over(local)).cast("bigint")}
    for k, c in running.items():
        added[k] = F.col(f"_off_{k}") + F.sum(c).over(upto)
    return ranked.withColumns(added).select(*df.columns, *added)
