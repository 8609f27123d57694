"""Character n-gram features of short labels, as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3


def grams_of(label: Column, n: int = GRAM) -> Column:
    """All n-grams of a label in order; a label shorter than ``n`` is its own single gram."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(label) - (n - 1), F.lit(1)))
    return F.when(F.length(label) < n, F.array(label)).otherwise(
        F.transform(starts, lambda i: F.substring(label, i, F.lit(n)))
    )


def counted(grams: Column) -> Column:
    """``array<struct<g, c>>``: the distinct grams of an array column with their counts."""
    return F.transform(
        F.array_distinct(grams),
        lambda g: F.struct(g.alias("g"), F.size(F.filter(grams, lambda x: x == g)).cast("bigint").alias("c")),
    )
