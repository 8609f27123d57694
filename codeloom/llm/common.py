"""Small helpers shared by the operators: reading tables, word cutting, memo tables, binding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space of all contracts, space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Chunks beyond this length are not remembered.
LONGEST_KEPT = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once.

    A column used inside a lambda is otherwise evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def crc_bucket(key: Column, buckets: int) -> Column:
    """``crc32(key as text) mod buckets``: which fold a row belongs to. Null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % buckets


class Memo(dict):
    """``f(key)`` kept for at most ``limit`` keys of at most ``longest`` bytes or characters; a full table starts anew.

    Long keys are worked out each time, so memory is bounded by ``limit`` and ``longest``, whatever the texts hold. The limits change
    speed only. :func:`released` empties the table when a task ends, as Python workers outlive their tasks.
    """

    def __init__(self, f: Callable, limit: int, longest: int = LONGEST_KEPT):
        super().__init__()
        self.f, self.limit, self.longest = f, limit, longest

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def released(batches: Iterator[pa.RecordBatch], *forget: Callable[[], None]) -> Iterator[pa.RecordBatch]:
    """The batches a task gives; ``forget`` is called when it ends, is stopped or fails.

    Tables of a module are emptied through a function of that module: a table named here would travel as a copy.
    """
    try:
        yield from batches
    finally:
        for f in forget:
            f()


def fresh(name: str, *taken: str) -> str:
    """``name``, with underscores added until it is none of ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of ``rows``, so that what is derived from one of them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
