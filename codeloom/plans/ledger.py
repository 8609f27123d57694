"""What the phases of a study have finished, so that a rerun goes on where the last run stopped.

Each commit of a phase has its own folder of tables. A record with the versions of its inputs is written last and in one file: without it the
folder does not count, so a phase that was torn is done again beside what it left behind. A phase whose inputs are those of its last commit is skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import COMPRESSION
from codeloom.sources.readers import path_exists
from codeloom.sources.writers import write_version

RECORD = "phase string, number bigint, source string, path string, asked bigint, rows bigint"


class Commit(NamedTuple):
    phase: str
    number: int
    source: str
    path: str
    asked: int
    rows: int


class Outcome(NamedTuple):
    """What a run did with a phase: ``done``, ``skipped``, or the error that stopped it."""

    phase: str
    status: str
    asked: int
    rows: int


def content(df: DataFrame) -> str:
    """A name for the rows of a table, whatever their order: their number and the sum of their hashes."""
    return contents(df, F.lit(0), 1)[0][1]


def contents(df: DataFrame, slice_of: Column, slices: int) -> list[tuple[int, str]]:
    """The number of rows and the :func:`content` of each slice ``0, 1, …`` of a table, read once."""
    hashed = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    rows = df.groupBy(slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("n"), hashed.alias("sum")).collect()  # one row per slice
    seen = {r["_slice"]: r for r in rows}
    n_and_sum = [(seen[k].n, seen[k]["sum"]) if k in seen else (0, 0) for k in range(slices)]
    return [(n, f"{n} rows {total or 0} of {df.schema.simpleString()}") for n, total in n_and_sum]


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self, phase: str) -> list[Commit]:
        """All commits of a phase, first to last: one record each."""
        path = f"{self.root}/{phase}/log"
        if not path_exists(self.spark, path):
            return []
        rows = self.spark.read.schema(RECORD).json(path).where("number IS NOT NULL").orderBy("number").collect()
        return [Commit(*(r[c] for c in Commit._fields)) for r in rows]

    def last(self, phase: str) -> Commit | None:
        return (self.commits(phase) or [None])[-1]

    def version(self, phase: str) -> str:
        """The phase and the number of its last commit, for the ``source`` of phases that read it."""
        last = self.last(phase)
        return f"{phase} {last.number if last else 'none'}"

    def read(self, phase: str, table: str, since: int = 0) -> DataFrame | None:
        """A table of all commits numbered ``since`` or higher, united; None without any."""
        paths = [f"{c.path}/{table}" for c in self.commits(phase) if c.number >= since]
        return self.spark.read.parquet(*paths) if paths else None

    def latest(self, phase: str, table: str) -> DataFrame:
        """A table of the last commit."""
        last = self.last(phase)
        if last is None:
            raise LookupError(f"{phase} has not been done under {self.root}")
        return self.spark.read.parquet(f"{last.path}/{table}")

    def run(self, phase: str, source: str, build: Callable[[int, str], tuple[dict[str, DataFrame | None], int]]) -> Outcome:
        """Do a phase unless its last commit was made from ``source``.

        ``build(number, path)`` gives the phase's tables by name, the main one first, and the number of requests it made. It
        may write more under ``path``; a table that it has put there itself with :meth:`write` is None.
        """
        last = self.last(phase)
        if last is not None and last.source == source:
            return Outcome(phase, "skipped", 0, last.rows)
        number = last.number + 1 if last else 1
        path = f"{self.root}/{phase}/data/{number}-{uuid.uuid4().hex}"
        tables, asked = build(number, path)
        for name, df in tables.items():
            if df is not None:
                self.write(df, path, name)
        rows = self.spark.read.parquet(f"{path}/{next(iter(tables))}").count()
        commit = Commit(phase, number, source, path, asked, rows)
        write_version(self.spark.createDataFrame([tuple(commit)], RECORD).coalesce(1), f"{self.root}/{phase}/log", number, "json")
        return Outcome(phase, "done", asked, rows)

    def write(self, df: DataFrame, path: str, name: str) -> DataFrame:
        """Write a table of a phase, and read it back."""
        df.write.option("compression", COMPRESSION).parquet(f"{path}/{name}")
        return self.spark.read.parquet(f"{path}/{name}")

    def attempt(self, phase: str, source: str, build: Callable[[int, str], tuple[dict[str, DataFrame | None], int]]) -> Outcome:
        """:meth:`run`, where a failure is an outcome and not the end of the study; the phase is tried again by the next run."""
        try:
            return self.run(phase, source, build)
        except Exception as e:  # a model or its answers may fail in any way
            return Outcome(phase, f"failed: {type(e).__name__}", 0, 0)
