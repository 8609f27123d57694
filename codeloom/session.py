"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Of tables with texts; they take two thirds of what they take in Spark's default.
COMPRESSION = "zstd"

# Runtime settings the library is designed for. On a cluster they belong in the submit
# configuration; nothing below depends on them for right results, only for speed.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even where that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "codeloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one named by ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder: on a cluster that folder would live and die with one machine.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table written by this run."""
    return f"{shared_dir(spark)}/codeloom/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that wrote them ends, instead of when the driver happens to collect its garbage.
_SHUFFLE_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("_passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`stored` writes while it lasts are deleted when it ends, and shuffle files with their query.

    What is made of the tables has to be written by then.
    """
    paths: list[str] = []
    outer, before = _passing.set(paths), spark.conf.get(_SHUFFLE_KEY, None)
    spark.conf.set(_SHUFFLE_KEY, "true")
    try:
        yield
    finally:
        _passing.reset(outer)
        spark.conf.unset(_SHUFFLE_KEY) if before is None else spark.conf.set(_SHUFFLE_KEY, before)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read back, for rows with texts: they are compressed, which those of :func:`cut_lineage` are not.

    The optimizer knows the size of what is read, so a small table is broadcast and what it is joined with stays put.
    """
    path = scratch_path(df.sparkSession, name)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    df.write.option("compression", COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that losing executors costs a re-read and not a re-run."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def cut_and_measure(df: DataFrame, **measures) -> tuple[DataFrame, dict]:
    """:func:`cut_lineage`, with aggregates of the rows taken while they are written."""
    seen = Observation()
    out = cut_lineage(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get
