"""Writing results. Every sink is a distributed write; nothing is overwritten while being read."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators.ranking import with_position

KEEP_NULLS = {"ignoreNullFields": "false"}


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; nulls are written out."""
    df.write.mode(mode).options(**KEEP_NULLS).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def append_rejects(rejects: DataFrame, path: str, run_id: str | None = None) -> None:
    """Failed rows of a run, kept for later: adds ``run_id`` and appends."""
    append_jsonl(rejects.withColumn("run_id", F.lit(run_id or uuid.uuid4().hex)), path)


def append_once(df: DataFrame, path: str, run_id: str) -> None:
    """Append the rows of a run as JSON lines, once however often the run is repeated; ``readers.read_appended`` reads them.

    The rows go to a folder of their own under ``<path>/data``; the run's entry in ``<path>/runs``, written last, names it. A repeated
    run writes another folder and then replaces its entry and no other, so a reader sees the old rows or the new ones, never both.
    """
    folder = uuid.uuid4().hex
    write_jsonl(df, f"{path}/data/{folder}", "errorifexists")
    entry = df.sparkSession.createDataFrame([(run_id, folder)], "run_id string, folder string").coalesce(1)
    entry.write.mode("overwrite").json(f"{path}/runs/run={hashlib.md5(run_id.encode()).hexdigest()}")


def write_version(df: DataFrame, root: str, version: int, fmt: str = "parquet") -> str:
    """Write a table as ``root/version=N``; writing the same version again replaces it."""
    path = f"{root}/version={version}"
    writer = df.write.mode("overwrite")
    (writer.options(**KEEP_NULLS) if fmt == "json" else writer).format(fmt).save(path)
    return path


def write_codebook(codebook: DataFrame, path: str, embedding_dim: int = 768) -> None:
    """Codebook rows as JSON lines in codebook order, each with the ``embedding_dim`` of its vectors."""
    ordered = codebook.orderBy("ord").withColumn("embedding_dim", F.lit(embedding_dim))
    write_jsonl(ordered, path)


def write_categories(nested: DataFrame, path: str) -> None:
    write_jsonl(nested, path)


def write_metadata(registry: DataFrame, path: str) -> None:
    """Provenance as one JSON object per line, ``{"<id>": {"method": …, "source": …}}``.

    The single-document form would be one row as large as the corpus; lines split and merge.
    """
    entry = F.create_map(F.col("id"), F.struct("method", "source"))
    registry.select(T.to_json(entry).alias("value")).write.mode("overwrite").text(path)


def write_report(parts: DataFrame, column: str, path: str) -> None:
    """Text parts written in ``part`` order; the files joined in name order are the text.

    The writer ends every row with a newline, so the one a part ends with is left to it.
    """
    ordered = parts.repartitionByRange("part").sortWithinPartitions("part")
    ordered.select(F.regexp_replace(column, r"\n\z", "")).write.mode("overwrite").option(
        "lineSep", "\n"
    ).text(path)


def numbered_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with an explicit ordinal, as files read back have no order of their own."""
    return with_position(df, order, name="line_no")
