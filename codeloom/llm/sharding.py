"""Reproducible shuffle and shards: a Feistel permutation with cycle walking over global row numbers.

A row's number is its place in the order (id, size, checksum); a keyed permutation of ``[0, n)`` turns it
into a place ``p``; its shard is ``p mod shards`` and its slot ``p div shards``. Shard and slot of any
row can be computed without the other rows, counts differ by one at most, and the same rows give the
same result however they are split into files.

Edge cases: a null text has no bytes (size 1, checksum of the empty text); a null id sorts first; identical rows
get neighbouring numbers, hence different slots; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import with_position

ROUNDS = 6
# Multipliers of a 64-bit mixing function (splitmix64).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """The images of ``index`` under a permutation of ``[0, n)`` chosen by ``seed``.

    The network permutes the least power of four that is not below ``n`` (at most ``4 n``); images outside
    ``[0, n)`` are sent through it again until they fall inside (cycle walking), about three times on average.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    with np.errstate(over="ignore"):
        keys = [_mix(np.array([(seed + (k + 1) * MIX[0]) & (2**64 - 1)], dtype=np.uint64))[0] for k in range(rounds)]
        out = index.astype(np.uint64)
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for key in keys:
                left, right = right, left ^ (_mix(right + key) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, size, text_crc32, shard, slot``: one row per document.

    Only ids, sizes and checksums move; texts stay where they are. Identical rows are counted before they are
    numbered, so many copies of a row do not meet in one range partition.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("crc"))
    counted = rows.groupBy("id", "size", "crc").agg(F.count(F.lit(1)).alias("copies"))
    placed = with_position(counted, ["id", "size", "crc"], running={"upto": "copies"})
    total = placed.agg(F.max("upto")).first()[0] or 0
    numbered = placed.select("id", "size", "crc", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)).alias("row"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column("row").to_numpy(), total, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("size"), b.column("crc"), pa.array((p % shards).astype(np.int32)), pa.array(p // shards)],
                names=[id_col, "size", "text_crc32", "shard", "slot"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return numbered.mapInArrow(place, f"`{id_col}` {kind}, size bigint, text_crc32 bigint, shard int, slot bigint")
