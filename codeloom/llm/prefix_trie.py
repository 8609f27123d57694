"""The prefix trie of conversations: shared beginnings, and what sharing them saves.

A node is a distinct sequence of first turns. It is named by 128 bits: two 64-bit hashes of place, role and text per turn, each
combined by exclusive or along the conversation, so the names of all prefixes come from a running combination in two levels (blocks of
``BLOCK`` turns, then the blocks' totals) and no conversation has to fit one task. Texts are hashed and counted where they are read; only
hashes and counts move. Sums over subtrees come from the centroid decomposition in ``centroids``, with one tree per first
turn; the textless root sums all trees.

Edge cases: null roles and texts are empty; turns are in order of ``turn``, null first, ties by the hash of role and text; repeated rows are turns
of their own; rows without a conversation id belong to no conversation and are left out; very long texts are read whole; an empty table has
no conversation and gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import centroids
from codeloom.llm.common import WORD
from codeloom.operators.ranking import with_position
from codeloom.session import cut_lineage

BLOCK = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _lanes(*parts: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of the parts."""
    return [F.xxhash64(F.lit(lane), *parts) for lane in ("first", "second")]


def _block(place: str) -> Column:
    return F.expr(f"({place} - 1) div {BLOCK}")


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, place, l1, l2, words``: every turn with its place from 1 on, hashes of role and text, and its number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    l1, l2 = _lanes(role, text)
    words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), l1.alias("l1"), l2.alias("l2"), words.alias("words"))
    return with_position(rows, ["turn", "l1", "l2"], ["conv"], "place").drop("turn")


def with_lengths(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with the ``length`` of their conversation, and ``conv, length``.

    Lengths are dealt out to blocks of turns, so a conversation with most of the rows does not meet its length in one task.
    """
    convs = cut_lineage(rows.groupBy("conv").agg(F.max("place").alias("length")))
    return _joined(rows, convs, "length"), convs


def _joined(rows: DataFrame, convs: DataFrame, size: str) -> DataFrame:
    """``rows`` with the columns of their conversation in ``convs``, which has ``size`` turns at most."""
    blocks = convs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest({size} - 1, 0) div {BLOCK}"))))
    return rows.withColumn("block", _block("place")).join(blocks, ["conv", "block"]).drop("block")


def with_shared_heads(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin alike, for tables whose conversations share nothing.

    Conversation c takes the first h turns (all if there are fewer, none without that conversation) of conversation ``c - c % every``
    and goes on with its own after its first h; ``h = crc32(c) % most``. Gives what :func:`with_lengths` gives.
    """
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    sizes = rows.groupBy("conv").agg(F.max("place").alias("n")).select("conv", "n", heads.alias("h"), (F.col("conv") - F.col("conv") % every).alias("donor"))
    sizes = cut_lineage(sizes)
    given = sizes.where(F.col("conv") % every == 0).select(F.col("conv").alias("donor"), F.least("n", F.lit(most - 1)).alias("has"))
    taken = F.least("h", F.coalesce("has", F.lit(0).cast("bigint")))
    convs = cut_lineage(sizes.join(given, "donor", "left").select("conv", "n", "h", "donor", taken.alias("k")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    own = _joined(rows.where(F.col("place") > heads), convs.select("conv", "n", "h", "k", "length"), "n").withColumn("place", F.col("place") - F.col("h") + F.col("k"))
    donors = rows.where((F.col("conv") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv", "donor")
    shared = donors.join(convs.where("k > 0").select("conv", "donor", "k", "length"), "donor").where("place <= k")
    columns = ["conv", "place", "l1", "l2", "words", "length"]
    return own.select(*columns).unionByName(shared.select(*columns)), convs.select("conv", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv, depth, length, words, k1, k2, p1, p2, t1, t2``: every turn with the names of its node, its parent and the top of its tree."""
    g1, g2 = _lanes("place", "l1", "l2")
    marked = cut_lineage(rows.select("conv", "place", "length", "words", _block("place").alias("block"), g1.alias("g1"), g2.alias("g2")))
    far = marked.where(F.col("length") > BLOCK).groupBy("conv", "block").agg(F.bit_xor("g1").alias("b1"), F.bit_xor("g2").alias("b2"), F.min_by("g1", "place").alias("f1"), F.min_by("g2", "place").alias("f2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = far.select("conv", "block", *[F.bit_xor(b).over(before).alias(b) for b in ("b1", "b2")], *[F.first(f).over(before).alias(f) for f in ("f1", "f2")]).where("block > 0")
    upto = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marked.select("*", *[F.bit_xor(g).over(upto).alias(x) for g, x in (("g1", "x1"), ("g2", "x2"))], *[F.first(g).over(upto).alias(h) for g, h in (("g1", "h1"), ("g2", "h2"))])
    k1, k2 = (F.col(x).bitwiseXOR(F.coalesce(F.col(b), F.lit(0).cast("bigint"))) for x, b in (("x1", "b1"), ("x2", "b2")))
    named = local.join(offsets, ["conv", "block"], "left").select(
        "conv", F.col("place").alias("depth"), "length", "words", k1.alias("k1"), k2.alias("k2"),
        k1.bitwiseXOR(F.col("g1")).alias("p1"), k2.bitwiseXOR(F.col("g2")).alias("p2"), F.coalesce("f1", "h1").alias("t1"), F.coalesce("f2", "h2").alias("t2"),
    )
    return cut_lineage(named)


class Trie(NamedTuple):
    nodes: DataFrame
    ends: DataFrame


def build(rows: DataFrame, convs: DataFrame, limit: int = centroids.LIMIT) -> Trie:
    """The nodes, and ``conv, depth, k1, k2``: the node at which each conversation ends.

    ``rows``: ``conv, place, l1, l2, words, length``; ``convs``: ``conv, length`` of every conversation, those without a turn included. ``nodes``: ``k1, k2, conv`` (the smallest member),
    ``depth, parent_conv`` (the parent's smallest member, null for the root), ``n_convs, n_children, n_leaves, saved_tokens``.
    """
    path = prefixes(rows)
    members = path.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv"), *[F.min(c).alias(c) for c in ("depth", "words", "p1", "p2", "t1", "t2")],
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    members = cut_lineage(members)
    children = members.where("depth > 1").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    none = F.coalesce("n_children", F.lit(0).cast("bigint"))
    nodes = members.join(children, ["k1", "k2"], "left").withColumns({"n_children": none, "n_leaves": (none == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    nodes = cut_lineage(nodes)
    sums = centroids.rollup(nodes, path.select("conv", "depth", "k1", "k2", "p1", "p2"), ["n_leaves", "saved_tokens"], limit)

    whole = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).first()  # one row
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv"))
    kind = nodes.schema["conv"].dataType
    tops = nodes.where("depth = 1").withColumn("parent_conv", F.lit(whole.conv).cast(kind))
    below = nodes.where("depth > 1").join(parents, ["p1", "p2"])
    columns = ["k1", "k2", "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = below.unionByName(tops).drop("n_leaves", "saved_tokens").join(sums, ["k1", "k2"]).select(*columns)

    zero = F.lit(0).cast("bigint")
    of_all = nodes.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = of_all.where(F.lit(whole.n > 0)).select(
        zero.alias("k1"), zero.alias("k2"), F.lit(whole.conv).cast(kind).alias("conv"), zero.alias("depth"), F.lit(None).cast(kind).alias("parent_conv"), F.lit(whole.n).cast("bigint").alias("n_convs"), "n_children", "n_leaves", "saved_tokens"
    )
    last = path.where(F.col("depth") == F.col("length")).select("conv", "depth", "k1", "k2")
    turnless = convs.where("length = 0").select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"))
    return Trie(found.unionByName(root), last.unionByName(turnless))


def ends_sha256(ends: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256``: the SHA-256 of the decimal ids of the conversations that end at a node, ascending, comma-joined.

    Ids are joined 4,096 values at a time before they move; a task then reads a node's pieces in order and keeps the running hash alone.
    """
    pieces = ends.groupBy("depth", "k1", "k2", F.shiftright("conv", 12).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("text"))
    return running_sha256(pieces, ["depth", "k1", "k2"], ["piece"], "text", b",", "ends_sha256")


def digest(trie: Trie) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    nodes = trie.nodes.join(ends_sha256(trie.ends), ["depth", "k1", "k2"], "left")
    names = {"conv_id": "conv", "depth": "depth", "parent_conv_id": "parent_conv", **{n: n for n in ("n_convs", "n_children", "n_leaves", "saved_tokens")}}
    return nodes.select(*[F.col(c).alias(n) for n, c in names.items()], F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))


def running_sha256(rows: DataFrame, key: list[str], order: list[str], text: str, separator: bytes, name: str) -> DataFrame:
    """``key..., name``: the SHA-256 of each key's texts in order, joined by ``separator``.

    The hash of one string is made byte after byte, so a key's rows are read by one task; they are sorted on disk and only the hash is kept.
    """
    dealt = rows.select(*key, *order, text).repartition(*key).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []
        for b in batches:
            for row, piece in zip(zip(*[b.column(k).to_pylist() for k in key]), b.column(text).cast(pa.large_binary()).to_pylist()):
                if digest is None or row != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = row, hashlib.sha256(piece)
                else:
                    digest.update(separator)
                    digest.update(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), out)], names=out.names)
                done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip((*current, digest.hexdigest())), out)], names=out.names)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = pa.schema([*[(k, kinds[rows.schema[k].dataType.simpleString()]) for k in key], (name, pa.string())])
    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key], f"{name} string"])
    return dealt.mapInArrow(run, schema)
