"""Repair of conversation structure: the cheapest edits after which the roles read ``(s?(ua)+)?``.

Faults of a turn, the first that applies: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated
(the last character that is no white space is none of ``.!?``). Edits: keep a turn (K, 0), give it the role user or assistant (R, 2), delete it
(D, 3; required for blank and duplicate turns), insert an empty turn of user or assistant (I, 2); a truncated turn that stays costs 1 more.

A turn is a symbol, its role's initial with its fault. Equal symbols in a row are one run. For each symbol the cheapest way
between any two states of the role pattern is a min-plus matrix, inserts before the turn included; a run of length n takes the costs
across by the binary powers of its matrix, cached per worker. From the costs-to-go the audit is unrolled front to back: a letter and a state
fix the next state, so taking the least letter on a cheapest way gives the ASCII-least audit.

Texts are hashed where they are read; faults, runs and choices work on 128-bit marks. Equal rows of a conversation and turn are one mark with
a count before they move, so copies do not gather. A conversation's task holds a byte per distinct turn, as the audit it
returns does. Texts move once, to the choices that need them.

Edge cases: null roles and texts are one space (a blank turn of an unknown role); rows with a null id are a conversation of their own;
turns are in order of ``turn``, null first, ties by the hash of role and text; equal rows are duplicates but for the first; very long texts are
read whole; without rows there is no report; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.prefix_trie import EMPTY_SHA256, running_sha256
from codeloom.operators.ranking import with_position
from codeloom.session import cut_lineage

BLOCK = 4096
WHITE = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
# Initials and faults; a symbol is 4 * fault + initial.
S, U, A, OTHER = range(4)
FINE, TRUNCATED, GONE = range(3)
DELETE, INSERT, RENAME, CUT_OFF = 3, 2, 2, 1
NEVER = 1 << 60
# States of the role pattern: nothing yet, after s, after u, after a. What u, a, and an insert lead to.
AFTER = {S: {0: 1}, U: {0: 2, 1: 2, 3: 2}, A: {2: 3}, OTHER: {}}
FORWARD = {0: 2, 1: 2, 2: 3, 3: 2}
ROLES = {2: "user", 3: "assistant"}
AT_END = (0, 2 * INSERT, INSERT, 0)

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


# Costs ------------------------------------------------------------------------------------------------------


def moves(symbol: int, state: int) -> dict[str, tuple[int, int]]:
    """``letter -> (cost, next state)`` of the edits that use up a turn."""
    fault, initial = divmod(symbol, 4)
    out = {"D": (DELETE, state)}
    if fault != GONE:
        extra = CUT_OFF if fault == TRUNCATED else 0
        if state in AFTER[initial]:
            out["K"] = (extra, AFTER[initial][state])
        out["R"] = (RENAME + extra, FORWARD[state])
    return out


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in range(4)) for i in range(4))


@lru_cache(maxsize=None)  # 12 symbols, and as many powers as a length has bits
def power(symbol: int, bit: int) -> Matrix:
    """The cheapest ways through ``2 ** bit`` turns of a symbol, from state to state."""
    if bit:
        half = power(symbol, bit - 1)
        return tuple(tuple(min(x, NEVER) for x in row) for row in _times(half, half))
    out = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        spent, at = 0, state
        for _ in range(3):  # two inserts lead through all states that inserts reach
            for cost, to in moves(symbol, at).values():
                out[state][to] = min(out[state][to], spent + cost)
            spent, at = spent + INSERT, FORWARD[at]
    return tuple(map(tuple, out))


def through(symbol: int, length: int, v: Vector) -> Vector:
    """The costs-to-go before a run, from those after it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            v = _apply(power(symbol, bit), v)
    return v


def runs_of(symbols: bytes, copies: dict[int, int]) -> list[tuple[int, int]]:
    """``(symbol, length)``: equal symbols in a row collapsed; further copies of turn k are duplicates right after it."""
    out: list[list[int]] = []
    for k, symbol in enumerate(symbols):
        for one, n in ((symbol, 1), (4 * GONE + symbol % 4, copies.get(k, 1) - 1)):
            if n:
                if out and out[-1][0] == one:
                    out[-1][1] += n
                else:
                    out.append([one, n])
    return [(s, n) for s, n in out]


def letters(runs: list[tuple[int, int]], cell: int = BLOCK) -> tuple[int, Iterator[str]]:
    """The least cost, and the letters of the ASCII-least audit, a stretch of a run at a time."""
    behind = [AT_END]
    for symbol, length in reversed(runs):
        behind.append(through(symbol, length, behind[-1]))
    behind.reverse()

    def unroll() -> Iterator[str]:
        state = 0
        for k, (symbol, length) in enumerate(runs):
            while length:
                here = min(cell, length)
                length -= here
                costs = [through(symbol, length, behind[k + 1])]
                one = power(symbol, 0)
                for _ in range(here):
                    costs.append(_apply(one, costs[-1]))
                out = []
                for left in range(here, 0, -1):
                    after, before = costs[left - 1], costs[left]
                    done = False
                    while not done:
                        ways = {**moves(symbol, state), "I": None}
                        for letter in sorted(ways):
                            cost, to = ways[letter] or (INSERT, FORWARD[state])
                            rest = before if letter == "I" else after
                            if cost + rest[to] == before[state]:
                                out.append(letter)
                                state, done = to, letter != "I"
                                break
                yield "".join(out)
        while AT_END[state]:
            yield "I"
            state = FORWARD[state]

    return behind[0][0], unroll()


@lru_cache(maxsize=1 << 14)
def _short(symbols: bytes) -> tuple[int, str]:
    cost, audit = letters(runs_of(symbols, {}))
    return cost, "".join(audit)


def plan(symbols: bytes, copies: dict[int, int]) -> tuple[int, str]:
    """``(cost, audit)`` of a conversation; those of short ones are remembered."""
    if len(symbols) <= 32 and not copies:
        return _short(symbols)
    cost, audit = letters(runs_of(symbols, copies))
    return cost, "".join(audit)


def illegal_pairs(symbols: bytes, copies: dict[int, int]) -> int:
    """Neighbouring turns whose initials are not su, ua or au."""
    legal = {(S, U), (U, A), (A, U)}
    return sum((a % 4, b % 4) not in legal for a, b in zip(symbols, symbols[1:])) + sum(n - 1 for n in copies.values())


# Tables -----------------------------------------------------------------------------------------------------


def _key(id_col: str) -> Column:
    """The conversation's id as text, null as the empty text."""
    return F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(id_col).cast("string")))


def _given(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``c, turn, role, text, l1, l2`` of all turns."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    lanes = [F.xxhash64(F.lit(lane), role, text) for lane in ("first", "second")]
    return turns.select(_key(id_col).alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), lanes[0].alias("l1"), lanes[1].alias("l2"))


def _row_key() -> list[Column]:
    """128 bits that name a conversation, turn, role and text."""
    return [F.xxhash64(F.lit(lane), "c", F.col("turn").isNull(), "turn", "l1", "l2").alias(name) for lane, name in (("row one", "r1"), ("row two", "r2"))]


def _marks(given: DataFrame) -> DataFrame:
    """``c, turn, l1, l2, n, symbol, at``: distinct rows with their number of copies, their symbol but for duplicates, and their place."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    fault = F.when(F.translate("text", WHITE, "") == "", GONE).when(F.instr(F.lit(ENDINGS), last) == 0, TRUNCATED).otherwise(FINE)
    symbol = (4 * fault + code).cast("int")
    rows = given.select("c", "turn", "l1", "l2", symbol.alias("symbol"))
    return with_position(rows.groupBy("c", "turn", "l1", "l2").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("symbol")), ["turn", "l1", "l2"], ["c"], "at")


CHOICE = "c string, kind string, at bigint, place bigint, role string, edit string, cost bigint, illegal bigint, audit string"


def _choices(marks: DataFrame) -> DataFrame:
    """A row of kind ``turn`` per turn that stays or comes in, and one of kind ``report`` per conversation."""
    block = F.expr(f"(at - 1) div {BLOCK}")
    blocks = marks.groupBy("c", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "symbol", "n"))).alias("m"))
    parts = blocks.select("c", "block", F.transform("m", lambda x: x["symbol"]).alias("symbols"), F.transform("m", lambda x: x["n"]).alias("ns"))
    names = [f.split()[0] for f in CHOICE.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    def conversation(c: str, symbols: bytes, copies: dict[int, int]) -> Iterator[tuple]:
        cost, audit = plan(symbols, copies)
        yield (c, "report", None, None, None, None, cost, illegal_pairs(symbols, copies), audit)
        at, left, place, state = 0, 0, 0, 0
        for letter in audit:
            if letter != "I":
                if left:  # a further copy, deleted
                    left -= 1
                    continue
                at, left = at + 1, copies.get(at, 1) - 1
            if letter != "D":
                place += 1
                state = AFTER[symbols[at - 1] % 4][state] if letter == "K" else FORWARD[state]
                yield (c, "turn", at if letter != "I" else None, place, None if letter == "K" else ROLES[state], letter, None, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            current, symbols, copies = None, bytearray(), {}
            for b in batches:
                for c, some, ns in zip(*[b.column(k).to_pylist() for k in ("c", "symbols", "ns")]):
                    if c != current:
                        if current is not None:
                            yield current, bytes(symbols), copies
                        current, symbols, copies = c, bytearray(), {}
                    copies.update((len(symbols) + k, n) for k, n in enumerate(ns) if n > 1)
                    symbols += struct.pack(f"{len(some)}B", *some)
            if current is not None:
                yield current, bytes(symbols), copies

        out, size = [], 0
        for one in conversations():
            for row in conversation(*one):
                out.append(row)
                size += 64 + len(row[-1] or "")
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    dealt = parts.repartition("c").sortWithinPartitions("c", "block").select("c", "symbols", "ns")
    return cut_lineage(dealt.mapInArrow(run, CHOICE))


class Repaired(NamedTuple):
    report: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """``report``: ``<id_col>, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation; ``turns``: the repaired ones,
    ``<id_col>, place, role, text, edit``."""
    kind = turns.schema[id_col].dataType
    given = _given(turns, id_col, turn_col, role_col, text_col)
    marks = _marks(given)
    seen = marks.groupBy("c", "l1", "l2").agg(F.min("at").alias("at")).select("c", "at", F.lit(True).alias("first"))
    known = marks.join(seen, ["c", "at"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    blank = F.col("symbol") >= 4 * GONE
    symbol = F.when(blank | F.col("first"), F.col("symbol")).otherwise(4 * GONE + F.col("symbol") % 4).cast("int")
    marked = cut_lineage(known.select("c", "turn", "l1", "l2", "n", "at", "first", blank.alias("blank"), symbol.alias("symbol")))
    choices = _choices(marked)

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    fresh = F.col("first") & ~F.col("blank")
    counts = marked.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), zero).cast("bigint").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(zero)).alias("blank"),
        F.sum(F.when(F.col("blank"), zero).otherwise(F.col("n") - F.col("first").cast("bigint"))).alias("duplicate"),
        F.sum(F.when(fresh & (F.floor(F.col("symbol") / 4) == TRUNCATED), one).otherwise(zero)).alias("truncated"),
    )
    # ``c`` goes with the report and the turns, for what is derived from them.
    report = counts.join(choices.where("kind = 'report'").select("c", "illegal", "cost", "audit"), "c")
    own_id = F.when(F.col("c") != "", F.substr("c", F.lit(2))).cast(kind).alias(id_col)

    stay = choices.where("kind = 'turn' AND at IS NOT NULL").select("c", "at", "place", F.col("role").alias("new_role"), "edit")
    wanted = stay.join(marked.select("c", "at", "turn", "l1", "l2"), ["c", "at"]).select("c", "place", "new_role", "edit", *_row_key())
    texts = given.select(*_row_key(), "role", "text").dropDuplicates(["r1", "r2"])
    old = wanted.join(texts, ["r1", "r2"]).select("c", "place", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    new = choices.where("kind = 'turn' AND at IS NULL").select("c", "place", "role", F.lit("").alias("text"), "edit")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return Repaired(report.select(own_id, *columns), old.unionByName(new).select(own_id, "place", "role", "text", "edit"))


def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``<id_col>, turn, role, text`` with faults put in by ``crc32(id:turn) % 20`` (nulls as one space): 0 drops the row, 1 empties its text, 2 takes out
    its ``.!?``, 3 repeats it, 4 makes its role user."""
    space = F.lit(" ")
    shown = [F.coalesce(F.col(c).cast("string"), space) for c in (id_col, turn_col)]
    fault = (F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).alias("fault")
    rows = conversations.select(F.col(id_col), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), fault)
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDINGS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.where("fault <> 0").select(id_col, "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def digest(conversations: DataFrame, repaired: Repaired, id_col: str = "conv_id") -> DataFrame:
    """The report of every conversation of ``conversations`` (zeros and an empty audit for those without rows) with ``repaired_sha256``: the
    repaired ``role:text``, newline-joined."""
    c = _key(id_col).alias("c")
    lines = repaired.turns.select(c, "place", F.concat("role", F.lit(":"), "text").alias("line"))
    sums = running_sha256(lines, ["c"], ["place"], "line", b"\n", "repaired_sha256")
    report = repaired.report.select("*", c).drop(id_col)
    every = conversations.select(c).distinct().join(report, "c", "left").join(sums, "c", "left")
    own_id = F.when(F.col("c") != "", F.substr("c", F.lit(2))).cast(conversations.schema[id_col].dataType).alias(id_col)
    numbers = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(own_id, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256"))
