import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from codeloom.llm import structure_repair as sr

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")


@lru_cache(maxsize=None)
def ordered_marks(spark, rows):
    """Turns of one conversation in the stated order: ties of a turn by the hash of role and text."""
    df = spark.createDataFrame([(k, r, t) for k, (_, r, t) in enumerate(rows)], "k int, role string, text string")
    given = sr._given(df.selectExpr("1L AS conv_id", "k AS turn", "role", "text"), "conv_id", "turn", "role", "text")
    marks = {r.turn: (r.l1, r.l2) for r in given.collect()}
    return [x for _, x in sorted(enumerate(rows), key=lambda e: (e[1][0] is not None, e[1][0] or 0, marks[e[0]]))]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "fine")
        seen.add((role, text))
    return out


def all_edits(initials, gone, cut):
    """Every cheapest edit sequence of a short conversation, by trying out all that cost little enough."""
    best = [3 * len(initials) + sum(0 for _ in cut), set()]

    def go(k, roles, cost, audit):
        if cost > best[0] or not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if k == len(initials) and PATTERN.fullmatch(roles):
            if cost < best[0]:
                best[0], best[1] = cost, set()
            best[1].add(audit)
        for c in "ua":
            go(k, roles + c, cost + 2, audit + "I")
        if k < len(initials):
            go(k + 1, roles, cost + 3, audit + "D")
            if not gone[k]:
                go(k + 1, roles + initials[k], cost + cut[k], audit + "K")
                for c in "ua":
                    go(k + 1, roles + c, cost + 2 + cut[k], audit + "R")

    go(0, "", 0, "")
    return best[0], min(best[1])


def test_edits_are_the_cheapest_and_least():
    r = random.Random(7)
    cases = [tuple(x) for n in range(4) for x in itertools.product(range(12), repeat=n)]
    cases = r.sample(cases, 400) + [tuple(r.choices(range(12), [4, 4, 4, 1, 2, 2, 2, 1, 1, 1, 1, 1], k=r.randint(4, 6))) for _ in range(60)]
    for symbols in cases:
        initials = "".join("suax"[s % 4] for s in symbols)
        expected = all_edits(initials, [s // 4 == sr.GONE for s in symbols], [int(s // 4 == sr.TRUNCATED) for s in symbols])
        assert sr.plan(bytes(symbols), {}) == expected, symbols


def step_by_step(symbols):
    costs = [sr.AT_END]
    for s in reversed(symbols):
        costs.append(sr._apply(sr.power(s, 0), costs[-1]))
    return costs[-1][0]


@pytest.mark.parametrize("cell", [1, 3, sr.BLOCK])
def test_runs_equal_single_steps(cell):
    r = random.Random(9)
    for _ in range(60):
        symbols = b"".join(bytes([r.randrange(12)]) * r.randint(1, 40) for _ in range(r.randint(1, 6)))
        cost, audit = sr.letters(sr.runs_of(symbols, {}), cell)
        text = "".join(audit)
        assert cost == step_by_step(symbols) and text == "".join(sr.letters([(s, 1) for s in symbols])[1])
        assert sum(c != "I" for c in text) == len(symbols)


def test_copies_are_duplicates_right_after_their_turn():
    assert sr.runs_of(bytes([sr.U, sr.A]), {0: 3}) == [(sr.U, 1), (8 + sr.U, 2), (sr.A, 1)]
    cost, audit = sr.plan(bytes([sr.U, sr.A]), {0: 10**6})
    assert cost == 3 * (10**6 - 1) and audit == "K" + "D" * (10**6 - 1) + "K"


def plain(spark, conv, rows):
    """The contract's row of one conversation; ``rows`` are (turn, role, text)."""
    damaged = []
    for turn, role, text in rows:
        shown = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(shown.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        damaged += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    damaged = sorted(damaged, key=lambda x: (x[0] is not None, x[0] or 0))
    if len({x[0] for x in damaged}) < len(set(damaged)):
        damaged = ordered_marks(spark, tuple(damaged))
    own = [(r, t) for _, r, t in damaged]
    found = faults(own)
    numbers = [x[0] for x in damaged if x[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in own)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = all_edits(initials, [f in ("blank", "duplicate") for f in found], [int(f == "truncated") for f in found])
    lines, k = [], 0
    for letter in audit:
        expected = "assistant" if lines and lines[-1][0][0] == "u" else "user"
        if letter == "I":
            lines.append((expected, ""))
            continue
        if letter != "D":
            lines.append(own[k] if letter == "K" else (expected, own[k][1]))
        k += 1
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digest(df):
    done = sr.digest(df, sr.repair(sr.damage(df)))
    return sorted((tuple(r[c] for c in COLUMNS) for r in done.collect()), key=repr)


def test_equals_brute_force_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    by = {}
    for r in table.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert digest(table) == sorted((plain(spark, c, rows) for c, rows in by.items()), key=repr)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(sr, "BLOCK", 3)
    r = random.Random(2)
    rows = [(None, 1, "user", "Hello."), (None, None, None, None), (7, None, "user", "No turn"), (7, None, "user", "No turn"), (7, 3, "", "x"), (8, 2, "tool", "a " * 100_000)]
    rows += [(c, r.choice([None, k, k]), r.choice(["user", "assistant", "system", "User", None]), r.choice(["Yes.", "No", "", " \t", None, "Yes."])) for c in range(20, 40) for k in range(r.randint(1, 6))]
    spare = ["c", "at", "place", "n", "symbol", "l1", "fault", "block", "copy"]
    df = spark.createDataFrame([(*x, *["?"] * len(spare)) for x in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} string" for c in spare))
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    assert digest(df) == sorted((plain(spark, c, x) for c, x in by.items()), key=repr)
    assert digest(df.limit(0)) == [] and sr.repair(df.limit(0)).turns.collect() == []


def test_a_conversation_of_many_copies_and_one_of_many_turns(spark):
    rows = [(1, 0, "user", "Hi.")] * 3000 + [(2, k, "user", f"Turn {k}.") for k in range(9001)]
    done = sr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    report = {r.conv_id: r for r in done.report.collect()}
    assert (report[1].duplicate, report[1].cost, report[1].illegal, report[1].audit) == (2999, 2 + 3 * 2999, 2999, "K" + "D" * 2999 + "I")
    # Every other turn becomes the assistant's; the last one needs an answer.
    assert report[2].cost == 2 * 4500 + 2 and report[2].gaps == 0 and report[2].truncated == 0
    turns = done.turns.where("conv_id = 2").orderBy("place").collect()
    assert [t.role[0] for t in turns] == list("ua" * 4501) and [t.text for t in turns if t.edit != "I"] == [f"Turn {k}." for k in range(9001)]
