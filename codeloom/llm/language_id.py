"""Language identification: an interpolated Kneser-Ney character model per language.

Text is a stream of folded letters and marks, with one boundary for any run of other characters. The n-grams of ``ORDER`` characters of all
learned documents are counted per language; lower orders count the distinct n-grams one longer that end in them (Kneser-Ney), each order has its own absolute
discount, and an n-gram's probability is its discounted share of its context plus the context's freed mass times the probability
one order lower. Counts, contexts and discounts are exact Spark aggregates over the whole corpus.

For scoring, n-grams and contexts go to ``SLOTS`` hash slots per order and language, kept as sorted slot numbers with one column of
weights per language: at most ``8 * SLOTS * (4 + 4 * languages)`` bytes (84 MB for four languages), whatever the corpus' size; those that share
a slot add up. A text gets the language of the lowest cross-entropy per character. Score and rejection are calibrated on all learned
documents: a logistic curve over the margin to the second language gives the score, and a text whose cross-entropy lies far above what its language's documents have is marked ``rejected``.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language first in the alphabet; texts of any length are read
whole, a stretch at a time; rows without a language are not learned from; without learned languages every text is ``und``; repeated rows are learned as often as they
occur and predicted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import small_batches, text_bytes
from codeloom.operators.ranking import with_position
from codeloom.session import cut_lineage

ORDER = 4
WIDTH = 16  # bits of a character
SLOTS = 1 << 19
UNKNOWN = "und"
FAR = 6.0
HELD = 1 << 20
CELLS = 1 << 22
_U = np.uint64


# Characters -------------------------------------------------------------------------------------------------


def _fold(code: int) -> int:
    """The 16-bit code of a letter or mark, 0 for any other character; letters beyond 16 bits share the private codes."""
    c = chr(code)
    if not (c.isalpha() or unicodedata.category(c)[0] == "M"):
        return 0
    low = c.lower()
    code = ord(low) if len(low) == 1 else code
    return code if code < 1 << WIDTH else 0xE000 + code % 0x1900


@lru_cache(maxsize=1)
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """Of all 16-bit characters: their folds, and which are letters."""
    return np.array([_fold(c) for c in range(1 << WIDTH)], dtype=np.uint64), np.array([chr(c).isalpha() for c in range(1 << WIDTH)])


def stream(text: bytes) -> np.ndarray:
    """The folded characters with single boundaries (0), ``ORDER - 1`` of them in front and one behind; empty for a text without a letter."""
    codes = np.frombuffer(text.decode(errors="replace").encode("utf-32-le"), dtype="<u4")
    folds, letters = _folds()
    low = np.minimum(codes, (1 << WIDTH) - 1)
    out, has = folds[low], bool(letters[low].any())
    for at in np.flatnonzero(codes >> WIDTH):
        out[at], has = _fold(int(codes[at])), has or chr(codes[at]).isalpha()
    if not has:
        return np.zeros(0, dtype=np.uint64)
    kept = out[(out > 0) | (np.concatenate([[0], out[:-1]]) > 0)]
    return np.concatenate([np.zeros(ORDER - 1, dtype=np.uint64), kept, np.zeros(int(kept[-1] > 0), dtype=np.uint64)])


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each character from the ``ORDER``-th on, as one number, the last character lowest."""
    n = len(codes) - ORDER + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(ORDER if n > 0 else 0):
        out = (out << _U(WIDTH)) | codes[k : k + n]
    return out


def stretches(texts: list[bytes], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The n-grams of the texts: numbers of texts and their n-grams, some ``most`` n-grams at a time; long texts go in parts."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        codes = stream(text)
        for at in range(0, max(len(codes) - ORDER + 1, 0), most):
            some = grams(codes[at : at + most + ORDER - 1])
            rows.append(row), parts.append(some)
            size += len(some)
            if size >= most:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


# The primes of XXH64.
P1, P2, P3, P4, P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def slots_of(x: np.ndarray) -> np.ndarray:
    """The slots of n-grams: their XXH64 with seed 42, as Spark's ``xxhash64`` of a long, less all but its low bits."""
    turn = lambda v, r: (v << _U(r)) | (v >> _U(64 - r))
    with np.errstate(over="ignore"):
        h = (_U(42) + P5 + _U(8)) ^ (turn(x * P2, 31) * P1)
        h = turn(h, 27) * P1 + P4
        h = (h ^ (h >> _U(33))) * P2
        h = (h ^ (h >> _U(29))) * P3
    return (h ^ (h >> _U(32))) & _U(SLOTS - 1)


# Learning ---------------------------------------------------------------------------------------------------


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(n, first)


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, g, n``: the n-grams of all documents per language, summed per task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                g, n = _merged(keys, counts)
                for at in range(0, len(g), 1 << 16):
                    some = g[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[at : at + (1 << 16)])], names=["lang", "g", "n"])

        for b in small_batches(batches):
            langs = b.column(0).to_pylist()
            for rows, parts in stretches(text_bytes(b.column(1)), HELD):
                by: dict[str, list[np.ndarray]] = {}
                for row, part in zip(rows, parts):
                    by.setdefault(langs[row], []).append(part)
                for lang, some in by.items():
                    g, n = np.unique(np.concatenate(some), return_counts=True)
                    keys, counts = held.setdefault(lang, ([], []))
                    keys.append(g), counts.append(n)
                    size += len(g)
                if size > HELD:
                    for lang, both in held.items():
                        g, n = _merged(*both)
                        held[lang] = ([g], [n])
                    size = sum(len(keys[0]) for keys, _ in held.values())
                    if size > HELD // 2:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    counted = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, g bigint, n bigint")
    return counted.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _slot(x: str) -> Column:
    return F.xxhash64(x).bitwiseAND(F.lit(SLOTS - 1))


def weights(counted: DataFrame) -> DataFrame:
    """``lang, part, slot, value``: part o is the discounted share of n-grams of o characters, part -o the freed mass of their contexts."""
    order, out = cut_lineage(counted), None
    for size in range(ORDER, 0, -1):
        if size < ORDER:
            shorter = F.col("g").bitwiseAND(F.lit((1 << WIDTH * size) - 1)).alias("g")
            order = cut_lineage(order.groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n")))
        once, twice = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        # Ney's estimate; where no n-gram occurs once, half a count.
        discount = F.when(once > 0, F.least(F.greatest(once / (once + 2 * twice), F.lit(0.1)), F.lit(0.9))).otherwise(F.lit(0.5))
        discounts = F.broadcast(order.groupBy("lang").agg(discount.alias("d")))  # one row per language
        rows = order.join(discounts, "lang").select("lang", _slot("g").alias("slot"), F.shiftrightunsigned("g", WIDTH).alias("h"), "n", "d").withColumn("context", _slot("h"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        shares = rows.join(contexts, ["lang", "context"]).groupBy("lang", "slot").agg(F.sum((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
        found = shares.select("lang", F.lit(size).alias("part"), "slot", "value").unionByName(
            contexts.select("lang", F.lit(-size).alias("part"), F.col("context").alias("slot"), (F.col("freed") / F.col("total")).alias("value"))
        )
        out = found if out is None else out.unionByName(found)
    return out.select("lang", F.col("part").cast("byte").alias("part"), F.col("slot").cast("int").alias("slot"), F.col("value").cast("float").alias("value"))


class Slots:
    """Sorted slot numbers with a row of values, one per language."""

    def __init__(self, slots: np.ndarray, langs: np.ndarray, values: np.ndarray, languages: int, missing: float):
        self.keys = np.unique(slots)
        self.values = np.full((len(self.keys) + 1, languages), missing, dtype=np.float32)  # the last row is for slots that are not there
        self.values[np.searchsorted(self.keys, slots), langs] = values

    def of(self, slots: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, slots)
        at[at == len(self.keys)] = 0
        return self.values[np.where(self.keys[at] == slots, at, len(self.keys)) if len(self.keys) else np.zeros(len(slots), dtype=np.int64)]


class Model:
    """The languages, their models, and the calibration of scores."""

    def __init__(self, languages: list[str], table: pa.Table | None):
        self.languages = languages
        self.curve, self.usual = (0.0, 1.0), np.zeros((len(languages), 2))
        if table is None:
            return
        lang = np.searchsorted(np.array(languages, dtype=object), np.array(table.column("lang").to_pylist(), dtype=object))
        part, slot, value = (table.column(c).to_numpy() for c in ("part", "slot", "value"))
        pick = lambda p, missing: Slots(slot[part == p].astype(np.uint64), lang[part == p], value[part == p], len(languages), missing)
        self.shares = [pick(size, 0.0) for size in range(1, ORDER + 1)]
        self.freed = [pick(-size, 1.0) for size in range(1, ORDER + 1)]
        self.least = 1.0 / (1 + len(self.shares[0].keys))  # an even share of all characters seen, and one more

    def log_probabilities(self, g: np.ndarray) -> np.ndarray:
        """Of n-grams, one column per language."""
        p = np.full((len(g), len(self.languages)), self.least, dtype=np.float32)
        for size in range(1, ORDER + 1):
            own = g & _U((1 << WIDTH * size) - 1) if size * WIDTH < 64 else g
            p = self.shares[size - 1].of(slots_of(own)) + self.freed[size - 1].of(slots_of(own >> _U(WIDTH))) * p
        return np.log(np.clip(p, 1e-12, 1.0))

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text, one column per language, and the number of characters (0: no letter)."""
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for rows, parts in stretches(texts, max(1 << 14, CELLS // max(len(self.languages), 1))):
            sizes = np.array([len(p) for p in parts])
            g, place = np.unique(np.concatenate(parts), return_inverse=True)
            logs = self.log_probabilities(g)
            np.add.at(sums, rows, np.add.reduceat(logs[place], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64))
            np.add.at(n, rows, sizes)
        return -sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool, float]]:
        """``(language, score, rejected, cross-entropy)`` of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, True, 0.0)] * len(texts)
        h, n = self.entropies(texts)
        best, x = h.argmin(axis=1), _signal(h, n)
        a, b = self.curve
        score = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        lowest = h[np.arange(len(h)), best]
        far = (lowest - self.usual[best, 0]) / np.sqrt(self.usual[best, 1] ** 2 + 4.0 / np.maximum(n, 1)) > FAR
        return [(self.languages[k], float(s), bool(f), float(e)) if size else (UNKNOWN, 0.0, True, 0.0) for k, s, f, e, size in zip(best, score, far, lowest, n)]


def _signal(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far the second language is from the first, over the whole text, on a log scale."""
    if h.shape[1] < 2:
        return np.log1p(n.astype(float))
    two = np.partition(h, 1, axis=1)[:, :2]
    return np.log1p(n * (two[:, 1] - two[:, 0]))


def _fit_curve(seen: DataFrame) -> tuple[float, float]:
    """``a, b`` of the share of right answers ``1 / (1 + exp(-(a + b x)))`` over all rows ``(x, right)``, by Newton steps, with a weak pull towards ``(0, 1)``.

    Each step is one aggregate; its terms are summed as decimals, so the sums are the same however the rows come in.
    """
    w, start, pull = np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.diag([0.5, 0.5])
    x = F.col("x")
    for _ in range(50):
        z = F.greatest(F.least(F.lit(float(w[0])) + F.lit(float(w[1])) * x, F.lit(30.0)), F.lit(-30.0))
        p = 1 / (1 + F.exp(-z))
        weight, off = p * (1 - p), F.col("right") - p
        terms = [weight, weight * x, weight * x * x, off, off * x]
        s = [float(v or 0) for v in seen.agg(*[F.sum(t.cast("decimal(28,15)")).alias(f"s{k}") for k, t in enumerate(terms)]).first()]
        step = np.linalg.solve(np.array([[s[0], s[1]], [s[1], s[2]]]) + pull, np.array(s[3:]) - pull @ (w - start))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _medians(rows: DataFrame) -> dict[int, float]:
    """The median of ``v`` per ``lang``: the values are placed in order over the cluster, and the middle ones come to the driver."""
    n = F.broadcast(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # one row per language
    placed = with_position(rows, ["v"], ["lang"], "at").join(n, "lang")
    middle = placed.where((F.col("at") == F.floor((F.col("n") + 1) / 2)) | (F.col("at") == F.floor(F.col("n") / 2) + 1))
    return dict(middle.groupBy("lang").agg(F.avg("v")).collect())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from, and calibrate on, every document with a language. What comes to the driver is bounded: at most ``8 * SLOTS`` numbers per
    language, the sums of a Newton step, and two medians per language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    table = weights(count_grams(usable, text_col, lang_col)).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    model = Model(languages, table if languages else None)
    if not languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in small_batches(batches):
            h, n = own.entropies(text_bytes(b.column(1)))
            given = np.searchsorted(np.array(own.languages, dtype=object), np.array(b.column(0).to_pylist(), dtype=object)) if b.num_rows else np.zeros(0, int)
            keep = n > 0
            right = h.argmin(axis=1) == given
            own_h = h[np.arange(len(h)), np.minimum(given, len(own.languages) - 1)]
            columns = [given.astype(np.int32), right.astype(np.int32), _signal(h, n), own_h]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["lang", "right", "x", "h"])

    learned = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    seen = cut_lineage(learned.mapInArrow(measure, "lang int, right int, x double, h double"))
    if not seen.isEmpty():
        model.curve = _fit_curve(seen)
    middle = _medians(seen.select("lang", F.col("h").alias("v")))
    usual = F.lit(0.0)
    for k, m in middle.items():
        usual = F.when(F.col("lang") == k, m).otherwise(usual)
    spread = _medians(seen.select("lang", F.abs(F.col("h") - usual).alias("v")))
    for k in range(len(languages)):
        # Without a document to judge by nothing is far.
        model.usual[k] = (middle[k], 1.4826 * spread[k]) if k in middle else (np.inf, 0.0)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, lang_pred, score, rejected, cross_entropy`` of every document. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            got = shared.value.predict(text_bytes(b.column(1)))
            columns = [pa.array(x, k) for x, k in zip(zip(*got), (pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, "lang_pred", "score", "rejected", "cross_entropy"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")
