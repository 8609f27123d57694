"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding: lower case and compatibility forms, look-alike letters of other scripts become Latin ones, digits and signs
inside a word become the letters they stand for, everything that is no letter parts words. Lexicon entries are whole words or
beginnings of words. They and their weights are learned from labelled documents: an entry is taken while it explains
toxic documents that no earlier entry explains, so words that merely occur in copies of a toxic document are not.

Edge cases: null and empty texts have no matches and get the score of a text without matches; texts of any length
are read whole; repeated rows score alike; rows without a usable label are not learned from; without toxic or clean examples
(or tables without rows) the lexicon is empty and every score is the smoothed share of toxic examples; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Memo, released, small_batches, text_bytes
from codeloom.session import cut_lineage

TRAIN_ROWS = 20_000
LEAST_TOXIC = 4
LEAST_GAIN = 14.0
CANDIDATES = 20_000
PREFIX_LENGTHS = (4, 5, 6, 7, 8)
CHUNKS_KEPT = 300_000
ON_THRESHOLD = 0.7
TWICE = "2"

# Letters of other scripts that look like Latin ones, and signs that stand for letters inside words.
LOOKALIKES = dict(zip("аеіјорсухѕһԁԛԝᴀαονρτυχкмтнвάόί", "aeijopcyxshdqwaaovptuxkmthvaoi"))
SIGNS = dict(zip("0134578@$!|€£", "oieastbasiiel"))
# Fixed value: phrases in which a lexicon word is not meant as an insult.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "trash collection", "clown fish", "clown car", "idiot proof", "idiot s guide", "sore loser", "pathetic fallacy", "pond scum")

INNER = re.compile(r"[^\W_]")
_LETTERS = str.maketrans(LOOKALIKES)
_SIGNS = str.maketrans(SIGNS)
_WORDS = re.compile(r"[^\W\d_]+")


def fold_chunk(chunk: bytes) -> str:
    """The folded words of a white-space separated chunk, space-joined."""
    core = chunk.strip(b".,;:!?()*#%&|")
    if core.isalpha():  # of bytes: A-Z and a-z only
        return core.lower().decode()
    text = chunk.decode()
    if not (text.isascii() and text.isalpha()):
        text = unicodedata.normalize("NFKC", text).replace("​", "").replace("­", "")
    text = text.lower().translate(_LETTERS)
    if not text.isalpha():
        text = "".join(_unsigned(part) for part in re.split(r"([^\w@$!|€£]+)", text))
    return " ".join(_WORDS.findall(text))


def _unsigned(part: str) -> str:
    """Signs between the first and the last letter or digit become letters, in parts that have a letter."""
    inner = [m.start() for m in INNER.finditer(part)]
    if not inner or not _WORDS.search(part):
        return part
    start = min(inner[0], next((k for k, c in enumerate(part) if c in "@$"), inner[0]))
    return part[:start] + part[start : inner[-1] + 1].translate(_SIGNS) + part[inner[-1] + 1 :]


_folded = Memo(fold_chunk, CHUNKS_KEPT)


def forget() -> None:
    _folded.clear()


def fold(text: bytes) -> str:
    """Folded words between single spaces, with a space at either end."""
    return " " + " ".join(filter(None, map(_folded.__getitem__, text.split()))) + " "


# Learning ---------------------------------------------------------------------------------------------------


def _features(folded: str) -> set[str]:
    """Whole words (``" word "``) and beginnings of words (``" wor"``); those that occur twice or more also marked with ``TWICE``."""
    counts: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        counts[f" {w} "] += n
        for size in PREFIX_LENGTHS:
            if len(w) < size:
                break
            counts[f" {w[:size]}"] += n
    return set(counts) | {TWICE + w for w, n in counts.items() if n > 1}


def _gain(t: float, c: float, toxic: float, clean: float) -> float:
    """Log-likelihood ratio (times two) of the entry's counts against an equal share; 0 where it is no sign of toxicity."""
    if t * clean <= c * toxic:
        return 0.0
    p, q, r = (t + 0.5) / (toxic + 1), (c + 0.5) / (clean + 1), (t + c + 1) / (toxic + clean + 2)
    side = lambda k, n, p: k * math.log(p) + (n - k) * math.log(1 - p)
    return 2 * (side(t, toxic, p) + side(c, clean, q) - side(t, toxic, r) - side(c, clean, r))


def _weight(t: float, c: float, toxic: float, clean: float) -> float:
    return math.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))


def choose(rows: list[tuple[int, list[str]]], toxic: int, clean: int) -> dict[str, float]:
    """Entries with weights: greedily the one with the greatest gain among toxic documents not yet explained.

    ``rows`` are ``(label, entries)`` of the documents that have any candidate. Ties: single before repeated, whole words before
    beginnings, long before short, then alphabetically. An explained document no longer counts for or against later
    entries. What is a sign only where it is repeated (a stem that clean texts have now and then) gets half the weight per match.
    """
    having: dict[str, list[int]] = {}
    for k, (_, terms) in enumerate(rows):
        for term in terms:
            having.setdefault(term, []).append(k)
    counts = {term: [sum(rows[k][0] for k in ks), sum(1 - rows[k][0] for k in ks)] for term, ks in having.items()}
    lexicon: dict[str, float] = {}
    explained = [False] * len(rows)
    while counts:
        term = max(counts, key=lambda w: (_gain(*counts[w], toxic, clean), w[0] != TWICE, w[-1] == " ", len(w), w))
        t, c = counts.pop(term)
        if t < LEAST_TOXIC or _gain(t, c, toxic, clean) < LEAST_GAIN:
            break
        per_match, plain = _weight(t, c, toxic, clean) / (1 + (term[0] == TWICE)), term.removeprefix(TWICE)
        lexicon[plain] = max(per_match, lexicon.get(plain, 0.0))
        for k in having[term]:
            label, terms = rows[k]
            if label and not explained[k]:
                explained[k] = True
                for other in terms:
                    if other in counts:
                        counts[other][0] -= 1
        counts = {w: n for w, n in counts.items() if n[0] >= LEAST_TOXIC}
    return lexicon


def _extended(lexicon: dict[str, float], rows: list[tuple[int, list[str]]], toxic: int, clean: int) -> dict[str, float]:
    """Add the entries that are as clean a sign as the chosen ones but occur beside them: whole words or beginnings found in
    toxic documents only, in clearly more different documents than copies of one text could give."""
    counts: dict[str, list[int]] = {}
    company: dict[str, Counter] = {}
    for label, terms in rows:
        chosen = [w for w in terms if w in lexicon]
        for w in terms:
            n = counts.setdefault(w, [0, 0])
            n[1 - label] += 1
            if label:
                company.setdefault(w, Counter()).update(x for x in chosen if not (x.startswith(w) or w.startswith(x)))
    return lexicon | {
        w: _weight(t, c, toxic, clean)
        for w, (t, c) in counts.items()
        if w[0] == " " == w[-1] and w not in lexicon and t >= 0.02 * toxic and t >= 10 and c <= 0.002 * t and len(company.get(w, ())) >= 2
    }


class Matcher:
    """Aho-Corasick over folded text."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase), None))
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term.strip()), weight))
        self.empty = not len(self.automaton)
        self.automaton.make_automaton() if not self.empty else None

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """``(place, weight)`` of the matches outside exceptions, one for each word: its weightiest."""
        if self.empty:
            return []
        spared, best = [], {}
        for end, (length, weight) in self.automaton.iter(folded):
            start = end - length + (folded[end] != " ")
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), weight)
        return [(s, w) for s, w in sorted(best.items()) if not any(a <= s < b for a, b in spared)]

    def signal(self, text: bytes) -> tuple[float, int]:
        """Weight per logarithm of the length, and the number of hits."""
        folded = fold(text)
        hits = self.hits(folded)
        return (sum(w for _, w in hits) / math.log2(2 + folded.count(" ")), len(hits)) if hits else (0.0, 0)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """``a, b`` of the score ``1 / (1 + exp(-(a + b x)))``: logistic regression with a weak pull of b towards 0, by Newton steps."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    a, b = math.log(share / (1 - share)), 0.0
    if not len(y) or x.max(initial=0) <= 0:
        return a, b
    z = np.stack([np.ones_like(x), x], axis=1)
    w, ridge = np.array([a, b]), np.diag([1e-6, 0.002])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(2), z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


class Model:
    def __init__(self, lexicon: dict[str, float], a: float, b: float):
        self.lexicon, self.a, self.b = lexicon, a, b

    def scorer(self):
        matcher = Matcher(self.lexicon)

        def score(text: bytes) -> tuple[float, int]:
            x, n = matcher.signal(text)
            return 1 / (1 + math.exp(-min(30.0, self.a + self.b * x))), n

        return score


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``toxic, term, n``: documents per entry and label, counted per task before they move."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in small_batches(batches):
        for label, text in zip(b.column(1).to_pylist(), text_bytes(b.column(0))):
            counts[label].update(_features(fold(text)))
    for label in (0, 1):
        terms = list(counts[label])
        for at in range(0, len(terms), 50_000):
            some = terms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.int32()), pa.array(some), pa.array([counts[label][w] for w in some], pa.int64())], names=["toxic", "term", "n"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most about ``train_rows`` labelled documents, taken by a hash of their ids; equal texts count once.

    Candidate entries are counted over all of these; the documents' lists of candidates (at most ``train_rows``) come to the driver.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, train_rows / max(n, 1))
    picked = cut_lineage(usable.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000)))
    train = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "k")  # the sample's size is bounded
    # Equal texts count once, with the label most of them have.
    train = cut_lineage(train.groupBy("text").agg(F.round(F.avg("toxic")).cast("int").alias("toxic")))
    sizes = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model({}, *_fit_curve(np.zeros(toxic + clean), np.array([1.0] * toxic + [0.0] * clean)))
    counted = train.select("text", "toxic").mapInArrow(lambda batches: released(_spread(batches), forget), "toxic int, term string, n bigint").groupBy("term")
    both = counted.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    lift = (F.col("t") + 0.5) * (clean + 1) / ((F.col("c") + 0.5) * (toxic + 1))
    likely = both.where((F.col("t") >= LEAST_TOXIC) & (lift > 8)).orderBy(F.desc(F.col("t") * F.log(lift)), "term").limit(CANDIDATES)
    terms = {r.term for r in likely.select("term").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            own = [sorted(_features(fold(t)) & shared.value) for t in text_bytes(b.column(0))]
            rows = [k for k, x in enumerate(own) if x]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(rows, pa.int64())), pa.array([own[k] for k in rows], pa.list_(pa.string()))], names=["toxic", "terms"])

    rows = [(r.toxic, r.terms) for r in train.select("text", "toxic").mapInArrow(lambda batches: released(having(batches), forget), "toxic int, terms array<string>").collect()]
    rows.sort()
    lexicon = _extended(choose(rows, toxic, clean), rows, toxic, clean)

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([matcher.signal(t)[0] for t in text_bytes(b.column(0))], pa.float64())], names=["toxic", "x"])

    seen = train.select("text", "toxic").mapInArrow(lambda batches: released(signals(batches), forget), "toxic int, x double").groupBy("toxic", "x").count().collect()
    seen.sort()
    x, y, k = (np.array([r[i] for r in seen], dtype=float) for i in (1, 0, 2))
    return Model(lexicon, *_fit_curve(np.repeat(x, k.astype(int)), np.repeat(y, k.astype(int))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, score, n_hits`` of every document. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for b in small_batches(batches):
            got = [rate(t) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([n for _, n in got], pa.int64())], names=[id_col, "score", "n_hits"])

    return docs.select(id_col, text_col).mapInArrow(lambda batches: released(run(batches), forget), f"`{id_col}` {kind}, score double, n_hits bigint")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = ON_THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` that score below the threshold."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for b in small_batches(batches):
            yield b.filter(pa.array([rate(t)[0] < threshold for t in text_bytes(b.column(at))], pa.bool_()))

    return docs.mapInArrow(lambda batches: released(run(batches), forget), docs.schema)
