"""Quality rules, in DataFrame functions only: base rules on words and lines, then a hashed n-gram likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets, of the trusted documents and of the whole
corpus, give each bucket the weight ``log(p_trusted / p_corpus)``. A document's score is its mean weight per n-gram, so long
and short texts compare; every document at or above the threshold is kept, with no random draw.

Edge cases: a null text has no words, like an empty one: it fails the base rules; texts of any length are read whole; repeated
rows are judged alike; rows with null ids are never trusted; without trusted documents all weights are 0 and only the base rules decide;
an empty table gives an empty result; other columns are ignored.

Repeated three-word windows are found by sorting 64-bit keys of hash and place within a text, not by string; a wrong count would need two
different windows of one text with the same 40 or more hash bits, one of them repeated around the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import let, words_of
from codeloom.session import cut_lineage

BUCKETS = 1 << 16
#: Pseudo-counts per bucket, spread over both multinomials by their sizes: rare buckets weigh little.
SMOOTHING = 10.0
THRESHOLD = -0.1
LEAST_WORDS = 50
#: Trusted ids are broadcast up to this many (about 32 MB), beyond that joined by shuffle.
BROADCAST_IDS = 2_000_000
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window that occurs twice or more; ``words`` is a bound variable."""
    n = F.size(words)
    places = F.sequence(F.lit(0), n - 3)

    def key(i: Column, width: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(words[i], words[i + 1], words[i + 2]), width).bitwiseOR(i.cast("bigint"))

    def covered(keys: Column, width: Column) -> Column:
        # Neighbours of one window differ in the bits of the place alone; there is none, a null, before the first and behind the last.
        same = lambda a, b: F.call_function("shiftrightunsigned", a.bitwiseXOR(b), width) == 0
        twice = F.filter(keys, lambda k, j: same(F.get(keys, j + 1), k) | same(F.get(keys, j - 1), k))
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1
        starts = F.sort_array(F.transform(twice, lambda k: k.bitwiseAND(low)))
        # Each window covers three words, or those before the next window begins.
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(s, j + 1) - x, F.lit(3).cast("bigint")))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    # The bits for a place in the text are bound once: inside a lambda they would be worked out again for every window.
    counted = let(F.length(F.bin(n)), lambda width: let(F.sort_array(F.transform(places, lambda i: key(i, width))), lambda keys: covered(keys, width)))
    return F.when(n < 3, F.lit(0).cast("bigint")).otherwise(counted)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def _buckets(words: Column, buckets: int) -> Column:
    """The buckets of all words and word pairs; ``words`` is a bound variable."""
    n, one, mask = F.size(words), F.lit(1), F.lit(buckets - 1)
    single = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(mask).cast("int"))
    places = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 2))
    pairs = F.transform(places, lambda i: F.xxhash64(words[i], words[i + one]).bitwiseAND(mask).cast("int"))
    return F.concat(single, pairs)


def bucket_weights(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bucket, weight`` for the buckets that occur: at most ``buckets`` rows.

    Counts cover all documents; they are summed per task before they move.
    """
    trusted = trusted_ids.select(F.col(id_col).alias("_trusted")).where(F.col(id_col).isNotNull()).distinct()
    if trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    marked = docs.select(id_col, F.col(text_col).alias("_text")).join(trusted, F.col(id_col) == F.col("_trusted"), "left")
    found = let(words_of(F.col("_text")), lambda w: _buckets(w, buckets))
    grams = marked.select(F.col("_trusted").isNotNull().alias("good"), F.explode(found).alias("bucket"))
    counts = cut_lineage(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("corpus"), F.count_if("good").alias("good")))
    total = counts.agg(F.sum("corpus").alias("corpus_n"), F.sum("good").alias("good_n")).first()  # one row
    good_n, corpus_n = float(total.good_n or 0), float(total.corpus_n or 0)
    share = good_n / max(corpus_n, 1.0)
    # Equal to (good + S share) / (good_n + S share B) over (corpus + S) / (corpus_n + S B), with B buckets. The corpus' count is
    # one less, for the n-gram being scored: else what is rare would look untrusted because its own document has it.
    ratio = (F.col("good") + SMOOTHING * share) / ((F.col("corpus") - 1 + SMOOTHING) * share) if good_n else F.lit(1.0)
    return counts.select("bucket", F.log(ratio).alias("weight"))


def _constant(weights: DataFrame, buckets: int) -> Column:
    """The weights by bucket as a constant array, 0 where a bucket does not occur: ``buckets`` numbers, whatever the corpus' size."""
    dense = ["0"] * buckets
    for r in weights.collect():
        dense[r.bucket] = f"{r.weight:.6g}"
    return F.split(F.lit(",".join(dense)), ",").cast("array<double>")


def judge(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`` of every document.

    The bucket weights (a fixed number of them) are a constant of the plan, so scoring moves no rows.
    """
    weights = _constant(bucket_weights(docs, trusted_ids, buckets, id_col, text_col), buckets)
    text = F.coalesce(F.col(text_col), F.lit(""))
    mean = lambda words: let(
        weights,
        lambda w: let(
            _buckets(words, buckets),
            lambda found: F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(w, b)) / F.size(found)).otherwise(F.lit(0.0)),
        ),
    )
    measured = let(
        words_of(text),
        lambda words: F.struct(F.size(words).cast("bigint").alias("n_words"), _repeat_words(words).alias("n_repeat_words"), mean(words).alias("score")),
    )
    rows = docs.select(
        id_col,
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _dup_lines(text).alias("n_dup_lines"),
        F.explode(F.array(measured)).alias("m"),
    )
    failed = (F.col("m.n_words") < LEAST_WORDS) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    return rows.select(
        id_col, "m.n_words", "word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), "m.score", (~failed & (F.col("m.score") >= threshold)).alias("kept")
    )
