"""The plug-in points for models: text in, text or vector out, in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.session import stored

Responder = Callable[[list[str], list[str | None]], list[str | None]]
Embedder = Callable[[list[str]], list[Sequence[float] | None]]
ATTEMPTS = 3  # fixed value: tries per request
#: Bytes of requests that a task hands to a model at a time (more only for a single request of that size).
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Arrow batches hold at most ``BATCH_BYTES``: by rows alone, 10,000 requests of 100,000 characters are one batch."""
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_KEY) if before is None else spark.conf.set(_BATCH_KEY, before)


def _halving(call: Callable[[list], list], items: list) -> tuple[list, list[str | None]]:
    """``call`` over as many items at a time as it takes: a failing run is halved down to single items.

    Gives the answers, None where an item alone fails, and the error of each such item.
    """
    try:
        answers = list(call(items))
        if len(answers) != len(items):
            raise ValueError(f"{len(answers)} answers to {len(items)} prompts")
        return answers, [None] * len(items)
    except Exception as e:  # a model may fail in any way
        if len(items) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(items) // 2
    first, second = _halving(call, items[:half]), _halving(call, items[half:])
    return first[0] + second[0], first[1] + second[1]


def respond(requests: DataFrame, responder: Responder, key: Sequence[str] = ("id",)) -> DataFrame:
    """Call ``responder(prompts, models)`` per Arrow batch of ``requests(key..., prompt[, model])``.

    Gives ``key..., response, error``. A failing batch is asked again in halves, so only the prompts that
    fail by themselves yield null responses, with the error text, instead of failing the job. The result
    is materialised, as calls are slow and need not answer the same way twice. A key may be a struct: rows
    that go along with their request need not be joined with the answers.
    """
    return _asked(requests, responder, list(key))


def _asked(requests: DataFrame, responder: Responder, key: list[str], is_valid=None) -> DataFrame:
    """:func:`respond`; with ``is_valid`` also ``_ok``, and ``prompt`` and ``model`` of the rows that are to be asked again."""
    if "model" not in requests.columns:
        requests = requests.withColumn("model", F.lit(None).cast("string"))
    asked = requests.select(*key, "prompt", "model")
    kept = [] if is_valid is None else ["prompt", "model"]
    schema = StructType([asked.schema[c] for c in [*key, *kept]]).add("response", "string").add("error", "string")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            prompts, models = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("prompt", "model"))
            asked_for = [(p, m if isinstance(m, str) else None) for p, m in zip(prompts, models)]
            answers, errors = _halving(lambda some: responder([p for p, _ in some], [m for _, m in some]), asked_for)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*key, *kept]]  # they stay as they are, whatever their type
            yield pa.RecordBatch.from_arrays([*columns, pa.array(answers, pa.string(), from_pandas=True), pa.array(errors, pa.string())], schema.names)

    with _small_batches(requests.sparkSession):
        got = asked.mapInArrow(run, schema)
        if is_valid is not None:
            got = got.withColumn("_ok", F.coalesce(is_valid, F.lit(False)))
            got = got.withColumns({c: F.when(~F.col("_ok"), F.col(c)) for c in kept})
        return stored(got, "answers")


def replay(requests: DataFrame, recorded: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Answer requests from a table of recorded responses; no record means a null response."""
    key = list(key)
    answers = recorded.select(*key, "response")
    out = requests.select(*key).join(answers, key, "left")
    return out.withColumn("error", F.when(F.col("response").isNull(), "no_response"))


def respond_until_valid(
    requests: DataFrame,
    responder: Responder,
    is_valid,
    key: Sequence[str] = ("id",),
    attempts: int = ATTEMPTS,
) -> tuple[DataFrame, DataFrame]:
    """Ask again for what came back unusable, a bounded number of times.

    ``is_valid`` is a Column over ``response``. Returns accepted rows and the rows still
    failing, both with the ``attempt`` they were last asked in.
    """
    key, accepted, left = list(key), None, requests
    for attempt in range(1, attempts + 1):
        got = _asked(left, responder, key, is_valid)
        rows = got.select(*key, "response", "error", F.lit(attempt).cast("bigint").alias("attempt"), "_ok")
        good, bad = rows.filter("_ok").drop("_ok"), rows.filter("NOT _ok").drop("_ok")
        accepted = good if accepted is None else accepted.unionByName(good)
        if attempt == attempts or bad.isEmpty():
            return accepted, bad
        left = got.filter("NOT _ok").dropna(subset=key).select(*key, "prompt", "model")


class Retry(NamedTuple):
    """Which errors of a model pass, and how often and how patiently it is asked again.

    An item is tried ``tries`` times; after a passing error the items of that call wait, at first ``first_wait`` seconds and twice as long each
    time up to ``longest_wait``, and go into calls of a quarter of the size. Calls of a task keep ``interval`` seconds apart.
    """

    errors: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)
    tries: int = 5  # fixed value
    first_wait: float = 2.0  # fixed value
    longest_wait: float = 60.0  # fixed value
    batch: int = 100  # fixed value: items per call
    interval: float = 0.0


def retrying(call: Callable[[list], list], items: list, policy: Retry, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> tuple[list, list[str | None]]:
    """``call`` over ``items`` under a policy: the answers (None where there is none) and the error of each item that has one.

    Only listed errors are waited out. A call that fails in any other way is asked again in halves at once, so the items that
    fail by themselves are found and the others are answered.
    """
    answers: list = [None] * len(items)
    errors: list[str | None] = [None] * len(items)
    last = -float("inf")

    def ask(some: list[int]) -> list[int]:
        """The items that met a passing error."""
        nonlocal last
        due = last + policy.interval - clock()
        if due > 0:
            sleep(due)
        last = clock()
        try:
            got = list(call([items[k] for k in some]))
            if len(got) != len(some):
                raise ValueError(f"{len(got)} answers to {len(some)} items")
        except Exception as e:  # a model may fail in any way
            text = f"{type(e).__name__}: {e}"
            if isinstance(e, policy.errors):
                for k in some:
                    errors[k] = text
                return some
            if len(some) == 1:
                errors[some[0]] = text
                return []
            half = len(some) // 2
            return ask(some[:half]) + ask(some[half:])
        for k, answer in zip(some, got):
            answers[k], errors[k] = answer, None
        return []

    left, size = list(range(len(items))), max(1, policy.batch)
    for attempt in range(policy.tries):
        left = [k for at in range(0, len(left), size) for k in ask(left[at : at + size])]
        if not left:
            break
        if attempt + 1 < policy.tries:
            sleep(min(policy.longest_wait, policy.first_wait * 2**attempt))
            size = max(1, size // 4)
    return answers, errors


def embed(df: DataFrame, text: str, embedder: Embedder, retry: Retry | None = None, error: str | None = None) -> DataFrame:
    """Add ``embedding array<float>`` by calling ``embedder(texts)`` per Arrow batch, and the error text as column ``error`` if named.

    An item without a vector stays null; a failing batch is halved, so only texts that fail by themselves stay null. With ``retry``,
    errors that pass are waited out first. Null and blank texts are not asked for.
    """
    schema = df.schema.simpleString()[len("struct<") : -1]

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            texts = list(pdf[text])
            asked = [k for k, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            call = lambda some: [None if v is None else [float(x) for x in v] for v in embedder(some)]
            some = [texts[k] for k in asked]
            vectors, wrong = _halving(call, some) if retry is None and some else retrying(call, some, retry or Retry())
            by, why = dict(zip(asked, vectors)), dict(zip(asked, wrong))
            out = pdf.assign(embedding=[by.get(k) for k in range(len(texts))])
            yield out if error is None else out.assign(**{error: [why.get(k) for k in range(len(texts))]})

    return df.mapInPandas(run, f"{schema},embedding:array<float>" + (f",{error}:string" if error else ""))
