"""Benchmark decontamination by spaced seeds.

Fixed masks cover ``span`` neighbouring tokens and ignore some of them, so a seed still matches where an ignored token was
substituted. Test items and documents are hashed under every mask. A bit table of fixed size over the test hashes decides which
document positions can matter; those are joined with the test hashes, and each hit fixes a diagonal (place in the document less place in
the item) along which tokens are compared: a document is contaminated where a stretch of ``WINDOW`` tokens (or the whole item, if it is
shorter) agrees in at least ``AGREE`` of its tokens.

Tokens are runs of letters and digits, lower-cased. The document side sends rows only for positions that pass the bit table:
stretches of tokens around them, and runs of neighbouring hashes. A run is looked up once however many documents have it, so a
passage found in a third of all documents costs one look-up and one diagonal per document. The benchmark is never assumed to
be small: Spark joins by hash, and broadcasts a side only where its own size check allows.

Items of fewer than ``WINDOW`` tokens have masks of their own: their tokens in five parts, less any as many parts as substitutions are
allowed, so whichever tokens are substituted, one mask ignores them all.

Edge cases: null and empty texts match nothing; items without a token match nothing; repeated items and rows give repeated results per row; a document is named by its id and its text's MD5, so
equal ids with different texts are told apart; an empty table on either side gives no matches; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Memo, fresh, released, small_batches, text_bytes
from codeloom.session import cut_lineage

# The masks, 1 for a token that counts. A 13-token stretch with two substitutions matches one of them.
MASKS = ("11111111", "1101001011", "10010011011", "111000111011")
WINDOW = 13
AGREE = 0.8
BITS = 24
KEPT = 300_000
#: Lines of a run that are tried first, and how many times more each further round tries.
LINES_AT_ONCE, GROWTH = 8, 8
TOKEN = re.compile(r"[^\W_]+")
_U = np.uint64


def _hash_tokens(chunk: bytes) -> bytes:
    core = chunk.strip(b".,;:!?()*#%&|")
    words = [core.lower()] if core.isalpha() else [w.encode() for w in TOKEN.findall(chunk.decode().lower())]
    return b"".join([xxhash.xxh64_digest(w) for w in words])


_chunks = Memo(_hash_tokens, KEPT)


def forget() -> None:
    _chunks.clear()


def token_hashes(text: bytes) -> np.ndarray:
    return np.frombuffer(b"".join(map(_chunks.__getitem__, text.split())), dtype=">u8").astype(np.uint64)


def _seed(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of every position under a mask; empty for texts shorter than the mask."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), salt, dtype=np.uint64)
    if n > 0:
        for k, used in enumerate(mask):
            if used == "1":
                out ^= tokens[k : k + n]
                out *= _U(0x9E3779B97F4A7C15)
                out ^= out >> _U(29)
    return out


def short_masks(n: int) -> list[str]:
    """Masks for items of ``n`` tokens, fewer than ``WINDOW``: each starts and ends with a token that counts."""
    spare = n - int(np.ceil(AGREE * n))
    parts = [[at * 5 // n in left for at in range(n)] for left in combinations(range(5), 5 - spare)]
    return sorted({"".join("01"[used] for used in part).strip("0") for part in parts})


def seeds(tokens: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, int]]:
    """``(hashes by position, span)`` for every mask, and for the masks of items of the lengths in ``short``."""
    for k, mask in enumerate(MASKS):
        yield _seed(tokens, mask, k + 1), len(mask)
    for mask in sorted({mask for n in short for mask in short_masks(n)}):
        yield _seed(tokens, mask, 1000 + int(mask, 2)), len(mask)


LONGEST = max(map(len, MASKS))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, item_key, item``: test items and their tokens."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            own = [token_hashes(t).astype(np.int64) for t in text_bytes(b.column(1))]
            keys = [hashlib.md5(t.tobytes()).hexdigest() for t in own]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys), pa.array(own, pa.list_(pa.int64()))], names=["item_id", "item_key", "item"])

    return benchmark.select(id_col, text_col).mapInArrow(lambda batches: released(cut(batches), forget), f"item_id {kind}, item_key string, item array<bigint>").where(F.size("item") > 0)


def _test_seeds(items: DataFrame) -> DataFrame:
    """``item_key, hash, place`` of the distinct items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            keys, hashes, places = [], [], []
            for key, item in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.array(item, dtype=np.int64).astype(np.uint64)
                for marks, _ in seeds(own, (len(own),) if len(own) < WINDOW else ()):
                    keys += [key] * len(marks)
                    hashes += marks.astype(np.int64).tolist()
                    places += range(len(marks))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.int64()), pa.array(places, pa.int32())], names=["item_key", "hash", "place"])

    return items.select("item_key", "item").dropDuplicates(["item_key"]).mapInArrow(cut, "item_key string, hash bigint, place int")


def _bit_table(marks: DataFrame, bits: int) -> np.ndarray:
    """2^bits flags, two for every test hash (its first and its last ``bits`` bits): at most 2^(bits - 6) words come to the
    driver, whatever the benchmark's size. A position that is no test hash passes both with the square of the table's density."""
    slots = F.array(F.shiftrightunsigned("hash", 64 - bits), F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)))
    flag = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words = marks.select(F.explode(slots).alias("slot")).select(F.shiftright("slot", 6).alias("word"), flag.alias("flag"))
    flags = np.zeros(1 << (bits - 6), dtype=np.int64)
    for r in words.groupBy("word").agg(F.bit_or("flag").alias("flags")).collect():
        flags[r.word] = r["flags"]
    return flags


RUN = pa.struct([("run_key", pa.string()), ("place", pa.int32()), ("hashes", pa.list_(pa.int64()))])
RUN_SQL = "struct<run_key:string,place:int,hashes:array<bigint>>"


def _candidates(docs: DataFrame, table, short, reach: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, text_key, first, tokens, runs``: positions that pass the bit table, with the stretch of tokens they lie in.

    Hits nearer than ``reach`` tokens share a stretch, which goes ``reach`` tokens beyond its hits on either side; neighbouring
    hits of one mask are a run.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, lengths = np.unpackbits(table.value.view(np.uint8), bitorder="little").view(bool), short.value
        shift, low = _U(64 - (len(flags).bit_length() - 1)), _U(len(flags) - 1)
        for b in small_batches(batches):
            rows, keys, firsts, stretches, runs = [], [], [], [], []
            texts = text_bytes(b.column(1))
            own = [token_hashes(t) for t in texts]
            ends = np.cumsum([len(t) for t in own])
            starts = ends - [len(t) for t in own]
            tokens = np.concatenate([*own, np.zeros(0, dtype=np.uint64)])
            hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for found, span in seeds(tokens, lengths):
                where = np.flatnonzero(flags[(found >> shift).astype(np.int64)])
                where = where[flags[(found[where] & low).astype(np.int64)]]
                of = np.searchsorted(ends, where, side="right")
                inside = where + span <= ends[of] if len(where) else np.zeros(0, dtype=bool)  # not across two texts
                where, of = where[inside], of[inside]
                for part in np.split(np.arange(len(where)), np.flatnonzero((np.diff(where) > 1) | (np.diff(of) > 0)) + 1):
                    if len(part):
                        hits.setdefault(int(of[part[0]]), []).append((where[part] - starts[of[part[0]]], found[where[part]]))
            for row, some in sorted(hits.items()):
                some.sort(key=lambda h: int(h[0][0]))
                key, k = hashlib.md5(texts[row]).hexdigest(), 0
                while k < len(some):
                    first, end, near = max(0, int(some[k][0][0]) - reach), 0, []
                    while k < len(some) and (not near or int(some[k][0][0]) <= end + reach):
                        where, marks = some[k]
                        k, end = k + 1, max(end, int(where[-1]))
                        near.append({"run_key": hashlib.md5(marks.tobytes()).hexdigest(), "place": int(where[0]) - first, "hashes": marks.astype(np.int64).tolist()})
                    rows.append(row), keys.append(key), firsts.append(first), runs.append(near)
                    stretches.append(own[row][first : end + 2 * reach].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string()), pa.array(firsts, pa.int64()), pa.array(stretches, pa.list_(pa.int64())), pa.array(runs, pa.list_(RUN))],
                names=["doc", "text_key", "first", "tokens", "runs"],
            )

    return docs.select(id_col, text_col).mapInArrow(lambda batches: released(scan(batches), forget), f"doc {kind}, text_key string, first bigint, tokens array<bigint>, runs array<{RUN_SQL}>")


def best_stretch(doc: np.ndarray, item: np.ndarray, offset: int, window: int = WINDOW) -> tuple[int, int]:
    """``(agreeing tokens, place in doc)`` of the first best window along the diagonal where item place p meets doc place p + offset."""
    size = min(window, len(item))
    same = np.zeros(len(item), dtype=np.int64)
    low, high = max(0, -offset), min(len(item), len(doc) - offset)
    if high > low:
        same[low:high] = doc[low + offset : high + offset] == item[low:high]
    sums = np.convolve(same, np.ones(size, dtype=np.int64), "valid")
    at = int(sums.argmax())
    return int(sums[at]), at + offset


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        keep, at, agreeing, compared = [], [], [], []
        for row, (first, offset, tokens, item) in enumerate(zip(*[b.column(n).to_pylist() for n in ("first", "offset", "tokens", "item")])):
            size = min(WINDOW, len(item))
            same, place = best_stretch(np.array(tokens, dtype=np.int64), np.array(item, dtype=np.int64), offset)
            if same >= np.ceil(AGREE * size):
                keep.append(row), at.append(first + place), agreeing.append(same), compared.append(size)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("text_key").take(rows), b.column("item_key").take(rows), *(pa.array(x, pa.int64()) for x in (at, agreeing, compared))],
            names=["text_key", "item_key", "at", "agreeing", "compared"],
        )


class _Search:
    """The stretches of documents that can overlap a test item, and the lines along which they do."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, bits: int):
        self.items = cut_lineage(_items(benchmark, item_col, item_text))
        test = cut_lineage(_test_seeds(self.items))
        small = F.when(F.size("item") < WINDOW, F.size("item"))
        lengths = self.items.agg(F.collect_set(small).alias("short")).first().short  # fewer than WINDOW values
        context = docs.sparkSession.sparkContext
        table, short = context.broadcast(_bit_table(test, bits)), context.broadcast(tuple(sorted(lengths)))
        self.found = cut_lineage(_candidates(docs, table, short, 2 * WINDOW + LONGEST, id_col, text_col))
        self.stretches = self.found.select("text_key", "first", "tokens", "runs").dropDuplicates(["text_key", "first"])
        self.runs = self.stretches.select("text_key", "first", F.explode("runs").alias("r")).select("text_key", "first", "r.*")
        known = self.runs.groupBy("run_key").agg(F.first("hashes").alias("hashes")).select("run_key", F.posexplode("hashes").alias("k", "hash"))
        self.lines = known.join(test, "hash").select("run_key", "item_key", (F.col("k") - F.col("place")).alias("shift")).distinct()

    def verified(self, lines: DataFrame, runs: DataFrame) -> DataFrame:
        """``text_key, item_key, at, agreeing, compared`` of the diagonals that ``lines`` put through ``runs``, where enough tokens agree."""
        offset = (F.col("place") + F.col("shift")).alias("offset")
        diagonals = runs.select("text_key", "first", "run_key", "place").join(lines, "run_key").select("text_key", "first", "item_key", offset).distinct()
        texts = self.items.select("item_key", "item").dropDuplicates(["item_key"])
        pairs = diagonals.join(self.stretches.select("text_key", "first", "tokens"), ["text_key", "first"]).join(texts, "item_key")
        return pairs.mapInArrow(_verified, "text_key string, item_key string, at bigint, agreeing bigint, compared bigint")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", bits: int = BITS) -> DataFrame:
    """``<id_col>, text_key, <item_col>, at, agreeing, compared``: verified overlaps, the best of each document and item.

    ``at`` is the token of the document where the compared stretch begins; ``text_key`` is ``md5(text)``.
    """
    search = _Search(docs, benchmark, id_col, text_col, item_col, item_text, bits)
    rank = F.struct((-F.col("agreeing")).alias("r"), "at", "agreeing", "compared")
    best = search.verified(search.lines, search.runs).groupBy("text_key", "item_key").agg(F.min(rank).alias("b"))
    named = best.join(search.items.select("item_id", "item_key"), "item_key")
    hit = search.found.select("doc", "text_key").join(named, "text_key")
    return hit.select(F.col("doc").alias(id_col), "text_key", F.col("item_id").alias(item_col), "b.at", "b.agreeing", "b.compared").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", bits: int = BITS, lines_at_once: int = LINES_AT_ONCE) -> DataFrame:
    """``<id_col>, text_key`` of the documents that overlap any item.

    One item is enough, so each run of hits is held against a few of its lines at first, and against more in later rounds only in texts that have
    not overlapped yet. A passage that many documents and many items share thus costs a document few comparisons and not one per item.
    """
    search = _Search(docs, benchmark, id_col, text_col, item_col, item_text, bits)
    # As many rows as the benchmark's items have seeds at most, numbered by run.
    place = F.row_number().over(Window.partitionBy("run_key").orderBy(F.xxhash64("item_key"), "item_key", "shift"))
    lines = cut_lineage(search.lines.withColumn("n", place))
    most = lines.agg(F.max("n")).first()[0] or 0
    left, bad, done = search.runs, None, 0
    while done < most:
        upto = done * GROWTH if done else max(1, lines_at_once)
        own = search.verified(lines.where((F.col("n") > done) & (F.col("n") <= upto)).drop("n"), left).select("text_key").distinct()
        own = cut_lineage(own)
        bad = own if bad is None else bad.unionByName(own)
        left, done = cut_lineage(left.join(own, "text_key", "left_anti")), upto
    rows = search.found.select(F.col("doc").alias(id_col), "text_key").distinct()
    return rows.limit(0) if bad is None else rows.join(bad, "text_key", "left_semi")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs`` without those that overlap a benchmark item."""
    bad_id, bad_key = fresh("_bad_id", *docs.columns), fresh("_bad_key", *docs.columns)
    found = contaminated(docs.select(id_col, text_col), benchmark, id_col, text_col).select(F.col(id_col).alias(bad_id), F.col("text_key").alias(bad_key))
    on = F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")) == F.col(bad_key))
    return docs.join(found, on, "left_anti")
