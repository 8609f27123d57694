"""Best-fit packing of token sequences: bounded-space online best fit.

Documents are cut into pieces of at most ``capacity`` ids. Each partition packs its pieces on its own,
with a fixed number of open bins. Open bins are found through a bitset keyed by free space: its lowest bit at or above the
need is the best fit, its lowest bit of all is the fullest bin, which closes first when a bin too many is open.

Edge cases: a null or empty text has the closing id alone; null ids and repeated rows are documents like any other; texts of
any length are cut into full pieces and a rest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Memo, released, small_batches, text_bytes

CAPACITY = 2048
OPEN_BINS = 16_384
CHUNKS_KEPT = 400_000
END = b"\0\0\0\0"

# Fixed value: the pattern by which the vocabulary's pre-tokenizer splits a text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Characters for which normalisation is lower-casing alone and both regex engines agree.
PLAIN = re.compile(r"[!-~¡-ɏ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts, remembered per white-space separated chunk.

    No token spans white space, so a text's ids are those of its chunks in a row. Chunks of plain letters go straight
    to the merge model; all others through the whole tokenizer.
    """

    def __init__(self, path: str, kept: int = CHUNKS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.split = self.tokenizer.model, _byte_letters(), regex.compile(PRE_TOKEN).findall
        self.chunks, self.pre_tokens = Memo(self._chunk, kept), Memo(self._pre_token, kept)

    def _pre_token(self, word: str) -> bytes:
        found = self.model.tokenize(word.encode().decode("latin1").translate(self.letters))
        return np.array([t.id for t in found], dtype="<u4").tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self.pre_tokens[w] for w in self.split(word.lower())])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids, without special tokens."""
        return b"".join(map(self.chunks.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_tables: bool = False) -> DataFrame:
    """``<id_col>, piece, start, length, ids_crc32``: the pieces of every document.

    ``keep_tables``: workers keep what they know of short chunks from task to task (some 120 MB at most) instead of emptying it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        forget = () if keep_tables else (tokenizer.chunks.clear, tokenizer.pre_tokens.clear)
        yield from released(cut_with(tokenizer, batches), *forget)

    def cut_with(tokenizer: WordTokenizer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for row, text in enumerate(text_bytes(b.column(1))):
                ids = tokenizer.ids(text) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append(row), numbers.append(k), starts.append(at // 4), lengths.append(len(own) // 4), sums.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, {PIECE}")


class Bins:
    """Open bins of one partition."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.next, self.bits = capacity, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """``(bin, offset)`` of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number, self.next = self.capacity, self.next, self.next + 1
            if self.open >= self.most and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces, whose ``length`` is at most ``capacity``.

    Only piece descriptions are dealt out, by a hash of the whole row, so no document or length gathers in one place. Within a
    partition long pieces come first (ties by all columns, so a repeated task gives the same bins).
    """
    names = cut.columns
    dealt = cut.repartition(*names).sortWithinPartitions(F.desc("length"), *[F.col(c) for c in names if c != "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            put = [bins.put(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([first + x for x, _ in put], pa.int64()), pa.array([x for _, x in put], pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", keep_tables: bool = False
) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity, id_col, text_col, keep_tables), capacity, open_bins)
