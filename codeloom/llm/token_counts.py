"""Token counts under a unigram vocabulary: dynamic programming shared along a trie of pre-tokens.

A pre-token is a word with the vocabulary's space mark before it. The best segmentation of a prefix does not depend on what follows, so the
distinct pre-tokens of a batch are laid out as a trie (in sorted order, neighbours share their prefixes) and the
forward score, the token count and the vocabulary pieces under way are worked out once for each node. The counts of
whole pre-tokens are kept and summed per document.

Edge cases: null and empty texts and those of white space have no tokens; a character without a piece counts as its UTF-8 bytes (byte fallback);
among segmentations of equal score the one with fewer tokens counts; of very long words (unspaced scripts, encoded data) the first ``SHARED`` characters are
laid out as trie nodes, the rest is gone through with the last node alone; repeated rows count alike;
null ids pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.common import LONGEST_KEPT, text_bytes

MARK = "▁"
COUNTS_KEPT = 500_000
#: Characters of a pre-token whose scores are kept for the next one, at most.
SHARED = 256
ROWS_AT_ONCE = 4_000
#: How much worse than the rarest piece a character without a piece is.
UNKNOWN_PENALTY = 10.0


class Unigram:
    """Pieces with log probabilities, as a trie of characters."""

    def __init__(self, scores: dict[str, float]):
        self.root: dict = {}  # character -> [score or None, further characters]
        for piece, score in scores.items():
            at = self.root
            for c in piece[:-1]:
                at = at.setdefault(c, [None, {}])[1]
            at.setdefault(piece[-1], [None, {}])[0] = score
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word (marks included by the caller); prefixes shared by neighbours in sorted order are worked out once."""
        out = {}
        root, unknown = self.root, self.unknown
        # The path from the trie's root to the last word: best score, tokens, and pieces under way as (score and tokens where they began, vocabulary node).
        scores, tokens, under_way = [0.0], [0], [[(0.0, 0, root)]]
        last = ""
        for word in sorted(words):
            shared, most = 0, min(len(last), len(word), SHARED)
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del scores[shared + 1 :], tokens[shared + 1 :], under_way[shared + 1 :]
            best, fewest, here = scores[-1], tokens[-1], under_way[-1]
            for k in range(shared, len(word)):
                c = word[k]
                best, fewest = best + unknown, fewest + len(c.encode())
                going = []
                for score, n, node in here:
                    entry = node.get(c)
                    if entry is None:
                        continue
                    piece, further = entry
                    if piece is not None:
                        own = score + piece
                        if own > best or (own == best and n + 1 < fewest):
                            best, fewest = own, n + 1
                    if further:
                        going.append((score, n, further))
                going.append((best, fewest, root))
                here = going
                if k < SHARED:
                    scores.append(best), tokens.append(fewest), under_way.append(going)
            out[word] = fewest
            last = word[:SHARED]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The pieces of a sentencepiece file; a merge vocabulary has ranks for scores, which are read as a Zipf law over ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
    ranked = sorted(plain, key=lambda k: (-model.get_score(k), k))
    total = math.log(sum(1 / (r + 1) for r in range(len(ranked)))) if ranked else 0.0
    return Unigram({model.id_to_piece(k): -math.log(r + 1) - total for r, k in enumerate(ranked)})


class Counter:
    """Counts per document, with the counts of at most ``kept`` pre-tokens, none of them long, remembered between batches."""

    def __init__(self, unigram: Unigram, kept: int = COUNTS_KEPT):
        self.unigram, self.kept, self.known = unigram, kept, {}

    def count(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """``(pre-tokens, tokens)`` of each text."""
        words = set().union(*(t.split() for t in texts))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.kept:
            self.known, new = {}, words
        found = {w[1:].encode(): n for w, n in self.unigram.counts([MARK + w.decode() for w in new]).items()}
        self.known.update((w, n) for w, n in found.items() if len(w) <= LONGEST_KEPT)
        get = lambda w: found[w] if w in found else self.known[w]
        return [(len(own), sum(map(get, own))) for own in (t.split() for t in texts)]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_pre_tokens, n_tokens`` of every document. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(vocabulary, Counter(load(vocabulary)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(at, ROWS_AT_ONCE)
                got = counter.count(text_bytes(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1))], names=[id_col, "n_pre_tokens", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pre_tokens bigint, n_tokens bigint")
