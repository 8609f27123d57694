"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by counts of its words' shapes and hashes, a learned
layer turns the counts into a representation, gated attention (the product of a tanh and a sigmoid layer) gives each passage a
weight, learned from document labels alone, and the weighted mean representation is scored by a logistic layer.

Edge cases: null and empty texts are one passage without words and get a score like any other; texts of any length are read
whole; repeated rows score alike; rows without a usable label or id are not learned from; without both labels every score is the smoothed
share of label 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Memo, released, small_batches, text_bytes
from codeloom.session import cut_lineage

PASSAGE = 64
HASHED = 24
HIDDEN = 24
ATTENTION = 12
TRAIN_ROWS = 12_000
EPOCHS = 220
WORDS_KEPT = 300_000
ON_THRESHOLD = 0.3

SHAPES = 9
PACKED = struct.Struct(f"<Q{SHAPES}f")
WORD_TYPE = np.dtype([("hash", "<u8"), ("counts", "<f4", (SHAPES,))])
FEATURES = SHAPES + 5 + HASHED
SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\/=_~^]")


def _word(chunk: bytes) -> bytes:
    """The hash of a word and counts of its shape, packed as ``WORD_TYPE``."""
    w = chunk.decode()
    n = len(w)
    core = w.rstrip(".,!?;:")
    if core.isalpha():
        letters, digits, symbols = len(core), 0, 0
        upper = 0 if core.islower() else letters if core.isupper() else sum(map(str.isupper, core))
    else:
        letters, upper, digits, symbols = sum(map(str.isalpha, w)), sum(map(str.isupper, w)), sum(map(str.isdigit, w)), len(SYMBOLS.findall(w))
    return PACKED.pack(xxhash.xxh64_intdigest(chunk), n, letters, upper, digits, symbols, n - letters - digits - symbols, letters > 0 and upper == letters, w[0].isupper(), w[-1] in ".!?")


_words = Memo(_word, WORDS_KEPT)


def forget() -> None:
    _words.clear()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the first passage of each text.

    One row per passage: means of the words' shapes, repetition within passage and text, hashed word shares.
    """
    packed = [b"".join(map(_words.__getitem__, t.split())) for t in texts]
    lengths = np.array([len(p) for p in packed], dtype=np.int64) // WORD_TYPE.itemsize
    words = np.frombuffer(b"".join(packed), dtype=WORD_TYPE)
    bags = np.maximum(1, -(-lengths // PASSAGE))
    firsts = np.cumsum(bags) - bags
    n, rows = len(words), int(bags.sum())
    out = np.zeros((rows, FEATURES), dtype=np.float32)
    if not n:
        return out, firsts
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    part = firsts[doc] + place // PASSAGE
    hashes = np.ascontiguousarray(words["hash"])
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    full = part[begin]  # passages that have words
    sizes = np.diff(np.append(begin, n)).astype(np.float32)
    mean = lambda x: np.add.reduceat(x, begin, axis=0, dtype=np.float32) / (sizes[:, None] if x.ndim > 1 else sizes)
    shapes = mean(words["counts"])
    shapes[:, 0] = np.minimum(shapes[:, 0], 50) / 10
    shapes[:, 1:6] /= np.maximum(shapes[:, 1:6].sum(axis=1, keepdims=True), 1e-6)
    out[full, :SHAPES] = shapes

    def met_before(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
        mixed = keys ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(mixed, kind="stable")
        seen = np.zeros(n, dtype=np.float32)
        seen[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
        return seen

    follows = np.zeros(n, dtype=np.float32)
    follows[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pairs = hashes.copy()
    pairs[:-1] = np.where(doc[:-1] == doc[1:], hashes[:-1] * np.uint64(31) + hashes[1:], hashes[:-1])  # a text's last word has no partner
    out[full, SHAPES] = 1 - mean(met_before(hashes, part))
    out[full, SHAPES + 1] = mean(follows)
    out[full, SHAPES + 2] = mean(met_before(pairs, doc))
    out[full, SHAPES + 3] = np.log1p(sizes) / 4
    out[:, SHAPES + 4] = np.log1p(np.repeat(lengths, bags)) / 10
    slot = part * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64)
    out[full, SHAPES + 5 :] = np.bincount(slot, minlength=rows * HASHED).reshape(-1, HASHED)[full] / sizes[:, None]
    return out, firsts


class Model:
    """Weights of the encoder, the gated attention and the score."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        layer = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.spread = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.weights = {"w": layer(FEATURES, HIDDEN), "w0": np.zeros(HIDDEN, np.float32), "v": layer(HIDDEN, ATTENTION), "u": layer(HIDDEN, ATTENTION), "a": layer(ATTENTION, 1)[:, 0], "c": layer(HIDDEN, 1)[:, 0], "c0": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """``starts``: the first passage of each document."""
        k = self.weights
        sizes = np.diff(np.append(starts, len(x)))
        owner = np.repeat(np.arange(len(starts)), sizes)
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ k["w"] + k["w0"])
        t, g = np.tanh(h @ k["v"]), 1 / (1 + np.exp(-(h @ k["u"])))
        e = (t * g) @ k["a"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        alpha = e / np.add.reduceat(e, starts)[owner]
        m = np.add.reduceat(alpha[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(m @ k["c"] + k["c0"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "alpha": alpha, "m": m, "p": p, "owner": owner}

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        k, s = self.weights, self.forward(x, starts)
        dm0 = (s["p"] - y) / len(y)
        out = {"c": s["m"].T @ dm0, "c0": np.array([dm0.sum()])}
        dm = (dm0[:, None] * k["c"])[s["owner"]]
        dalpha = (dm * s["h"]).sum(axis=1)
        de = s["alpha"] * (dalpha - np.add.reduceat(s["alpha"] * dalpha, starts)[s["owner"]])
        out["a"] = (s["t"] * s["g"]).T @ de
        dt = de[:, None] * k["a"] * s["g"] * (1 - s["t"] ** 2)
        dg = de[:, None] * k["a"] * s["t"] * s["g"] * (1 - s["g"])
        out["v"], out["u"] = s["h"].T @ dt, s["h"].T @ dg
        dh = s["alpha"][:, None] * dm + dt @ k["v"].T + dg @ k["u"].T
        dz = dh * (1 - s["h"] ** 2)
        out["w"], out["w0"] = s["z"].T @ dz, dz.sum(axis=0)
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        return self.forward(*passages(texts))["p"].astype(float).tolist() if texts else []


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4, batch: int = 3_000) -> Model:
    """Adam over batches of documents in a fixed order."""
    model = Model()
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model.weights["c0"][:] = np.log(share / (1 - share))
    if len(labels) == 0 or labels.min() == labels.max():
        model.weights["c"][:] = 0
        return model
    x = np.concatenate(bags)
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = np.random.default_rng(11).permutation(len(bags))
    parts = []
    for at in range(0, len(order), batch):
        own = order[at : at + batch]
        starts = np.cumsum([0, *(len(bags[k]) for k in own)])[:-1]
        parts.append((np.concatenate([bags[k] for k in own]), starts, labels[own].astype(np.float32)))
    first, second = ({n: np.zeros_like(w) for n, w in model.weights.items()} for _ in range(2))
    step = 0
    for epoch in range(max(1, epochs // len(parts))):
        for x, starts, y in parts:
            step += 1
            for n, d in model.gradient(x, starts, y).items():
                d = d + decay * model.weights[n]
                first[n] = 0.9 * first[n] + 0.1 * d
                second[n] = 0.999 * second[n] + 0.001 * d * d
                model.weights[n] = (model.weights[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from about ``train_rows`` labelled documents at most, taken by a hash of their ids; their passages' features come to the driver."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, train_rows / max(usable.count(), 1))
    picked = cut_lineage(usable.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000)))
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(F.broadcast(picked), "k")  # the sample's size is bounded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows, firsts = passages(text_bytes(b.column(1)))
            bags = np.split(rows, firsts[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in bags], pa.binary())], names=["k", "label", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("k", "text", "label").mapInArrow(lambda batches: released(encode(batches), forget), f"k {kind}, label int, bag binary").dropDuplicates(["k"]).toArrow()
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, FEATURES) for x in got.column("bag").to_pylist()]
    order = np.argsort(np.array([str(k) for k in got.column("k").to_pylist()], dtype=str), kind="stable")
    return train([bags[k] for k in order], np.array(got.column("label").to_pylist(), dtype=np.float32)[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, score`` of every document. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(text_bytes(b.column(1))), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(lambda batches: released(run(batches), forget), f"`{id_col}` {kind}, score double")
