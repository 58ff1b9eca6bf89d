"""Operator 1: document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded (counts of character
classes and word statistics through a small layer), gated attention weighs the
passages, and the weighted passage representation is scored.  The weights are
learned from document labels alone, on a bounded sample of labelled rows; scoring
covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import documents, map_rows, table

PASSAGE_WORDS = 64
#: Labelled documents of each class to learn from, at most.
TRAIN_PER_CLASS = 1000
HIDDEN, ATTENTION = 16, 8
EPOCHS, RATE, DECAY = 200, 0.03, 1e-4
SLICE_BYTES = 1 << 20

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _PIPE, _MARK, _WIDE = range(8)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _WIDE
_CLASS[[44, 46, 39, 45, 59, 58, 40, 41, 34, 63]] = _STOP
_CLASS[124] = _PIPE
FEATURES = 14
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        most = max(n, 2 * SLICE_BYTES)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(most - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _in_passages(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes, each of which ends where a passage ends: passages are those of the whole."""
    at = 0
    while len(text) - at > most:
        size, stop = most, 0
        while not stop and at + size < len(text):
            wordy = _CLASS[np.frombuffer(text, np.uint8, size, at)] != _SPACE
            ends = np.flatnonzero(wordy[:-1] & ~wordy[1:]) + 1  # of words that end within the part
            whole = len(ends) // PASSAGE_WORDS * PASSAGE_WORDS
            stop = int(ends[whole - 1]) if whole else 0
            size *= 2
        if not stop:
            break
        yield text[at : at + stop]
        at += stop
    if at == 0 or text[at:].strip():
        yield text[at:]


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the number of passages of each text (one at least); long texts are read in parts."""
    if max(map(len, texts), default=0) <= 4 * SLICE_BYTES:
        return _passages(texts)
    features, bags = [], []
    for t in texts:
        parts = [_passages([part]) for part in _in_passages(t)]
        features += [x for x, _ in parts]
        bags.append(sum(int(n[0]) for _, n in parts))
    return np.concatenate(features), np.array(bags)


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[data]
    wordy = kind != _SPACE
    edge = np.diff(np.concatenate([[0], wordy.view(np.int8)]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text_ends = np.cumsum(sizes)
    words_before = np.searchsorted(starts, np.concatenate([[0], text_ends]))
    n_words = np.diff(words_before)
    n_passages = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    own = np.repeat(np.arange(len(texts)), n_passages)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
    lo = words_before[own] + k * PASSAGE_WORDS
    hi = np.minimum(lo + PASSAGE_WORDS, words_before[own + 1])
    count = hi - lo
    some = count > 0
    out = np.zeros((len(own), FEATURES), np.float32)
    if some.any():
        a, b = starts[lo[some]], ends[hi[some] - 1]
        length = np.maximum(b - a, 1)
        for c in range(8):
            total = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int32)])
            out[some, c] = (total[b] - total[a]) / length
        powers, inverse = _powers(len(data))
        summed = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, dtype=np.uint64)])
        word = (summed[ends] - summed[starts]) * inverse[starts]
        again = np.zeros(len(word) + 1, np.int32)
        again[2:] = np.cumsum(word[1:] == word[:-1])
        shout = np.zeros(len(word) + 1, np.int32)
        upper = np.concatenate([[0], np.cumsum(kind == _UPPER, dtype=np.int32)])
        shout[1:] = np.cumsum(upper[ends] - upper[starts] >= 2)
        marked = np.zeros(len(word) + 1, np.int32)
        marked[1:] = np.cumsum(kind[ends - 1] == _MARK)
        n = count[some]
        inner = np.minimum(lo[some] + 1, hi[some])
        out[some, 8] = (again[hi[some]] - again[inner]) / n
        out[some, 9] = (shout[hi[some]] - shout[lo[some]]) / n
        out[some, 10] = (marked[hi[some]] - marked[lo[some]]) / n
        letters = np.concatenate([[0], np.cumsum(ends - starts)])
        out[some, 11] = (letters[hi[some]] - letters[lo[some]]) / n / 20
        out[some, 12] = np.log1p(n) / np.log1p(PASSAGE_WORDS)
    out[:, 13] = ~some
    return out, n_passages


@dataclass
class Attention:
    """Weights of the encoder, the gated attention and the scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        first, own = np.cumsum(bags) - bags, np.repeat(np.arange(len(bags)), bags)
        v = {"x": (x - self.mean) / self.scale, "first": first, "own": own}
        v["h"] = np.tanh(v["x"] @ w["W"] + w["b"])
        v["t"], v["g"] = np.tanh(v["h"] @ w["V"]), 1 / (1 + np.exp(-(v["h"] @ w["U"])))
        logit = (v["t"] * v["g"]) @ w["a"]
        e = np.exp(logit - np.maximum.reduceat(logit, first)[own])
        v["att"] = e / np.add.reduceat(e, first)[own]
        v["z"] = np.add.reduceat(v["att"][:, None] * v["h"], first, axis=0)
        v["p"] = 1 / (1 + np.exp(-np.clip(v["z"] @ w["c"] + w["d"], -30, 30)))
        return v

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), bags)["p"]


def learn(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 1) -> Attention:
    """Fit by Adam on the mean cross-entropy, both classes weighing the same."""
    rng, x = np.random.default_rng(seed), x.astype(np.float64)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "d": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]) if s else 0, s) if k != "b" else np.zeros(s) for k, s in shapes.items()}
    w["d"] = np.zeros(())
    model = Attention(x.mean(axis=0), x.std(axis=0) + 1e-3, w)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    m, s = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        v = model.forward(x, bags)
        own, first = v["own"], v["first"]
        dz = (weight * (v["p"] - y))[:, None] * w["c"]
        grad = {"c": v["z"].T @ (weight * (v["p"] - y)), "d": (weight * (v["p"] - y)).sum()}
        datt = (dz[own] * v["h"]).sum(axis=1)
        dlogit = v["att"] * (datt - np.add.reduceat(v["att"] * datt, first)[own])
        grad["a"] = (v["t"] * v["g"]).T @ dlogit
        dtg = dlogit[:, None] * w["a"]
        dt, dg = dtg * v["g"] * (1 - v["t"] ** 2), dtg * v["t"] * v["g"] * (1 - v["g"])
        grad["V"], grad["U"] = v["h"].T @ dt, v["h"].T @ dg
        dh = (v["att"][:, None] * dz[own] + dt @ w["V"].T + dg @ w["U"].T) * (1 - v["h"] ** 2)
        grad["W"], grad["b"] = v["x"].T @ dh, dh.sum(axis=0)
        for k in w:
            g = grad[k] + DECAY * w[k] * (k in "WVUac")
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(fold: int, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, out: Column, per_class: int) -> DataFrame:
    """``text, y`` of at most ``per_class`` labelled documents of each class that are not held out, picked by a hash.

    However often a doc_id is repeated, it is learned from once, by its smallest text.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.filter(~out)
    ids = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = ids[0].unionByName(ids[1])
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def train(docs: DataFrame, labels: DataFrame) -> Attention | None:
    """The model learned from labelled rows, without those held out; none if a class has no row."""
    rows = training_rows(docs, labels, "quality", held_out(2, 4), TRAIN_PER_CLASS)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in _slices(batch.column(0)):
            x, bags = passages(texts)
            parts = np.split(x, np.cumsum(bags)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([p.tobytes() for p in parts], pa.binary())], ["y", "x"])

    got = sorted((r.y, bytes(r.x)) for r in map_rows(rows, work, "y int, x binary").collect())
    y = np.array([r[0] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return None
    parts = [np.frombuffer(r[1], np.float32).reshape(-1, FEATURES) for r in got]
    return learn(np.concatenate(parts), np.array(list(map(len, parts))), y)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    texts, held, lo = column.cast(pa.binary()).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_BYTES or i + 1 == len(texts):
            yield lo, i + 1, texts[lo : i + 1]
            held, lo = 0, i + 1


def score(docs: DataFrame, model: Attention | None) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``.

    Null texts count as empty; an empty text is one passage without words.  Without a model (no
    labels of both classes) every score is 1: nothing is known against a document.  Repeated rows
    are scored each; columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in _slices(batch.column(1)):
            got = shared.value.score(*passages(texts)) if shared.value else np.ones(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(got, pa.float64())], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), work, "doc_id long, score double")


def op1_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
