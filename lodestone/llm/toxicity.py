"""Operator 9: toxicity by weak supervision.

Many voters look at a document: one for each lexicon term (whole words and word
stems, mined from labelled training rows, beside a few fixed words), and pattern
voters (how many terms occur, shouting, no term at all).  A generative label model
estimates how often each voter fires on toxic and on clean documents, without
labels, and how far voters repeat each other; correlated voters share their weight.
A linear classifier is trained on the model's posterior labels and scores documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.quality import held_out, training_rows
from lodestone.llm.tables import documents, held, map_rows, table

#: Labelled documents of each class to learn from, at most.
TRAIN_PER_CLASS = 1500
#: Lexicon terms kept, at most, and the lengths of mined stems.
TERMS, STEMS = 400, (4, 5, 6)
#: A term is mined if so many toxic training documents (or such a share) have it, and clean ones so much more rarely.
LEAST_TOXIC, LEAST_SHARE, PURITY = 3, 0.004, 0.01
#: Terms sought for each toxic document; minimum hashes that tell near copies.
COVER, MINIMA = 2, 8
#: Common English abuse.
ABUSE = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
PATTERNS = 5
CACHED_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def words_of(text: str | None) -> set[str]:
    return {w for u in set((text or "").lower().split()) for w in ((u,) if u.isalpha() else _WORD.findall(u))}


def shouts(text: str | None) -> bool:
    """Whether over half of the letters of the whole text are capitals."""
    text = text or ""
    plain = text.encode("ascii", "ignore")
    upper, letters = (len(plain) - len(plain.translate(None, kind)) for kind in (_UPPER, _LETTERS))
    for part in () if text.isascii() else _BEYOND_ASCII.findall(text):
        upper, letters = upper + sum(map(str.isupper, part)), letters + sum(map(str.isalpha, part))
    return 2 * upper > letters


def _forms(word: str) -> list[str]:
    """A word as a term, and its stems (marked by a final *)."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def _groups(sets: list[set[str]]) -> list[int]:
    """A number for each document; near copies (half of several minimum hashes of their words agree) share one."""
    if not sets:
        return []
    rng = np.random.default_rng(3)
    mult, add = rng.integers(1, 1 << 31, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 31, MINIMA, dtype=np.uint64)
    sketch = np.zeros((len(sets), MINIMA), np.uint64)
    for i, words in enumerate(sets):
        h = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
        if len(h):
            sketch[i] = ((h[:, None] * mult + add) & np.uint64(0xFFFFFFFF)).min(axis=0)
    firsts: dict[tuple[int, int], list[int]] = {}
    number = list(range(len(sets)))
    for i in range(len(sets)):
        for j in dict.fromkeys(j for k in range(MINIMA) for j in firsts.get((k, int(sketch[i, k])), ())):
            if (sketch[i] == sketch[j]).sum() * 2 >= MINIMA:
                number[i] = number[j]
                break
        else:
            for k in range(MINIMA):
                firsts.setdefault((k, int(sketch[i, k])), []).append(i)
    return number


def mine(sets: list[set[str]], y: np.ndarray) -> list[str]:
    """Terms of toxic training documents that clean ones lack, found by greedy covering.

    Near copies count once.  Each step takes the term that occurs in most toxic documents still
    lacking COVER terms, in its most specific form that occurs in almost as many.
    """
    toxic = [s for s, label in zip(sets, y, strict=True) if label == 1]
    toxic = list({g: s for g, s in zip(_groups(toxic), toxic, strict=True)}.values())
    clean = [s for s, label in zip(sets, y, strict=True) if label == 0]
    where: dict[str, set[int]] = {}
    for i, s in enumerate(toxic):
        for f in {f for w in s for f in _forms(w)}:
            where.setdefault(f, set()).add(i)
    least = max(LEAST_TOXIC, int(LEAST_SHARE * len(toxic)))
    where = {f: d for f, d in where.items() if len(d) >= least}
    other = Counter(f for s in clean for f in {f for w in s for f in _forms(w) if f in where})
    where = {f: d for f, d in where.items() if other[f] * len(toxic) <= PURITY * len(d) * len(clean)}
    lacking = dict.fromkeys(range(len(toxic)), COVER)
    kept: list[str] = []
    while where and len(kept) < TERMS:
        best = min(where, key=lambda f: (-len(where[f]), f))
        if len(where[best]) < least:
            break
        bare = best.rstrip("*")
        special = [f for f, d in where.items() if f.startswith(bare) and len(d) >= 0.8 * len(where[best])]
        best = max(special, key=lambda f: (not f.endswith("*"), len(f), f))
        kept.append(best)
        done = where.pop(best)
        for i in done:
            lacking[i] -= 1
        full = {i for i in done if lacking[i] <= 0}
        # What the term implies goes; documents with enough terms count no more.
        bare = best.rstrip("*")
        where = {f: d - full for f, d in where.items() if not (best.endswith("*") and f.startswith(bare)) and not (f.endswith("*") and bare.startswith(f[:-1]))}
    return list(dict.fromkeys([*ABUSE, *kept]))


class Voters:
    """Which terms a text has, and the pattern voters, with a bounded cache of words."""

    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.cache: dict[str, tuple[int, ...]] = {}

    def terms(self, units: set[str]) -> set[int]:
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for u in units.difference(cache):
            found = {self.index[f] for w in ((u,) if u.isalpha() else _WORD.findall(u)) for f in _forms(w) if f in self.index}
            cache[u] = tuple(found)
        return {i for hits in map(cache.__getitem__, units) if hits for i in hits}

    def votes(self, text: str | None) -> np.ndarray:
        """1 where a voter fires: terms, then one, two, four terms at least, shouting, no term."""
        return self.of(set((text or "").lower().split()), shouts(text))

    def of(self, units: set[str], loud: bool) -> np.ndarray:
        got = self.terms(units)
        out = np.zeros(len(self.index) + PATTERNS, np.float32)
        out[list(got)] = 1
        out[-PATTERNS:] = (len(got) >= 1, len(got) >= 2, len(got) >= 4, loud, not got)
        return out


@dataclass
class LabelModel:
    """Chances that each voter fires on clean and toxic documents, its share of a correlated group's weight, the prior."""

    clean: np.ndarray
    toxic: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fired = np.log(self.toxic / self.clean) * self.share
        silent = np.log((1 - self.toxic) / (1 - self.clean)) * self.share
        odds = votes @ fired + (1 - votes) @ silent + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_labels(votes: np.ndarray, prior: float, rounds: int = 20) -> LabelModel:
    """Expectation maximisation over unlabelled votes; correlations are those left within the estimated classes."""
    n, m = votes.shape
    post = np.where(votes[:, -1] == 1, 0.05, 0.95)  # the first guess: any term at all
    share = np.full(m, 1.0)
    model = None
    for _ in range(rounds):
        toxic = (post @ votes + 0.1) / (post.sum() + 1)
        clean = ((1 - post) @ votes + 0.1) / ((1 - post).sum() + 1)
        toxic, clean = np.clip(toxic, 1e-4, 1 - 1e-4), np.clip(clean, 1e-4, 1 - 1e-4)
        rest = votes - (post[:, None] * toxic + (1 - post)[:, None] * clean)
        cov = rest.T @ rest / n
        spread = np.sqrt(np.diag(cov)) + 1e-6
        corr = np.abs(cov / np.outer(spread, spread))
        np.fill_diagonal(corr, 0)
        share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(axis=1))
        model = LabelModel(clean, toxic, share, prior)
        post = model.posterior(votes)
    return model


@dataclass
class Classifier:
    terms: list[str]
    weights: np.ndarray
    bias: float

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes @ self.weights + self.bias, -30, 30)))


def fit_linear(votes: np.ndarray, target: np.ndarray, steps: int = 600, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum."""
    w, b, vw, vb = np.zeros(votes.shape[1]), 0.0, 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(votes @ w + b, -30, 30)))
        err = (p - target) / len(target)
        vw, vb = 0.9 * vw + votes.T @ err + decay * w, 0.9 * vb + err.sum()
        w, b = w - rate * vw, b - rate * vb
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Mine, vote, estimate, fit; labels choose terms and the prior only, and held-out rows are not read."""
    rows = training_rows(docs, labels, "toxic", held_out(0, 5), TRAIN_PER_CLASS)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = [" ".join(sorted(words_of(t))) for t in batch.column(0).to_pylist()]
        loud = [shouts(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.string()), pa.array(loud, pa.bool_())], ["y", "words", "loud"])

    got = sorted((r.y, r.words, r.loud) for r in map_rows(rows, work, "y int, words string, loud boolean").collect())
    y = np.array([r[0] for r in got])
    sets = [set(r[1].split()) for r in got]
    terms = mine(sets, y) if len(got) else list(ABUSE)
    voters = Voters(terms)
    votes = np.stack([voters.of(words, r[2]) for words, r in zip(sets, got, strict=True)]).astype(np.float64) if got else np.zeros((0, len(terms) + PATTERNS))
    if len(set(y.tolist())) < 2:  # nothing to estimate from: any fixed word counts
        weights = np.zeros(len(terms) + PATTERNS)
        weights[-PATTERNS] = 8.0
        return Classifier(terms, weights, -4.0)
    model = fit_labels(votes, float(y.mean()))
    return Classifier(terms, *fit_linear(votes, model.posterior(votes)))


def _scores(shared, texts: list[str | None]) -> np.ndarray:
    model = shared.value
    _, voters = held("voters", id(model), lambda: (model, Voters(model.terms)))
    return model.scores(np.stack([voters.votes(t) for t in texts]))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, score`` of each row of ``docs``, over whole texts.

    Null and empty texts have no term and score low.  Repeated rows are scored each; columns other
    than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, score double")


def accepted(docs: DataFrame, model: Classifier, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(shared, batch.column(place).to_pylist()) < threshold))

    return map_rows(docs, work, docs.schema)


def op9_toxicity_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
