"""Operator 7: exact token counts at every prefix, by dynamic programming along the automaton.

``count[i]`` of a word is ``count[start of its last inner token] + 1``; a text's
count at a prefix is the sum over the words before it plus the count of the word
it ends in, closed there.  The table answers how long a truncated text is, and
which prefix fits a budget, without encoding again.

Prefixes are measured in bytes of the original text.  They end after a character,
unless a combining mark that follows would still change it, and not inside a special
token; the count of such a prefix is that of its own encoding.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.tables import documents, held, map_rows

#: Tokens that a text may have.
LIMIT = 2048
_UNITS = regex.compile(rf"[^{bpe._SPACE}]+")
#: Words whose parts are split otherwise than the whole.
_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


@functools.cache
def _joining() -> frozenset[str]:
    """Characters that may change what stands before them when composed: second parts of compositions, by the Unicode tables."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _steps(unit: str) -> list[tuple[int, int]]:
    """Byte ends ``original, normalised`` of the unit's pieces that normalise by themselves."""
    if unit.isascii():
        return [(i, i) for i in range(1, len(unit) + 1)]
    joins, starts = _joining(), [0]
    starts += [i for i, c in enumerate(unit) if i and not unicodedata.combining(c) and c not in joins]
    out, own, normal = [], 0, 0
    for lo, hi in zip(starts, [*starts[1:], len(unit)], strict=True):
        own, normal = own + len(unit[lo:hi].encode()), normal + len(bpe.normalise(unit[lo:hi]).encode())
        out.append((own, normal))
    return out


class Counter:
    """Counts of one worker; words are cached with their prefix counts, within a bound."""

    def __init__(self, automaton: bpe.Automaton):
        self.encoder = bpe.Encoder(automaton)
        self.whole: dict[str, int] = {}

    def _learn(self, units: set[str]) -> None:
        if len(self.whole) > bpe.CACHED_WORDS:
            self.whole.clear()
        missing = units.difference(self.whole)
        split = {u: [u] if u.isalpha() else bpe.split_words(u) for u in missing}
        words = sorted({w for ws in split.values() for w in ws}.difference(self.whole))
        for lo in range(0, len(words), 20_000):
            chunk = words[lo : lo + 20_000]
            counts = bpe.whole_counts(self.encoder.automaton, [w.encode() for w in chunk])
            self.whole.update(zip(chunk, counts.tolist(), strict=True))
        known = self.whole
        known.update({u: sum([known[w] for w in ws]) for u, ws in split.items()})

    def totals(self, texts: Sequence[str | None]) -> list[int]:
        """The count at each text's end."""
        parts = [self.encoder.parts(t) for t in texts]
        self._learn(set().union(*(p for cut in parts for p in cut[::2])))
        known = self.whole.__getitem__
        return [sum(1 if i % 2 else sum(map(known, p)) for i, p in enumerate(cut)) for cut in parts]

    def _unit(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Prefix table of what stands between white space: byte ends in the unit, and counts."""
        words = bpe.split_words(bpe.normalise(unit))
        raw = [w.encode() for w in words]
        counts = bpe.prefix_counts(self.encoder.automaton, raw)
        for w, c in zip(words, counts, strict=True):
            if w in _CONTRACTIONS:  # a part of it is an apostrophe and a letter
                c[1] = c[0] + self._count(w[1])
        whole = np.cumsum([0, *(int(c[-1]) for c in counts)])
        at = np.concatenate([c + before for c, before in zip(counts, whole, strict=False)])
        own, normal = np.array(_steps(unit)).T
        return own, at[normal - 1]

    def _count(self, unit: str) -> int:
        self._learn({unit})
        return self.whole[unit]

    def _parts(self, text: str | None) -> Iterator[tuple[int, str, bool]]:
        """Byte start of each unit and special token, and whether it is one."""
        at, text = 0, text or ""
        cut = self.encoder.special.split(text) if self.encoder.special else [text]
        for i, part in enumerate(cut):
            if i % 2:
                yield at, part, True
            else:
                seen, place = 0, at
                for m in _UNITS.finditer(part):
                    place += len(part[seen : m.start()].encode())
                    yield place, m.group(), False
                    place, seen = place + len(m.group().encode()), m.end()
            at += len(part.encode())

    def prefixes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Byte ends of every prefix of the text, and its count; special tokens end once, at their last byte."""
        ends, counts, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for at, unit, special in self._parts(text):
            own, c = (np.array([len(unit.encode())]), np.array([1])) if special else self._unit(unit)
            ends.append(at + own)
            counts.append(total + c)
            total += int(c[-1])
        return np.concatenate(ends), np.concatenate(counts)

    def fitting(self, text: str, budget: int) -> tuple[int, int]:
        """Bytes and tokens of the longest prefix that needs at most ``budget`` tokens.

        Totals only grow from unit to unit, so only the last unit that starts below the budget, and the one
        before it, are looked at prefix by prefix.
        """
        parts = [(at, u, special, bpe.normalise(u)) for at, u, special in self._parts(text)]
        self._learn({n for _, _, special, n in parts if not special})
        sizes = [1 if special else self.whole[n] for _, _, special, n in parts]
        total, best = 0, (0, 0)
        for (at, unit, special, _), n in zip(parts, sizes, strict=True):
            if total >= budget:
                break
            if total + n <= budget:
                best = (at + len(unit.encode()), total + n)
            elif not special:
                own, c = self._unit(unit)
                fits = np.flatnonzero(total + c <= budget)
                if len(fits):
                    best = (at + int(own[fits[-1]]), total + int(c[fits[-1]]))
            total += n
        return best


def _counter(automaton) -> Counter:
    return held("counter", id(automaton.value), lambda: Counter(automaton.value))


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", budget: int = LIMIT) -> DataFrame:
    """``(key, n_bytes, n_tokens, fit_bytes, fit_tokens)`` of each whole text.

    The last two are the longest prefix (see :meth:`Counter.prefixes`) that needs at most ``budget`` tokens: the whole
    text, or where to truncate it.  Null counts as empty, repeated rows stay, other columns are not read.
    """
    automaton = bpe.shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter, texts, sizes = _counter(automaton), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for lo, hi in bpe.in_slices(texts):
            totals = counter.totals(texts[lo:hi])
            fits = [(b, n) if n <= budget else counter.fitting(t, budget) for t, b, n in zip(texts[lo:hi], sizes[lo:hi], totals, strict=True)]
            columns = [totals, [b for b, _ in fits], [n for _, n in fits]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in columns)], ["key", "n_bytes", "n_tokens", "fit_bytes", "fit_tokens"])

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    out = map_rows(df.select(F.col(key).alias("key"), F.col(text).alias("text"), size.alias("n_bytes")), work, f"key {dict(df.dtypes)[key]}, n_bytes long, n_tokens long, fit_bytes long, fit_tokens long")
    return out.withColumnRenamed("key", key)


def prefix_table(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ends array<long>, counts array<long>)``: the whole prefix table of each text (see :meth:`Counter.prefixes`)."""
    automaton = bpe.shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter = _counter(automaton)
        for i, t in enumerate(batch.column(1).to_pylist()):
            ends, counts = counter.prefixes(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["key", "ends", "counts"])

    out = map_rows(df.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {dict(df.dtypes)[key]}, ends array<long>, counts array<long>")
    return out.withColumnRenamed("key", key)


def count_at(ends: str, counts: str, n_bytes: int) -> Column:
    """Tokens of the longest prefix of at most ``n_bytes`` bytes (0 if none)."""
    fits = F.filter(F.arrays_zip(ends, counts), lambda p: p[ends] <= n_bytes)
    return F.coalesce(F.try_element_at(fits, F.lit(-1))[counts], F.lit(0))


def longest_within(ends: str, counts: str, budget: int) -> Column:
    """Bytes of the longest prefix that needs at most ``budget`` tokens (0 if none); counts may fall as a word goes on."""
    fits = F.filter(F.arrays_zip(ends, counts), lambda p: p[counts] <= budget)
    return F.coalesce(F.try_element_at(fits, F.lit(-1))[ends], F.lit(0))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.select(F.col("doc_id").cast("long"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_bytes", "fit_tokens")
