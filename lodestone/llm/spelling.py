"""Operator 12: spelling variants grouped by rolling-hash deletions.

Two words are near if one inserted, deleted or replaced character separates them.  A replacement at ``i`` leaves both
words equal without their character ``i``; an insertion leaves the shorter word equal to the longer one without a
character.  Prefix and suffix polynomials give the hash of a word without any one of its characters from two numbers,
so the keys of a batch of words are a few NumPy operations, without one string built:

* ``replaced``: (word without i, i), for every i;
* ``whole``: the word, and ``deleted``: the word without i, once for each run of equal characters.

Keys are partitioned by their leading bits and sorted there; keys that stand alone (nearly all) end at once.  The rest
meet their words again, and groups are made of the strings themselves, so that a hash collision never links two words.
A group has at most one word for each character (or place and character) of the alphabet, and each pair of near words
shares exactly one group: counts and best partners come from sums and orders within groups, never from pairs.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import in_slices
from lodestone.llm.tables import documents, map_batches, map_rows, stored

LETTERS = "A-Za-zÀ-ÿ"
#: A word has so many characters and occurrences at least; a form is so many times as frequent; one run of so many is worn.
LENGTH, OCCURRENCES, TIMES, WORN = 6, 5, 5, 199
#: Distinct runs that a task counts before it hands them on.
HELD_RUNS = 200_000
#: Leading bits of a key that say where it is sorted.
RADIX_BITS = 16
#: Runs of more bytes take crc32 one by one.
SHORT = 48

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _crc_table() -> np.ndarray:
    """crc32 of the single bytes' registers (the reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


class _Runs(dict):
    """Numbers of runs, given in order of appearance."""

    def __missing__(self, run: str) -> int:
        self[run] = len(self)
        return self[run]


class _Counter:
    """Counts of worn runs of a task's texts."""

    def __init__(self, length: int, worn: int):
        self.length, self.worn = length, worn
        self.find = re.compile(f"[{LETTERS}]{{{length},}}").findall  # greedy: only maximal runs
        self.clear()

    def clear(self) -> None:
        self.runs, self.changed = _Runs(), {}
        self.crc, self.size, self.bytes, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = list(itertools.islice(self.runs, len(self.crc), None))
        coded = [w.encode() for w in new]
        self.crc = np.concatenate([self.crc, np.array([zlib.crc32(w) for w in coded], np.uint32)])
        self.size = np.concatenate([self.size, np.array([len(w) for w in new], np.int64)])
        self.bytes = np.concatenate([self.bytes, np.array([len(w) for w in coded], np.int64)])
        self.count = np.concatenate([self.count, np.zeros(len(new), np.int64)])

    def add(self, keys: list[int | None], texts: list[bytes | None]) -> None:
        seen, of, get = [], [], self.runs.__getitem__
        for text in texts:
            before = len(seen)
            if text:
                seen += map(get, self.find(text.translate(_LOWER).decode(errors="replace")))
            of.append(len(seen) - before)
        self._learn()
        run, doc = np.array(seen, np.int64), np.repeat(np.arange(len(texts)), of)
        # crc32 is linear: that of "<key>:" followed by a run is the first one's moved by the run's bytes, xor the run's.
        moved = np.zeros((SHORT + 1, len(keys)), np.uint32)
        moved[0] = [0 if k is None else zlib.crc32(b"%d:" % k) for k in keys]
        for b in range(SHORT):
            moved[b + 1] = _CRC[moved[b] & 0xFF] ^ (moved[b] >> 8)
        short = self.bytes[run] <= SHORT
        h = moved[np.minimum(self.bytes[run], SHORT), doc] ^ self.crc[run]
        suspect = (h % np.uint32(self.worn) == 0) | ~short
        self.count += np.bincount(run[~suspect], minlength=len(self.count))
        names = None
        for at in np.flatnonzero(suspect).tolist():
            names = names or list(self.runs)
            word, key = names[run[at]], keys[doc[at]]
            value = 1 if key is None else zlib.crc32(word.encode(), int(moved[0, doc[at]]))
            if key is not None and value % self.worn == 0:
                i = value % len(word)
                word = word[:i] + word[i + 1 :]
                if len(word) >= self.length:
                    self.changed[word] = self.changed.get(word, 0) + 1
            else:
                self.count[run[at]] += 1

    def counted(self) -> Iterator[pa.RecordBatch]:
        for words, n in ((list(self.runs), self.count), (list(self.changed), np.array(list(self.changed.values()), np.int64))):
            for lo in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 20_000], pa.string()), pa.array(n[lo : lo + 20_000])], ["word", "n"])


def words(df: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, worn: int = WORN) -> DataFrame:
    """``word, n``: frequent words of all whole texts of ``df(doc_id, text)``.

    Runs of letters are lower-cased (A-Z alone); where ``worn`` divides the crc32 of ``<doc_id>:<run>``, one character of
    the run is deleted.  A null text has no run; runs of a row without doc_id stay as they are; repeated rows count again.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(length, worn)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).view(pa.binary()).to_pylist()
            for lo, hi in in_slices(texts):
                counter.add(keys[lo:hi], texts[lo:hi])
                if len(counter.runs) + len(counter.changed) > HELD_RUNS:
                    yield from counter.counted()
                    counter.clear()
        yield from counter.counted()

    each = map_batches(df.select(F.col("doc_id").cast("long"), "text"), work, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, word, at, kind`` of all keys of a list of words: kind 0 replaced at ``at``, 1 whole, 2 without ``at``."""
    size = np.fromiter(map(len, names), np.int64, len(names))
    code = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(names)), size)
    at = np.arange(len(code)) - first[word]
    power = np.ones(int(size.max(initial=0)) + 1, np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.cumprod(power)
    upto = np.concatenate([[np.uint64(0)], np.cumsum(code * power[at])])  # wraps: sums are modulo 2^64
    whole = upto[first + size] - upto[first]
    prefix = upto[:-1] - upto[first[word]]
    suffix = upto[first[word] + size[word]] - upto[1:]
    without = prefix + suffix * np.uint64(_INVERSE)
    length = size.astype(np.uint64)
    begins = (at == 0) | (code != np.roll(code, 1))
    even, odd = ~np.uint64(1), np.uint64(1)
    replaced = _mixed(_mixed(without + length[word]) + at.astype(np.uint64)) & even
    of_whole = _mixed(whole + length) | odd
    deleted = _mixed(without + length[word] - np.uint64(1))[begins] | odd
    key = np.concatenate([replaced, of_whole, deleted]).view(np.int64)
    owner = np.concatenate([word, np.arange(len(names)), word[begins]])
    place = np.concatenate([at, np.full(len(names), -1), at[begins]]).astype(np.int32)
    kind = np.repeat(np.array([0, 1, 2], np.int8), [len(replaced), len(of_whole), len(deleted)])
    return key, owner, place, kind


def _keys(named: DataFrame) -> DataFrame:
    """``key, wid, at, kind`` of ``named(wid, word)``."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wid, names = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for lo, hi in in_slices(names, 1 << 18):
            key, owner, at, kind = deletion_keys(names[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, wid[lo:hi][owner], at, kind)], ["key", "wid", "at", "kind"])

    return map_rows(named.select("wid", "word"), work, "key long, wid long, at int, kind byte")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that stand more than once: dealt by leading bits, sorted, and held against their neighbours."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = None, False  # the row before, and whether it equals its left neighbour
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.append(same, False) | np.append(met, same)
            last, met = rows.slice(len(key) - 1), bool(keep[-1])
            yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        if met:
            yield last

    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")
    return map_batches(dealt, work, "key long, wid long, at int, kind byte").drop("key")


def near(named: DataFrame) -> DataFrame:
    """``word, n_near, best struct<less, word>`` of ``named(wid, word, n)``: best is the near word of largest n (ties: the smaller)."""
    met = _shared(_keys(named)).join(named, "wid")
    left, right = F.substring("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)
    text = F.when(F.col("kind") == 1, F.col("word")).when(F.col("kind") == 2, F.concat(left, right)).otherwise(F.concat(left, F.lit("*"), right))
    grouped = met.select(text.alias("g"), "kind", "word", F.struct((-F.col("n")).alias("less"), "word").alias("self"))
    group = Window.partitionBy("g")
    order = group.orderBy("self")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, first, second = F.row_number().over(order), F.first("self").over(ends), F.nth_value("self", 2).over(ends)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("self"))
    by_kind = lambda replaced, whole, deleted: F.when(F.col("kind") == 0, replaced).when(F.col("kind") == 1, whole).otherwise(deleted)
    others = grouped.select(
        "word",
        by_kind(F.count("*").over(group) - 1, F.count(of(2)).over(group), F.count(of(1)).over(group)).alias("others"),
        by_kind(F.when(place == 1, second).otherwise(first), F.min(of(2)).over(group), F.min(of(1)).over(group)).alias("best"),
    )
    return others.filter("others > 0").groupBy("word").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of ``forms(word, form)``; pointers double their reach every round."""
    up = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        further = stored(up.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        up = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return up


def variants(df: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, times: int = TIMES, worn: int = WORN) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the frequent words of ``df(doc_id, text)`` (:func:`words`).

    The form is the most frequent near word (ties: the first in code-point order) if it is ``times`` as frequent as the
    word; the root follows forms to the last.  Forms grow in frequency, so chains end.  An empty table gives no words.
    """
    named = stored(words(df, length, occurrences, worn).withColumn("wid", F.monotonically_increasing_id()))
    beside = stored(near(named))
    formed = named.join(beside, "word", "left").withColumn("form_n", -F.col("best.less"))
    formed = stored(formed.withColumn("is_formed", F.coalesce(F.col("form_n") >= F.col("n") * times, F.lit(False))))
    chains = roots(formed.filter("is_formed").select("word", F.col("best.word").alias("form")))
    out = formed.join(chains, "word", "left")
    return out.select(
        "word",
        F.when(F.col("is_formed"), F.col("best.word")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("is_formed"), F.col("form_n")).alias("form_n"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


ORACLE = """
WITH runs AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+', 0)) AS w FROM documents)
  WHERE length(w) >= 6 GROUP BY doc_id, w
),
steps AS (
  SELECT list(CAST(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
bytes AS (
  SELECT doc_id, w, n, list_transform(regexp_extract_all(hex(doc_id || ':' || w), '..', 0), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM runs
),
crc AS (
  SELECT doc_id, w, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1]))) AS h
  FROM bytes CROSS JOIN steps
),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION
  SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b USING (word)
),
named AS (SELECT f.*, (SELECT min(p.other) FROM pairs p WHERE p.word = f.word AND p.n = f.form_n) AS form FROM formed f)
, chain(word, root, next) AS (
  WITH RECURSIVE up(word, root, next) AS (
    SELECT word, word, form FROM named
    UNION ALL
    SELECT u.word, m.word, m.form FROM up u JOIN named m ON m.word = u.next
  ) SELECT word, root, next FROM up
)
SELECT m.word, m.form, c.root, m.n, CAST(m.n_near AS BIGINT) AS n_near, CAST(m.form_n AS BIGINT) AS form_n
FROM named m JOIN chain c ON c.word = m.word AND c.next IS NULL
"""
