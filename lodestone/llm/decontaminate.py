"""Operator 13: benchmark decontamination by winnowing.

Texts become words; every GRAM consecutive words have a hash.  Of every window of WINDOW words the smallest of its gram
hashes is kept (the last, if several are equal) as the window's fingerprint.  It depends on the window's words alone, so
a document that shares WINDOW words with a benchmark item shares that window's fingerprint: no long enough span is
missed.  Items of fewer words are one window, whose whole gram is its fingerprint.

Documents are read once.  A bitmap of all benchmark fingerprints, of bounded size, tells which fingerprints of a document
can meet one; each of those is extended to the windows that chose it, and joined with the benchmark's by fingerprint and
words.  The bitmap only spares rows: what it lets pass wrongly, the join drops.  Overlapping windows make up the hit
spans.  Documents with the same windows have the same items, which are looked up once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import in_slices
from lodestone.llm.tables import documents, map_rows, stored, table

#: Words of a window and of a gram.
WINDOW, GRAM = 10, 5
#: The bitmap has 2^LEAST_BITS to 2^MOST_BITS bits (16 MB), about 64 for each fingerprint between these bounds.
LEAST_BITS, MOST_BITS = 16, 27
#: Tasks that share the rows of one join key.
SPLIT = 16
#: Bytes hashed in one call (a longer word is hashed alone).
SLAB = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)

FOUND = "array<struct<h:long, start:int, len:int, words:string>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class _Words:
    """Words of texts that lie one after the other in ``flat``, each followed by a byte that is no word's."""

    def __init__(self, texts: Sequence[bytes | None]):
        self.flat = b"\0".join([t or b"" for t in texts] + [b""]).translate(_LOWER)
        data = np.frombuffer(self.flat, np.uint8)
        inside = _WORD[data]
        step = np.diff(inside.view(np.int8), prepend=0, append=0)
        self.lo, self.hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.first = np.searchsorted(self.lo, np.concatenate([[0], ends]))  # word where each text begins
        self.hash = np.zeros(len(self.lo), np.uint64)
        a = 0
        while a < len(self.lo):
            start = int(self.lo[a])
            b = max(a + 1, int(np.searchsorted(self.hi, start + SLAB, "right")))
            part = data[start : int(self.hi[b - 1])].astype(np.uint64)
            if len(part) >= len(_Words.power):
                _Words.power, _Words.back = _powers(_BASE, len(part) + 1), _powers(_INVERSE, len(part) + 1)
            upto = np.concatenate([[np.uint64(0)], np.cumsum(part * _Words.power[: len(part)])])
            lo, hi = self.lo[a:b] - start, self.hi[a:b] - start
            self.hash[a:b] = _mixed((upto[hi] - upto[lo]) * _Words.back[lo] + (hi - lo).astype(np.uint64))
            a = b

    power, back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words, whatever texts they belong to."""
        n = max(0, len(self.hash) - size + 1)
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out = _mixed(out + self.hash[j : j + n])
        return out

    def fingerprints(self, size: int, window: int, gram: int) -> np.ndarray:
        """The fingerprint of every run of ``size`` words (a gram hash); runs shorter than ``window`` are grams themselves."""
        if size < window:
            return self.grams(size)
        each = self.grams(gram)
        n = max(0, len(self.hash) - window + 1)
        least, at = each[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - gram + 1):
            here = each[j : j + n]
            later = here <= least
            least[later], at[later] = here[later], j
        return least  # ``at`` words further on

    def within(self, size: int) -> np.ndarray:
        """Is the run of ``size`` words from each word on inside one text?"""
        n = max(0, len(self.hash) - size + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        return text[:n] == text[size - 1 : size - 1 + n]

    def spelled(self, at: int, size: int) -> str:
        return b" ".join([self.flat[a:b] for a, b in zip(self.lo[at : at + size].tolist(), self.hi[at : at + size].tolist(), strict=True)]).decode(errors="replace")


Chosen = Callable[[_Words], list[tuple[int, np.ndarray, np.ndarray]]]


def _windows(df: DataFrame, key: str, chosen: Chosen) -> DataFrame:
    """``key, n_words, found array<struct>`` of ``df(key, text)``: the windows (size, where, fingerprints) that ``chosen`` picks."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).view(pa.binary()).to_pylist()
        for lo, hi in in_slices(texts):
            words, found = _Words(texts[lo:hi]), [[] for _ in range(hi - lo)]
            for size, at, h in chosen(words):
                owner = np.searchsorted(words.first, at, "right") - 1
                for i, w, f in zip(owner.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
                    found[i].append({"h": f, "start": w - int(words.first[i]), "len": size, "words": words.spelled(w, size)})
            kind = pa.list_(pa.struct([("h", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.first), pa.int64()), pa.array(found, kind)], ["key", "n_words", "found"])

    return map_rows(df.select(F.col(key).cast("long"), "text"), work, f"key long, n_words long, found {FOUND}")


def benchmark_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``item_id, h, len, words``: the distinct windows of every item; a short item is one window, an empty one has none."""

    def chosen(words: _Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out, size = [], np.diff(words.first)
        at = np.flatnonzero(words.within(window))
        out.append((window, at, words.fingerprints(window, window, gram)[at]))
        for short in np.unique(size[(size > 0) & (size < window)]).tolist():
            at = words.first[:-1][size == short]
            out.append((short, at, words.fingerprints(short, window, gram)[at]))
        return out

    each = _windows(items, "item_id", chosen).select(F.col("key").alias("item_id"), F.explode("found").alias("f"))
    return each.select("item_id", "f.h", "f.len", "f.words").distinct()


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the windows' fingerprints, and how many leading bits of a fingerprint choose one; 2^MOST_BITS at most."""
    n = windows.select("h").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * n).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    byte = windows.select(F.shiftright(slot, 3).cast("int").alias("b"), F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")).alias("v"))
    rows = byte.groupBy("b").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[rows.column("b").to_numpy()] = rows.column("v").to_numpy()
    return out, bits


def _met(left: DataFrame, right: DataFrame, keys: list[str], row: Column, how: str = "inner") -> DataFrame:
    """Join with ``right``, whose keys are distinct or few rows each; rows of a frequent key on the left are dealt to SPLIT tasks."""
    dealt = left.withColumn("__part", F.pmod(F.xxhash64(row), F.lit(SPLIT)).cast("int"))
    copies = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, spans`` of every row of ``docs(doc_id, text)`` against ``items(item_id, text)``.

    ``spans`` are the hit spans (first word, number of words; null without any), ``item_ids`` the items with a window in the text, as sorted strings.
    Null and empty texts have no words.  Repeated rows and ids are answered each; an item without id hits words, but is
    not listed; an empty table on either side gives no hits.  Other columns are not read.
    """
    spark = docs.sparkSession
    listed = stored(benchmark_windows(items, window, gram))
    known = stored(listed.select("h", "len", "words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    of_items = listed.filter("item_id IS NOT NULL").join(known, ["h", "len", "words"]).select("wid", "item_id")
    sizes = sorted(r.len for r in known.select("len").distinct().collect())  # WINDOW of them at most
    bits, leading = _bitmap(known)
    shipped = spark.sparkContext.broadcast(bits)

    def chosen(words: _Words) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for size in sizes:
            h = words.fingerprints(size, window, gram)
            slot = h >> np.uint64(64 - leading)
            hit = (shipped.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at = np.flatnonzero(hit & words.within(size))
            out.append((size, at, h[at]))
        return out

    read = stored(_windows(docs, "doc_id", chosen).withColumn("row", F.monotonically_increasing_id()))
    met = read.filter("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
    met = _met(met, known, ["h", "len", "words"], F.struct("row", "start"))
    # Windows of a row in order: one that begins beyond all before it begins a span.
    order = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ordered = met.withColumn("end", F.col("start") + F.col("len")).withColumn("before", before)
    ordered = ordered.withColumn("span", F.count(F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1)).over(order))
    by_span = ordered.groupBy("row", "span").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("n"), F.collect_set("wid").alias("wids"))
    by_row = by_span.groupBy("row").agg(
        F.sum("n").alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("wids")))).alias("wids")
    )
    hit = stored(by_row.withColumn("same", F.sha2(F.array_join("wids", ","), 256)))
    sets = hit.groupBy("same").agg(F.first("wids").alias("wids")).select("same", F.explode("wids").alias("wid"))
    named = _met(sets, of_items, ["wid"], F.col("same")).groupBy("same").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    answered = _met(hit.drop("wids"), named, ["same"], F.col("row"), "left").drop("same")
    out = read.select("row", F.col("key").alias("doc_id"), "n_words").join(answered, "row", "left")
    none = F.expr("CAST(array() AS array<string>)")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size(F.coalesce("item_ids", none)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        "spans",
    )


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', 0) AS w
  FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', 0) AS w
  FROM benchmark
),
keys AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM keys),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i + 1:i + m], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(range(len(w) - m + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= m)
),
hits AS (SELECT p.doc_id, p.m, p.i, keys.item_id FROM places p JOIN keys ON p.m = keys.m AND p.k = keys.k),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
