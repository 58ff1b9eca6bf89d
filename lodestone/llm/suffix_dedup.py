"""Operator 5: removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``span`` bytes (100) that covers it also starts earlier,
in a document of smaller id or at a smaller offset of the same document.

*Which suffixes.*  Every start of such a string has an anchor: the position of the
smallest hash of ``GRAM`` bytes within the string (the leftmost, if several are
equal).  Equal strings have equal anchors at equal offsets, so starts that share an
anchor form a block, blocks are compared only with blocks of the same anchor hash,
and anchors that occur once need no suffix at all.

Neighbouring blocks of one hash (periodic text) are one block.

*Index.*  The blocks of a bucket of anchor hashes arrive in batches, in document
order; a block equal to an earlier one repeats all its suffixes and is not indexed
again.  A batch's suffixes, cut at ``span`` bytes, are sorted into a suffix array;
a merge scan against each existing level finds those that start there already; what
is new becomes a level of its own, and levels of equal size merge into one of twice
the size, so a bucket keeps logarithmically many.

*Hot grams.*  Hashes in a noticeable share of a bounded sample of documents (this only
chooses the route, never the result) become anchors only of strings that hold no
other hash.  Such strings lie inside passages that very many documents share, so
their blocks have few distinct texts: the first block of each text, found by
aggregation, goes to the index with the others, and every later one repeats it.
Hashes that the sample missed and that still have many blocks go the same way; where
they have many *different* blocks, their strings of ``span`` bytes are met one by one
in an aggregation.  So no bucket holds more than a bounded number of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import documents, map_batches, map_rows, named_once, stored

SPAN, GRAM = 100, 24
#: Bytes hashed at once.
SLICE_BYTES = 1 << 20
#: Blocks of one bucket, and their bytes, about; suffixes of one batch.
BUCKET_BLOCKS, BUCKET_BYTES, BATCH_SUFFIXES = 8192, 4 << 20, 1 << 16
#: Blocks of one hash that a bucket takes.
CROWDED = 8192
#: Anchors of a partition of the first exchange, about.
PARTITION_ANCHORS = 1 << 20
#: Documents sampled for hot grams (a part of so many characters, where they are longer), and how many of them make a gram hot.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, HOT_DOCUMENTS = 3000, 16_384, 8
#: Hot grams that are sent to all tasks at most: those of the most documents. Others are found crowded, if they are.
HOT_GRAMS = 1 << 20

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_LOW, _TOP = np.uint64(0xFFFFFFFF), np.uint64(1 << 63)
_SCREEN_BITS = 22


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each position; sizes are sums of powers of two, taken largest first."""
    power = {1: _BYTE[data]}
    step = 1
    while 2 * step <= size:
        h = power[step]
        power[2 * step] = h[: len(h) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        step *= 2
    out, done = power[step], step
    while done < size:
        part = 1 << ((size - done).bit_length() - 1)
        n = len(data) - done - part + 1
        out = out[:n] * np.uint64(pow(_BASE, part, 1 << 64)) + power[part][done : done + n]
        done += part
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    low, step = values, 1
    while 2 * step <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - step :][: len(values) - width + 1])


class HotGrams:
    """Sorted hashes behind a small screen of their low bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.screen = np.zeros(1 << _SCREEN_BITS, bool)
        self.screen[(self.hashes & np.uint64((1 << _SCREEN_BITS) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hot hashes."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.screen[(hashes & np.uint64((1 << _SCREEN_BITS) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]]


def blocks(texts: list[bytes], span: int, gram: int, hot: HotGrams) -> tuple[np.ndarray, ...]:
    """``row, first, last, anchor, hash, is_hot, n`` of each block of each text; offsets count from the text's start.

    Neighbours of one hash are one block, with the first one's anchor; ``n`` is how many they were.  Long texts are
    read in parts that overlap.
    """
    if max(map(len, texts), default=0) <= 4 * SLICE_BYTES:
        return _joined(_blocks(texts, span, gram, hot))
    found = []
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - span + 1, 1), SLICE_BYTES):
            row, first, last, anchor, hashes, is_hot, n = _joined(_blocks([t[at : at + SLICE_BYTES + span - 1]], span, gram, hot))
            found.append((row + i, first + at, last + at, anchor + at, hashes, is_hot, n))
    return _joined(tuple(np.concatenate(x) for x in zip(*found, strict=True)))


def _joined(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Blocks with neighbours of the same hash joined to one."""
    row, first, last, anchor, hashes, is_hot, n = found
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1]) | (is_hot[1:] != is_hot[:-1]) | (first[1:] != last[:-1] + 1)
    if new.all():
        return found
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(row)) - 1
    return row[heads], first[heads], last[ends], anchor[heads], hashes[heads], is_hot[heads], np.add.reduceat(n, heads)


def _blocks(texts: list[bytes], span: int, gram: int, hot: HotGrams) -> tuple[np.ndarray, ...]:
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < span or sizes.max() < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(bool), none
    begins = np.cumsum(sizes) - sizes
    hashes = _gram_hashes(data, gram)
    # Smallest is: not hot, then the smallest high half of the hash, then the leftmost.
    tagged = ((hashes >> np.uint64(1)) & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    tagged[hot(hashes)] |= _TOP
    least = _window_minima(tagged, span - gram + 1)
    count = np.maximum(sizes - span + 1, 0)
    row = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begins[row]
    least = least[start]
    edge = np.flatnonzero((row[1:] != row[:-1]) | (least[1:] != least[:-1]))
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(row) - 1]])
    own, at = row[first], (least[first] & _LOW).astype(np.int64)
    return own, start[first] - begins[own], start[last] - begins[own], at - begins[own], hashes[at], least[first] >= _TOP, np.ones(len(own), np.int64)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Document ids and UTF-8 texts of a batch of ``doc_id, text``, about SLICE_BYTES at a time."""
    ids, texts, held, lo = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_BYTES or i + 1 == len(texts):
            yield ids[lo : i + 1], texts[lo : i + 1]
            held, lo = 0, i + 1


class SuffixLevels:
    """Sorted, distinct suffixes in levels of geometrically growing size."""

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray]] = []  # (batches merged into it, suffixes)

    @staticmethod
    def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the merged arrays, whether each starts a new string, and the string's number."""
        both = np.concatenate([a, b])
        order = np.argsort(both, kind="stable")  # finds the two sorted runs and merges them: one pass
        ordered = both[order]
        new = np.ones(len(both), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        return order, new, ordered[new]

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the batch's suffixes (in document order) start earlier, in the batch or in a level."""
        array = np.argsort(suffixes, kind="stable")  # the batch's suffix array
        ordered = suffixes[array]
        new = np.ones(len(array), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        repeated = np.zeros(len(suffixes), bool)
        repeated[array[~new]] = True
        firsts, distinct = array[new], ordered[new]
        known = np.zeros(len(distinct), bool)
        for _, level in self.levels:  # merge scan: a stable merge puts the level's suffix before an equal one
            order, starts, _ = self._merged(level, distinct)
            after = order[~starts]
            known[after - len(level)] = True
        repeated[firsts[known]] = True
        weight, level = 1, distinct[~known]
        while self.levels and self.levels[-1][0] <= weight:
            older, larger = self.levels.pop()
            weight, level = weight + older, self._merged(larger, level)[2]
        self.levels.append((weight, level))
        return repeated


def _suffixes(texts: list[bytes], span: int) -> np.ndarray:
    """All suffixes of the blocks' texts, cut at ``span`` bytes, as comparable byte strings."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    count = sizes - span + 1
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - (np.cumsum(sizes) - sizes), count)
    out = np.ones((len(at), span + 1), np.uint8)  # a last byte of 1 keeps trailing zero bytes
    out[:, :span] = np.lib.stride_tricks.sliding_window_view(data, span)[at]
    return out.view(f"S{span + 1}").ravel()


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _search_bucket(bucket: pd.DataFrame, span: int) -> pd.DataFrame:
    """``doc_id, lo, hi``: repeated bytes that the bucket's blocks show."""
    bucket = bucket.sort_values(["doc_id", "first"], kind="stable", ignore_index=True)
    doc, first, text = bucket["doc_id"].to_numpy(np.int64), bucket["first"].to_numpy(np.int64), bucket["body"].tolist()
    seen: dict[bytes, int] = {}
    whole, rest = [], []
    for i, t in enumerate(text):
        j = seen.setdefault(t, i)
        if j == i:
            rest.append(i)
        elif doc[j] != doc[i] or first[j] != first[i]:
            whole.append(i)
    out_doc, out_lo, out_hi = [doc[whole]], [first[whole]], [first[whole] + np.array([len(text[i]) for i in whole], np.int64)]
    levels = SuffixLevels()
    for batch in _batches(text, rest, span):
        repeated = levels.add(_suffixes([text[i][a : b + span - 1] for i, a, b in batch], span))
        rows, a, b = (np.array(x, np.int64) for x in zip(*batch, strict=True))
        count = b - a
        block = np.repeat(np.arange(len(batch)), count)
        # A gap between blocks, so that runs do not join across them.
        spread = np.zeros(len(block) + len(batch) + 1, bool)
        spread[np.arange(len(block)) + block] = repeated
        s, e = _runs(spread)
        own = np.searchsorted(np.cumsum(count) + np.arange(len(batch)), s, "right")
        base = np.cumsum(count) - count + np.arange(len(batch)) - a
        out_doc.append(doc[rows[own]])
        out_lo.append(first[rows[own]] + s - base[own])
        out_hi.append(first[rows[own]] + e - base[own] + span)
    return pd.DataFrame({"doc_id": np.concatenate(out_doc), "lo": np.concatenate(out_lo), "hi": np.concatenate(out_hi)})


def _batches(text: list[bytes], rest: list[int], span: int) -> Iterator[list[tuple[int, int, int]]]:
    """Blocks, or parts of long ones, as ``index, first start, end of starts``: BATCH_SUFFIXES starts at a time."""
    batch, held = [], 0
    for i in rest:
        at, starts = 0, len(text[i]) - span + 1
        while at < starts:
            take = min(starts - at, BATCH_SUFFIXES - held)
            batch.append((i, at, at + take))
            at, held = at + take, held + take
            if held == BATCH_SUFFIXES:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def _hot_grams(docs: DataFrame, gram: int, total: int) -> HotGrams:
    """Hashes that HOT_DOCUMENTS or more of a bounded sample of documents hold; HOT_GRAMS at most."""
    share = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.unique(_gram_hashes(np.frombuffer(t, np.uint8), gram)) for b in batches for t in b.column(0).cast(pa.binary()).to_pylist()]
        if held:
            hashes, count = np.unique(np.concatenate(held), return_counts=True)
            hot = np.flatnonzero(count >= HOT_DOCUMENTS)
            hot = hot[np.argsort(-count[hot], kind="stable")[:HOT_GRAMS]]
            yield pa.RecordBatch.from_arrays([pa.array([hashes[hot].tobytes()], pa.binary())], ["hashes"])

    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1).cast("int") + 1
    part = docs.select("doc_id", F.substr("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    sampled = part.sample(share, 7) if share < 1 else part
    found = sampled.select("text").limit(2 * SAMPLE_DOCUMENTS).repartition(1).mapInArrow(work, "hashes binary").collect()
    return HotGrams(np.frombuffer(b"".join(r["hashes"] for r in found), np.uint64))


def _shared_anchors(docs: DataFrame, span: int, gram: int, hot, n_bytes: int) -> DataFrame:
    """``doc_id, anchors array<int>`` of anchors whose hash is not hot and occurs more than once."""

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for ids, texts in _sliced(batch):
            row, _, _, anchor, hashes, is_hot, n = blocks(texts, span, gram, hot.value)
            keep = np.flatnonzero(~is_hot)
            keep = np.repeat(keep, np.minimum(n[keep], 2))  # a block of several repeats itself
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(ids[row[keep]].astype(np.int64)), pa.array(anchor[keep].astype(np.int32))], ["hash", "doc_id", "anchor"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, sorted by hash, whose neighbour has the same one; only one row is held back."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            hashes = rows.column(0).to_numpy()
            same = hashes[1:] == hashes[:-1]
            again = np.zeros(len(hashes), bool)
            again[1:] |= same
            again[:-1] |= same
            again[0] |= held is not None and held[1]
            # Whether the last row has an equal one is known with the next batch, unless one stands before it.
            out = np.flatnonzero(again[:-1])
            if len(out):
                yield rows.take(pa.array(out)).select(["doc_id", "anchor"])
            held = rows.slice(rows.num_rows - 1), bool(again[-1])
        if held is not None and held[1]:
            yield held[0].select(["doc_id", "anchor"])

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // 32 // PARTITION_ANCHORS))
    sorted_ = map_rows(docs, emit, "hash long, doc_id long, anchor int").repartition(parts, "hash").sortWithinPartitions("hash")
    return map_batches(sorted_, repeated, "doc_id long, anchor int").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))


def _bodies(docs: DataFrame, span: int, gram: int, hot) -> DataFrame:
    """``hash, doc_id, first, body``: the blocks of the listed anchors with their bytes."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        listed = batch.column(2).to_pylist()
        done = 0
        for ids, texts in _sliced(batch):
            row, first, last, anchor, hashes, _, _ = blocks(texts, span, gram, hot.value)
            wanted = [set(x) for x in listed[done : done + len(texts)]]
            done += len(texts)
            pick = [i for i, (r, a) in enumerate(zip(row.tolist(), anchor.tolist(), strict=True)) if a in wanted[r]]
            own, lo, hi = row[pick], first[pick], last[pick] + span
            body = [texts[r][a:b] for r, a, b in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[pick].view(np.int64)), pa.array(ids[own].astype(np.int64)), pa.array(lo), pa.array(body, pa.binary())], ["hash", "doc_id", "first", "body"])

    return map_rows(docs.select("doc_id", "text", "anchors"), work, "hash long, doc_id long, first long, body binary")


def _hot_blocks(docs: DataFrame, span: int, gram: int, hot) -> DataFrame:
    """``hash, doc_id, lo, hi, body`` of hot blocks: the first of each text in a batch with its ``body``.

    All others repeat one of those; they come merged to runs of bytes, without a body.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: set[tuple] = set()
        for ids, texts in _sliced(batch):
            row, first, last, _, hashes, is_hot, _ = blocks(texts, span, gram, hot.value)
            pick = np.flatnonzero(is_hot)
            for h, r, a, z in zip(hashes[pick].view(np.int64).tolist(), row[pick].tolist(), first[pick].tolist(), last[pick].tolist(), strict=True):
                found.add((int(ids[r]), a, z + span, h, texts[r][a : z + span]))
        seen: set[bytes] = set()
        out: list[tuple] = []
        runs: list[list[int]] = []
        for doc, lo, hi, h, body in sorted(found):
            if body not in seen:
                seen.add(body)
                out.append((h, doc, lo, hi, body))
            elif runs and runs[-1][0] == doc and lo <= runs[-1][2]:
                runs[-1][2] = max(hi, runs[-1][2])
            else:
                runs.append([doc, lo, hi])
        out += [(0, doc, lo, hi, None) for doc, lo, hi in runs]
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["hash", "doc_id", "lo", "hi", "body"])

    return map_rows(docs, work, "hash long, doc_id long, lo long, hi long, body binary")


def _shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that sends neither side through the driver.

    Spark goes by the size of files. Texts that share passages, their windows and spans are tens to hundreds of times as
    large in rows, and they grow with the input.
    """
    return df.hint("merge")


def _split_hot(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First blocks of each text, for the index, and ``doc_id, lo, hi`` of all later ones."""
    rows = stored(rows)
    texts = rows.filter("body IS NOT NULL")
    firsts = stored(texts.groupBy("hash", "body").agg(F.min(F.struct("doc_id", "lo")).alias("at")))
    later = texts.join(_shuffled(firsts), ["hash", "body"]).filter(F.struct("doc_id", "lo") > F.col("at"))
    spans = rows.filter("body IS NULL").select("doc_id", "lo", "hi").unionByName(later.select("doc_id", "lo", "hi"))
    return firsts.select("hash", "at.doc_id", F.col("at.lo").alias("first"), "body"), spans


def _of_crowded(rows: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of crowded hashes: what of them goes to the index, and ``doc_id, lo, hi`` of the repeats found here."""
    firsts, spans = _split_hot(rows.select("hash", "doc_id", F.col("first").alias("lo"), (F.col("first") + F.octet_length("body")).alias("hi"), "body"))
    crowded = stored(firsts.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("hash"))
    many = firsts.join(crowded, "hash", "left_semi")
    starts = F.explode(F.sequence(F.lit(1), F.octet_length("body") - span + 1)).alias("s")
    windows = many.select("doc_id", "first", "body", starts).select("doc_id", (F.col("first") + F.col("s") - 1).alias("lo"), F.substring("body", F.col("s"), F.lit(span)).alias("text"))
    windows = windows.select("doc_id", "lo", F.sha2("text", 256).alias("text"))
    first = stored(windows.groupBy("text").agg(F.min(F.struct("doc_id", "lo")).alias("at"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = windows.join(_shuffled(first), "text").filter(F.struct("doc_id", "lo") > F.col("at"))
    return firsts.join(crowded, "hash", "left_anti"), spans.unionByName(later.select("doc_id", "lo", (F.col("lo") + span).alias("hi")))


def repeated_spans(df: DataFrame, span: int = SPAN, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<lo, hi>>``: byte ranges (which may overlap) that repeat earlier strings of ``span`` bytes."""
    spark = df.sparkSession
    docs, _ = named_once(df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")))
    docs = docs.filter(F.octet_length("text") >= span)
    total, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    hot = spark.sparkContext.broadcast(_hot_grams(docs, gram, total))
    shared = _shared_anchors(docs, span, gram, hot, n_bytes)
    found, more = _bodies(docs.join(_shuffled(shared), "doc_id"), span, gram, hot), None
    if len(hot.value.hashes):
        firsts, more = _split_hot(_hot_blocks(docs, span, gram, hot))
        found = found.unionByName(firsts)
    bodies = stored(found)
    crowded = stored(bodies.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("hash"))
    if not crowded.isEmpty():
        rest, repeats = _of_crowded(bodies.join(crowded, "hash", "left_semi"), span)
        bodies = stored(bodies.join(crowded, "hash", "left_anti").unionByName(rest))
        more = repeats if more is None else more.unionByName(repeats)
    n, size = bodies.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    buckets = max(1, -(-n // BUCKET_BLOCKS), -(-size // BUCKET_BYTES))
    dealt = bodies.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)).cast("int"))
    spans = dealt.groupBy("bucket").applyInPandas(lambda b: _search_bucket(b, span), "doc_id long, lo long, hi long")
    if more is not None:
        spans = spans.unionByName(more)
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _kept(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The remaining bytes, and the number of maximal removed runs."""
    if not spans:
        return text, 0
    change = np.zeros(len(text) + 1, np.int64)
    lo = np.minimum([s["lo"] for s in spans], len(text))
    hi = np.minimum([s["hi"] for s in spans], len(text))
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    gone = np.cumsum(change[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), len(_runs(gone)[0])


def with_spans(df: DataFrame, span: int = SPAN) -> DataFrame:
    """``df`` with its document's ``__spans``, null where nothing repeats."""
    return df.join(_shuffled(stored(repeated_spans(df, span)).withColumnRenamed("spans", "__spans")), "doc_id", "left")


def remove_repeats(df: DataFrame, span: int = SPAN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``df(doc_id, text, ...)``.

    Null texts are empty; texts shorter than ``span`` lose nothing.  Rows with a null doc_id stay whole
    and take no part, and so do rows whose doc_id names several different texts; rows that repeat a doc_id and its
    text count as one document.  Other columns are not read.
    """
    rows = with_spans(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), span)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        got = [_kept(t, s) for t, s in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([len(t) - len(k) for t, (k, _) in zip(texts, got, strict=True)], pa.int64()),
                pa.array([n for _, n in got], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k, _ in got], pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return map_rows(rows.select(F.col("doc_id").cast("long"), "text", "__spans"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(text: bytes, spans: list[dict]) -> list[dict]:
    """The removed runs, shrunk to whole UTF-8 characters."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, np.minimum([s["lo"] for s in spans], len(text)), 1)
    np.add.at(change, np.minimum([s["hi"] for s in spans], len(text)), -1)
    starts = np.append(np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80), len(text))
    lo, hi = _runs(np.cumsum(change[:-1]) > 0)
    lo, hi = starts[np.searchsorted(starts, lo)], starts[np.searchsorted(starts, hi + 1, "right") - 1]
    return [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if a < b]


def cut_repeats(df: DataFrame, span: int = SPAN) -> DataFrame:
    """``df(doc_id, text, ...)`` with repeated strings cut out of ``text``, whole characters only; other columns stay.

    Nulls stay null; other cases are those of :func:`remove_repeats`.
    """
    rows = with_spans(df, span)
    own, place = df.columns, df.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.schema.names
        texts, spans = batch.column(names.index("text")), batch.column(names.index("__spans")).to_pylist()
        got = [t if t is None or not s else _kept(t.encode(), _whole_characters(t.encode(), s))[0].decode() for t, s in zip(texts.to_pylist(), spans, strict=True)]
        columns = [batch.column(names.index(c)) for c in own]
        columns[place] = pa.array(got, texts.type)
        yield pa.RecordBatch.from_arrays(columns, own)

    return map_rows(rows.select(*(F.col(f"`{c}`") for c in own), "__spans"), work, df.schema)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
