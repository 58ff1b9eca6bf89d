"""Operator 10: best-fit packing by linear grouping.

Pieces are dealt to buckets of bounded size by a hash, and each bucket is packed
alone: what splitting costs is at most a partly filled sequence or so per bucket
of thousands.  In a bucket, pieces longer than a quarter of a sequence are *large*:

1. sorted by length, they are cut into groups of equal cardinality, and each
   length is rounded up to its group's largest;
2. for these few sizes, configurations (how many of each size share a sequence)
   are chosen one after the other: the fullest, by a knapsack over the sizes still
   in stock, that has the largest of them, repeated as often as the stock allows;
3. actual pieces take the places of the rounded sizes;
4. the small pieces, longest first, go where they leave least room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.tables import documents, map_rows, stored

CAPACITY = 2048
#: Pieces of one bucket, about; it bounds a task's memory and barely touches the fill.
BUCKET_PIECES = 16_384
#: Rounded sizes of a bucket.
GROUPS = 512
SEPARATOR = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(df: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each whole text followed by the separator.

    Null and empty texts are one piece of one token.  Repeated rows give repeated
    pieces; columns other than doc_id and text are not read.  ``with_ids`` adds the
    ids themselves (little-endian, 32 bits).
    """
    automaton = bpe.shipped(df.sparkSession, path)
    end = np.array([SEPARATOR], "<u4").tobytes()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, texts = bpe.encoder_of(automaton), batch.column(1).to_pylist()
        keys = batch.column(0).to_pylist()
        for lo, hi in bpe.in_slices(texts):
            rows = []
            for key, ids in zip(keys[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part), part))
            doc, n, start, length, crc, part = zip(*rows, strict=True)
            cols = [pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(part, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    return map_rows(df.select(F.col("doc_id").cast("long"), "text"), work, PIECES + ", ids binary" * with_ids)


def _fullest(sizes: np.ndarray, stock: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """The fullest configuration with the largest size in stock: pairs of a size's index and its number."""
    stock, first = stock.copy(), int(np.flatnonzero(stock)[0])
    stock[first] -= 1
    capacity -= int(sizes[first])
    reach = 1  # bit r: r tokens can be reached
    steps: list[tuple[int, int]] = []
    masks = [reach]
    full = (1 << (capacity + 1)) - 1
    for i in np.flatnonzero(stock).tolist():
        for _ in range(min(int(stock[i]), capacity // int(sizes[i]))):
            reach |= (reach << int(sizes[i])) & full
            steps.append((i, int(sizes[i])))
            masks.append(reach)
    at, took = reach.bit_length() - 1, {first: 1}
    for k in range(len(steps) - 1, -1, -1):
        if not masks[k] >> at & 1:
            took[steps[k][0]] = took.get(steps[k][0], 0) + 1
            at -= steps[k][1]
    return list(took.items())


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """For each length, its sequence and its offset there.  Ties go by position."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[int] = []  # of each sequence
    large = order[lengths[order] > capacity // 4]
    parts = [p for p in np.array_split(large, min(groups, len(large)) or 1) if len(p)]
    sizes = np.array([int(lengths[p[0]]) for p in parts], np.int64)
    stock = np.array([len(p) for p in parts], np.int64)
    taken = [0] * len(parts)
    while stock.any():
        config = _fullest(sizes, stock, capacity)
        for _ in range(min(int(stock[i]) // m for i, m in config)):
            at = 0
            for i, m in config:
                for x in parts[i][taken[i] : taken[i] + m].tolist():
                    sequence[x], offset[x] = len(room), at
                    at += int(lengths[x])
                taken[i] += m
                stock[i] -= m
            room.append(capacity - at)
    # Best fit of the rest: open[r] are the sequences with r tokens of room; bit r of some says that there are any.
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for s, r in enumerate(room):
        open_[r].append(s)
        some |= 1 << r
    for x in order[lengths[order] <= capacity // 4].tolist():
        size = int(lengths[x])
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            s = open_[r].pop()
            if not open_[r]:
                some &= ~(1 << r)
        else:
            r, s = capacity, len(room)
            room.append(capacity)
        sequence[x], offset[x] = s, capacity - r
        room[s] = r - size
        open_[r - size].append(s)
        some |= 1 << (r - size)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, gapless from 0.

    Pieces need a ``length`` between 1 and ``capacity``, ``doc_id``, ``piece`` and ``ids_crc32``; an empty
    table gives an empty table, repeated rows are packed like any others.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = stored(pieces.select(*names, F.monotonically_increasing_id().alias("__row")))
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    # Rows, not ids, are dealt: equal pieces, and pieces without id, fall to all buckets alike.
    dealt = pieces.select(*names, F.pmod(F.xxhash64("__row"), F.lit(buckets)).cast("int").alias("bucket"))

    def work(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        sequence, bucket["offset"] = pack_lengths(bucket["length"].to_numpy(), capacity)
        bucket["sequence_id"] = bucket["bucket"].astype("int64") * (1 << 32) + sequence
        return bucket[[*names, "sequence_id", "offset"]]

    return dealt.groupBy("bucket").applyInPandas(work, PIECES + ", sequence_id long, offset long")


def assemble(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)``: the packed sequences themselves; ``pieces`` come from :func:`cut` with ids.

    Pieces without doc_id are told apart by the rest of their rows.
    """
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    once = pieces.select(*key, "ids").dropDuplicates(key).toDF(*(f"__{c}" for c in key), "ids")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key))
    parts = packed.join(once, same).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
