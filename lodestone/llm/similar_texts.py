"""Near-duplicate documents by word shingles: operator 6's candidates, and those that it cannot reach.

At a similarity of 0.8 (Jaccard, of five-word shingles) two 64-bit fingerprints differ
by about ten bits.  Distances of unrelated fingerprints to a vantage point spread by
about four bits, so at such a radius a vantage-point tree prunes nothing.  So there are
two kinds of candidates: bands of minimum hashes, and one more band of fingerprints that
the tree links.  Every link is confirmed by the exact similarity of its whole texts: a
word repeated often enough decides the fingerprint of texts that have nothing in common.
All members of a band meet: first each with the band's leader; then, in bands whose
other members are not one group by that, all of these with each other, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.components import components
from lodestone.llm.tables import bounded_batches, map_rows, named_once, stored

WORDS, SIMILARITY = 5, 0.8
#: Two texts of similarity 0.8 share one of the bands with probability 0.998, at 0.9 practically always.
BANDS, BAND_ROWS = 12, 4
#: Texts of a block, and its shingles, about; a cell compares two blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Shingles that a cell counts at once.
COLUMNS = 8192

_RNG = np.random.default_rng(8)
_MULT = _RNG.integers(1, 1 << 62, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def _bands(hashes: np.ndarray) -> list[int]:
    """Keys of the bands of a set of shingle hashes."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(hashes), 2048):
        part = hashes[lo : lo + 2048, None] * _MULT + _ADD
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64).tolist()


def _signatures(texts: DataFrame) -> DataFrame:
    """``node, fp, size, bands`` of each text: its fingerprint of five-word shingles, their number and its band keys."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps, sizes, bands = [], [], []
        for t in batch.column(1).to_pylist():
            hashes = simhash.shingle_hashes(t, WORDS)
            fps.append(simhash.fingerprint(hashes))
            sizes.append(len(hashes))
            bands.append(_bands(np.unique(hashes)) if len(hashes) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["node", "fp", "size", "bands"])

    return map_rows(texts.select("node", "text"), work, "node long, fp long, size long, bands array<long>")


def _confirmed(pairs: DataFrame) -> DataFrame:
    """``a, b`` of those ``pairs(a, b, left, right)`` whose texts are similar enough."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, last, known = [], None, None
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = np.unique(simhash.shingle_hashes(left, WORDS))
            if right != last:
                last, known = right, np.unique(simhash.shingle_hashes(right, WORDS))
            both = len(np.intersect1d(x, known, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(x) + len(known) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_rows(pairs, work, "a long, b long")


def _linked(cell: pd.DataFrame) -> pd.DataFrame:
    """``a, b``: a spanning forest of the similar texts of a cell, each pair of which is compared exactly."""
    node = cell["node"].to_numpy(np.int64)
    sets = [np.unique(simhash.shingle_hashes(t, WORDS)) for t in cell["text"]]
    size = np.array([len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), size), n[column] > 1
    kinds, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[shared][order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(kinds), COLUMNS):
        s, e = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, len(kinds) - lo)), np.float32)
        has[owner[s:e], column[s:e] - lo] = 1
        both += has @ has.T
    both = both.astype(np.int64)
    x, y = np.nonzero(both >= SIMILARITY * (size[:, None] + size - both))
    forest = simhash._Forest(len(sets))
    forest.join(x, y)
    some = np.flatnonzero(forest.root != np.arange(len(sets)))
    return pd.DataFrame({"a": node[some], "b": node[forest.root[some]]})


def _among_members(members: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``a, b``: links between members of a band that are not in one group yet; none if there are no such bands.

    ``members(band, key, node, size)`` are without the band's leader, which has met them all.  Those outside the
    largest group of their band meet all others; bands with the same members are compared once.
    """
    band = ["band", "key"]
    members = stored(members.join(joined, "node", "left").select(*band, "node", "size", F.coalesce("component", "node").alias("component")))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in range(2)]
    groups = members.groupBy(*band, "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"), *marks)
    most = lambda c: F.max_by(c, F.struct("n", "component"))
    whole = [F.bit_xor(f"x{i}").alias(f"x{i}") for i in range(2)]
    several = groups.groupBy(*band).agg(most("component").alias("major"), most("n").alias("n1"), most("size").alias("s1"), F.sum("n").alias("n"), F.sum("size").alias("s"), F.count("*").alias("groups"), *whole)
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(F.expr(n) / BLOCK), F.ceil(F.expr(s) / BLOCK_SHINGLES)).cast("int")
    several = several.filter("groups > 1").dropDuplicates(["n", "x0", "x1"])
    several = stored(several.select(*band, "major", blocks("n - n1", "s - s1").alias("minors"), blocks("n1", "s1").alias("majors")))
    if several.isEmpty():
        return None
    minor, at = F.col("component") != F.col("major"), F.xxhash64("node")
    cells = (
        members.join(several, band)
        .withColumn("block", F.when(minor, F.pmod(at, F.col("minors"))).otherwise(F.col("minors") + F.pmod(at, F.col("majors"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("minors") - 1 + F.when(minor, F.col("majors")).otherwise(0))))
        .select(*band, "node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    bounded_batches(texts.sparkSession)
    return cells.join(texts, "node").groupBy(*band, "lo", "hi").applyInPandas(_linked, "a long, b long")


def one_of_each_group(df: DataFrame) -> DataFrame:
    """The rows of ``df(doc_id, text, ...)`` with the smallest doc_id of their group of near-duplicates; all columns stay.

    Equal texts are one group, and so are blank ones (null, empty, white space); of rows that repeat a doc_id
    and its text one stays.  Rows with a null doc_id, or with one that names several texts, take no part and are kept.
    """
    text = F.coalesce("text", F.lit(""))
    rows, several = named_once(df.filter("doc_id IS NOT NULL").select("doc_id", text.alias("text")))
    texts = stored(rows.groupBy("text").agg(F.min("doc_id").alias("node")))
    signed = stored(_signatures(texts))
    nodes = stored(signed.groupBy("fp").agg(F.min("node").alias("node")))
    near = components(simhash.links(nodes)).withColumnRenamed("component", "key")
    alike = signed.join(nodes.withColumnRenamed("node", "first").join(near, F.col("first") == F.col("node"), "left").select("fp", F.coalesce("key", "first").alias("key")), "fp")
    placed = signed.select("node", "size", F.posexplode("bands").alias("band", "key")).unionByName(alike.select("node", "size", F.lit(BANDS).alias("band"), "key"))
    leaders = stored(placed.groupBy("band", "key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    members = stored(placed.join(leaders, ["band", "key"]).filter("node <> b"))
    pairs = members.select(F.col("node").alias("a"), "b").distinct()
    side = lambda end, name: texts.select(F.col("node").alias(end), F.col("text").alias(name))
    known = stored(_confirmed(stored(pairs).join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right")))
    joined = components(known)
    further = _among_members(members.drop("b"), joined, texts)
    if further is not None:
        joined = components(known.unionByName(further))
    gone = stored(joined.filter("node <> component").select(F.col("node").alias("doc_id")))
    kept = texts.select(F.col("node").alias("doc_id")).join(gone, "doc_id", "left_anti").withColumn("__kept", F.lit(True))
    alone = df.filter("doc_id IS NULL")
    if several is not None:
        alone = alone.unionByName(df.join(several, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in df.columns)))
    return df.dropDuplicates(["doc_id"]).join(kept, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in df.columns)).unionByName(alone)
