"""Operator 6: SimHash near-duplicates, found exactly with vantage-point trees.

Documents become 64-bit fingerprints of their word shingles; equal fingerprints are
one node from the start.  A tree grown from a bounded sample deals the distinct
fingerprints to shards: at each of its nodes those within the median distance of a
vantage point go inside, the others outside.  Two fingerprints ``r`` bits apart have
distances to the vantage point that differ by ``r`` at most, so only what lies near
the boundary must also be looked up on the other side, as a query.  A shard's task
goes on in the same way, in memory, down to a few hundred fingerprints that are
compared directly.  It returns a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.tables import documents, map_batches, map_rows, stored

SEED = 42
SHINGLE_WORDS, RADIUS = 3, 2
#: Distinct fingerprints of a shard, about; the tree on the driver has at most MAX_SHARDS leaves.
SHARD, MAX_SHARDS, SAMPLE_PER_SHARD = 16_384, 1 << 17, 16
#: Fingerprints that go down the tree together, and rows of shards sent on together, about.
DEALT_AT_ONCE, SENT_AT_ONCE = 1 << 16, 1 << 19
#: Fingerprints compared directly.
LEAF = 256
PAIRS_AT_ONCE = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WEIGHT_BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle of the whole text, repeats included (fewer words: of them all; none: no hash)."""
    line = b" ".join((text or "").encode().translate(_LOWER).split())
    if not line:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    if len(starts) < words:
        return np.array([digest(line, SEED)], np.uint64)
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[lo : lo + 4096]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _WEIGHT_BITS).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, words: int = SHINGLE_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp long`` of each row, over its whole text; null and empty texts have fingerprint 0."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        got = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], ["key", "fp"])

    out = map_rows(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), work, "key long, fp long")
    return out.withColumnRenamed("key", key)


def _distance(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


def _vantage(fps: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the radius that splits ``fps`` most evenly, of a few tried; none if nothing splits them."""
    best = None
    sample = fps if len(fps) <= 512 else rng.choice(fps, 512)
    for point in rng.choice(fps, min(4, len(fps)), replace=False):
        d = np.sort(_distance(sample, point))
        for mu in {int(d[(len(d) - 1) // 2]), int(d[(len(d) - 1) // 2]) - 1}:
            inside = int(np.searchsorted(d, mu, "right"))
            uneven = abs(2 * inside - len(d))
            if 0 < inside < len(d) and (best is None or uneven < best[0]):
                best = (uneven, point, mu)
    return best and (best[1], best[2])


def grow(sample: np.ndarray, leaves: int, seed: int = SEED) -> list:
    """The top of the tree: ``[point, radius, inside, outside]`` or a leaf's number."""
    rng, numbers = np.random.default_rng(seed), iter(range(1 << 30))

    def node(fps: np.ndarray, leaves: int):
        found = _vantage(fps, rng) if leaves > 1 and len(fps) > 1 else None
        if found is None:
            return next(numbers)
        point, mu = found
        near = _distance(fps, point) <= mu
        return [point, mu, node(fps[near], leaves // 2), node(fps[~near], leaves - leaves // 2)]

    return [node(sample, leaves)]


def _split(fps: np.ndarray, own: np.ndarray, ask: np.ndarray, point: np.uint64, mu: int, radius: int):
    """Members (``own``) and queries (``ask``, indices into ``fps``) of the inside, then of the outside.

    A pair across the boundary is found once: from its inner member, asked on the outside.
    """
    d, q = _distance(fps[own], point), _distance(fps[ask], point)
    near = d <= mu
    return own[near], ask[q <= mu + radius], own[~near], np.concatenate([ask[q > mu - radius], own[near & (d > mu - radius)]])


def _deal(tree, fps: np.ndarray, own: np.ndarray, ask: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if not isinstance(tree, list):
        yield tree, own, ask
        return
    point, mu, inside, outside = tree
    a, b, c, d = _split(fps, own, ask, point, mu, radius)
    if len(a) or len(b):
        yield from _deal(inside, fps, a, b, radius)
    if len(c) or len(d):
        yield from _deal(outside, fps, c, d, radius)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two columns of ``batches``, so many rows at a time, about."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield tuple(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))


class _Forest:
    """Spanning forest of the pairs given to it, by smallest index."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.root
        while len(x):
            x, y = root[x], root[y]
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root[:] = root[root]


def _search(fps: np.ndarray, own: np.ndarray, ask: np.ndarray, radius: int, forest: _Forest, rng: np.random.Generator) -> None:
    """Link every member to every member and query within the radius."""
    if not len(own):
        return
    found = _vantage(fps[own], rng) if len(own) > LEAF else None
    if found is not None:
        a, b, c, d = _split(fps, own, ask, *found, radius)
        if len(a) and len(c):
            _search(fps, a, b, radius, forest, rng)
            _search(fps, c, d, radius, forest, rng)
            return
    everyone = np.concatenate([own, ask])
    step = max(1, PAIRS_AT_ONCE // len(own))
    for lo in range(0, len(everyone), step):
        x, y = np.nonzero(np.bitwise_count(fps[everyone[lo : lo + step], None] ^ fps[own]) <= radius)
        forest.join(everyone[lo + x], own[y])


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: edges that join exactly the nodes reachable from each other by fingerprints ``radius`` bits apart or less.

    ``nodes`` has distinct ``fp`` and a ``node`` for each.
    """
    n = nodes.count()
    leaves = min(MAX_SHARDS, max(1, -(-n // SHARD)))
    want = leaves * SAMPLE_PER_SHARD
    drawn = np.zeros(0, np.int64)
    if leaves > 1:
        drawn = nodes.select("fp").sample(min(1.0, 1.5 * want / n), SEED).limit(want).toArrow()["fp"].to_numpy()
    shared = nodes.sparkSession.sparkContext.broadcast(grow(drawn.view(np.uint64), leaves))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tree,) = shared.value
        for fp, node in _gathered(batches, DEALT_AT_ONCE):
            held: list[tuple[np.ndarray, ...]] = []
            n = 0
            for leaf, own, ask in _deal(tree, fp.view(np.uint64), np.arange(len(fp)), np.zeros(0, np.int64), radius):
                pick = np.concatenate([own, ask])
                held.append((np.full(len(pick), leaf, np.int32), pick, np.arange(len(pick)) < len(own)))
                n += len(pick)
                if n >= SENT_AT_ONCE:
                    yield sent(held, fp, node)
                    held, n = [], 0
            if held:
                yield sent(held, fp, node)

    def sent(held: list[tuple[np.ndarray, ...]], fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        leaf, pick, member = (np.concatenate(part) for part in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[pick]), pa.array(node[pick]), pa.array(member)], ["leaf", "fp", "node", "member"])

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        fps, node, member = shard["fp"].to_numpy(np.int64).view(np.uint64), shard["node"].to_numpy(np.int64), shard["member"].to_numpy(bool)
        forest = _Forest(len(fps))
        _search(fps, np.flatnonzero(member), np.flatnonzero(~member), radius, forest, np.random.default_rng(SEED))
        some = np.flatnonzero(forest.root != np.arange(len(fps)))
        return pd.DataFrame({"a": node[some], "b": node[forest.root[some]]})

    dealt = map_batches(nodes.select("fp", "node"), deal, "leaf int, fp long, node long, member boolean")
    return dealt.groupBy("leaf").applyInPandas(search, "a long, b long")


def near_duplicates(df: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id``: the smallest key reachable over fingerprints ``radius`` bits apart or less.

    Whole texts count; null, empty and blank texts have fingerprint 0 and are linked like any other.
    Repeated rows stay, keys may repeat, rows with a null key are left out, other columns are not read.
    """
    fps = stored(fingerprints(df.filter(F.col(key).isNotNull()), words, key, text))
    nodes = stored(fps.groupBy("fp").agg(F.min(key).alias("node")))
    joined = components(links(nodes, radius))
    of = stored(nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return fps.join(of, "fp").select(key, "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
