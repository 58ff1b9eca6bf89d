"""Operator 8: embedding near-dedup by random-hyperplane signs, exact cosines and connected components.

Equal vectors are one class from the start.  In each of several tables a class falls
into the bucket named by the signs of its dot products with random hyperplanes; the
members of a bucket are compared exactly, in blocks, so no bucket is too large.  A
pair counts in the first table that brings it together.  Cells give each class its
number of links and one edge to its cell's smallest linked class, never all pairs.

Crowded buckets mostly hold one tight group.  Members within half the threshold's
angle of their bucket's mean are all linked to each other, by the triangle inequality:
such a group is counted as a whole and not compared.  So are two groups whose centres
and radii say that all their pairs are linked, or none.

Only class ids and keys are dealt to buckets; vectors come to the blocks that are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import dot, norm
from lodestone.llm.components import components
from lodestone.llm.exact_search import usable
from lodestone.llm.tables import map_rows, stored, table

THRESHOLD = 0.9
#: Chance that some table brings together two vectors whose cosine is exactly the threshold.
RECALL = 0.95
#: Classes of a bucket, about, if vectors are spread evenly.
BUCKET = 16
#: Larger buckets are compared block by block.
BLOCK = 1024
#: Rows of a call, about; a cell has twice BLOCK at most.
ROWS_AT_ONCE = 8192
#: Tables in whose crowded buckets tight groups are looked for.
GROUP_TABLES = 4


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table's key and number of tables for ``n`` vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _keyed(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """``cid, size, dim, vec (binary), keys (binary, 32-bit)``: the sign keys of each class in every table."""
    kind = "<f4" if dict(classes.dtypes)["embedding"] == "array<float>" else "<f8"

    def work(batch: pa.RecordBatch):
        dims, raw, keys = [], [], []
        for v in batch.column(2).to_pylist():
            x = np.array(v, np.float64)
            planes = known.get(len(x))
            if planes is None:
                planes = known[len(x)] = np.random.default_rng((seed, len(x))).standard_normal((bits * tables, len(x)))
            signs = (planes @ (x / np.abs(x).max()) >= 0).reshape(tables, bits)
            keys.append((signs @ (1 << np.arange(bits))).astype("<i4").tobytes())
            raw.append(x.astype(kind).tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(keys, pa.binary())], ["cid", "size", "dim", "vec", "keys"])

    known: dict[int, np.ndarray] = {}
    return map_rows(classes.select("cid", "size", "embedding"), work, "cid long, size long, dim int, vec binary, keys binary")


def _units(vectors: list[bytes], kind: str, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links_of_cell(units: np.ndarray, keys: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are linked and that no earlier table brings together; between the two sides, or within one."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        x, y = np.nonzero(units @ units.T >= threshold)
        x, y = x[x < y], y[x < y]
    else:
        x, y = np.nonzero(units[left] @ units[right].T >= threshold)
        x, y = left[x], right[y]
    if len(x) and keys.shape[1]:
        fresh = np.ones(len(x), bool)
        for earlier in range(keys.shape[1]):
            fresh &= keys[x, earlier] != keys[y, earlier]
        x, y = x[fresh], y[fresh]
    return x, y


def _compare(rows: pd.DataFrame, threshold: float, kind: str) -> pd.DataFrame:
    """``cid, links, root`` of many cells: each linked class's links in a cell, and the cell's smallest class joined to it."""
    rows = rows.sort_values([*CELL, "side", "cid"], ignore_index=True)
    ids, size, side, t, dim = (rows[c].to_numpy(np.int64) for c in ("cid", "size", "side", "t", "dim"))
    new = np.zeros(len(rows), bool)
    for c in CELL:
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    vec, key = rows["vec"].tolist(), rows["keys"].tolist()
    edges = [0, *np.flatnonzero(new).tolist(), len(rows)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e - s < 2:
            continue
        keys = np.frombuffer(b"".join(key[s:e]), "<i4").reshape(e - s, -1)
        x, y = _links_of_cell(_units(vec[s:e], kind, int(dim[s])), keys[:, : t[s]], side[s:e], threshold)
        if not len(x):
            continue
        links = np.bincount(x, size[s:e][y], e - s) + np.bincount(y, size[s:e][x], e - s)
        root = np.arange(e - s)
        while True:  # a row of smallest class linked within the cell
            low = np.minimum(root[x], root[y])
            new_root = root.copy()
            np.minimum.at(new_root, x, low)
            np.minimum.at(new_root, y, low)
            new_root = new_root[new_root]
            if (new_root == root).all():
                break
            root = new_root
        some = np.flatnonzero(links)
        found.append((ids[s:e][some], links[some].astype(np.int64), ids[s:e][root[some]]))
    if not found:
        return pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
    cid, links, root = map(np.concatenate, zip(*found, strict=True))
    return pd.DataFrame({"cid": cid, "links": links, "root": root})


#: What names a bucket, and a cell: two blocks of two parts of a bucket (the same, or not).
BUCKET_KEY = ["t", "dim", "bucket"]
CELL = [*BUCKET_KEY, "part", "block", "other", "other_block"]


def _slots(keyed: DataFrame, tables: int) -> DataFrame:
    """``cid, t, dim, bucket``: where each class falls."""
    slot = F.expr(f"transform(sequence(0, {tables - 1}), t -> struct(t AS t, substr(keys, 4 * t + 1, 4) AS bucket))")
    return keyed.select("cid", "dim", F.inline(slot))


def _tight_groups(classes: DataFrame, slots: DataFrame, crowded: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``cid, part`` of the members of tight groups, and ``part, centre, radius, root, total`` of the groups.

    A group's members lie in one crowded bucket, within half the threshold's angle of its mean direction.
    """
    half, unit = math.acos(threshold) / 2, lambda v: F.transform(v, lambda x: x / norm(v))
    members = None
    for t in range(GROUP_TABLES):
        here = slots.filter(F.col("t") == t).join(crowded.filter(F.col("t") == t), BUCKET_KEY)
        if members is not None:
            here = here.join(members.select("cid"), "cid", "left_anti")
        here = here.join(classes.select("cid", "size", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "cid")
        here = stored(here.select("cid", "size", F.xxhash64(*BUCKET_KEY).alias("part"), unit(F.col("v")).alias("v")))
        if here.isEmpty():
            continue
        mean = here.select("part", F.posexplode("v").alias("i", "x")).groupBy("part", "i").agg(F.sum("x").alias("x"))
        centres = mean.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m")).filter(norm(F.col("m")) > 0)
        near = here.join(centres.select("part", unit(F.col("m")).alias("centre")), "part")
        angle = F.acos(F.least(F.greatest(dot(F.col("v"), F.col("centre")), F.lit(-1.0)), F.lit(1.0)))
        near = stored(near.withColumn("angle", angle).filter(F.col("angle") < half - 1e-7).select("cid", "size", "part", "centre", "angle"))
        members = near if members is None else members.unionByName(near)
    if members is None:
        return None, None
    groups = members.groupBy("part").agg(F.first("centre").alias("centre"), F.max("angle").alias("radius"), F.min("cid").alias("root"), F.sum("size").alias("total"))
    return members.select("cid", "part", "size"), stored(groups)


def _group_pairs(groups: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """``part, other, linked`` of pairs of groups that share a bucket and whose pairs are all linked, or none of them."""
    theta = math.acos(threshold)
    here = parts.filter("part <> 0").select(*BUCKET_KEY, "part")
    pairs = here.join(here.withColumnRenamed("part", "other"), BUCKET_KEY).filter("part < other").select("part", "other").distinct()
    of = lambda p, n: groups.select(F.col("part").alias(p), F.col("centre").alias(f"c{n}"), F.col("radius").alias(f"r{n}"))
    far = F.acos(F.least(F.greatest(dot(F.col("c1"), F.col("c2")), F.lit(-1.0)), F.lit(1.0)))
    both = pairs.join(of("part", 1), "part").join(of("other", 2), "other").withColumn("far", far).withColumn("reach", F.col("r1") + F.col("r2"))
    linked = F.when(F.col("far") + F.col("reach") < theta - 1e-7, True).when(F.col("far") - F.col("reach") > theta + 1e-7, False)
    return stored(both.select("part", "other", linked.alias("linked")).filter("linked IS NOT NULL"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 42) -> DataFrame:
    """``key, n_links, component_id, kept``, one row per row of ``vectors``.

    Pairs are linked if their cosine is at least ``threshold`` and a table brings them together
    (with probability ``recall`` at the threshold, more above it; equal vectors always).  Vectors
    that are null, empty, zero or hold null or non-finite components, and vectors of different
    dimensions, are not linked.  Rows that repeat a key count as vectors of their own; rows with a null
    key are left out.  Other columns are not read.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    can = F.coalesce(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.filter(can).withColumn("h", F.xxhash64("embedding"))
    classes = stored(valid.groupBy("h", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size")))
    bits, tables = plan_tables(classes.count(), threshold, recall)
    keyed = stored(_keyed(classes, bits, tables, seed))
    kind = "<f4" if dict(classes.dtypes)["embedding"] == "array<float>" else "<f8"
    slots = _slots(keyed, tables)
    large = stored(slots.groupBy(*BUCKET_KEY).agg(F.count("*").alias("n")).filter("n > 1"))
    crowded = large.filter(F.col("n") > BLOCK).select(*BUCKET_KEY)
    members, groups = (None, None) if crowded.isEmpty() else _tight_groups(classes, slots, crowded, threshold)
    slots = slots.join(large.select(*BUCKET_KEY), BUCKET_KEY)
    slots = slots.withColumn("part", F.lit(0).cast("long")) if members is None else slots.join(members.select("cid", "part"), "cid", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    slots = stored(slots)
    parts = slots.groupBy(*BUCKET_KEY, "part").agg(F.count("*").alias("n"))
    parts = stored(parts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    others = parts.select(*BUCKET_KEY, F.col("part").alias("other"), F.col("n").alias("m"), F.col("blocks").alias("other_blocks"))
    meets = parts.join(others, BUCKET_KEY).filter("part < other OR part = other AND part = 0 AND n > 1")
    whole = None
    if groups is not None:
        whole = _group_pairs(groups, parts, threshold)
        meets = meets.join(whole.select("part", "other"), ["part", "other"], "left_anti")
    meets = stored(meets)
    n_rows = meets.agg(F.coalesce(F.sum(F.col("n") * F.col("other_blocks") + F.col("m") * F.col("blocks")), F.lit(0))).first()[0]
    # Small cells share a task's call: about so many rows each, never a part of a cell.
    calls = max(1, -(-n_rows // ROWS_AT_ONCE))
    cells = meets.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    cells = cells.filter("part < other OR block <= other_block").select(*CELL).withColumn("call", F.pmod(F.xxhash64(*CELL), F.lit(calls)))
    sides = cells.withColumn("side", F.explode(F.when((F.col("part") == F.col("other")) & (F.col("block") == F.col("other_block")), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    of = lambda first, second: F.when(F.col("side") == 0, F.col(first)).otherwise(F.col(second))
    sides = sides.withColumn("own", of("part", "other")).withColumn("own_block", of("block", "other_block"))
    dealt = slots.join(parts.select(*BUCKET_KEY, "part", "blocks"), [*BUCKET_KEY, "part"])
    dealt = dealt.select("cid", *BUCKET_KEY, F.col("part").alias("own"), F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("own_block"))
    dealt = dealt.join(sides, [*BUCKET_KEY, "own", "own_block"]).select("cid", *CELL, "side", "call")
    dealt = dealt.join(keyed.select("cid", "size", "vec", "keys"), "cid").withColumn("keys", F.expr("substr(keys, 1, 4 * t)"))
    found = stored(dealt.groupBy("call").applyInPandas(lambda rows: _compare(rows, threshold, kind), "cid long, links long, root long"))
    if groups is not None:
        own = members.join(groups.select("part", "root", "total"), "part")
        found = found.unionByName(own.select("cid", (F.col("total") - F.col("size")).alias("links"), "root"))
        linked = whole.filter("linked").select("part", "other")
        linked = linked.unionByName(linked.select(F.col("other").alias("part"), F.col("part").alias("other")))
        beside = linked.join(groups.select(F.col("part").alias("other"), "root", "total"), "other").groupBy("part").agg(F.sum("total").alias("links"), F.min("root").alias("root"))
        found = stored(found.unionByName(members.join(beside, "part").select("cid", "links", "root")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    per_class = stored(
        classes.select("h", "embedding", "cid", "size")
        .join(links, "cid", "left")
        .join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .select("h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    )
    known = valid.join(per_class, ["h", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~can).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.withColumnRenamed("vec_id", key)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
