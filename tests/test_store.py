"""The partitioned chunk store, archives by entries, and kernels by hashed features."""

import hashlib
import math
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import learners, ml
from lodestone.operators.chunk_store import ChunkStore
from lodestone.sources import archives, files
from lodestone.streaming.ingest import ingest


def _lines(uploads):
    return uploads.select("file", F.explode(F.split("text", "\n")).alias("piece"))


def _rows(store):
    return sorted((r.file, r.piece) for r in store.chunks().collect())


def _parts(path):
    return {p.parent.name: sorted(q.name for q in p.parent.glob("*.parquet")) for p in Path(path).rglob("*.parquet")}


def test_changes_touch_their_partitions_alone(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"), "file string, piece string", parts=8)
    assert _rows(store) == [] and store.of_files(spark.createDataFrame([("a",)], "file string")).isEmpty()
    texts = {f"f{i}": f"one {i}\ntwo {i}" for i in range(40)}
    uploads = spark.createDataFrame([*texts.items(), (None, "lost")], "file string, text string")
    store.add(uploads, _lines)
    want = sorted((f, line) for f, t in texts.items() for line in t.split("\n"))
    assert _rows(store) == want
    first = _parts(store.path)
    store.add(uploads, _lines)
    assert _rows(store) == want and _parts(store.path) == first, "a repeated batch adds nothing"
    one = spark.createDataFrame([("f7", "new")], "file string, text string")
    (bucket,) = store._buckets(one)
    for _ in range(2):
        store.replace(one, _lines)
        changed = {k for k, v in _parts(store.path).items() if first.get(k) != v}
        assert changed == {f"bucket={bucket}"}
        assert _rows(store) == sorted([w for w in want if w[0] != "f7"] + [("f7", "new")])
    store.remove(one)
    store.remove(one)
    assert _rows(store) == [w for w in want if w[0] != "f7"]
    plan = store.of_files(one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    alone = [f for f in texts if f != "f7" and store._buckets(spark.createDataFrame([(f,)], "file string")) == [bucket]]
    store.remove(spark.createDataFrame([(f,) for f in alone], "file string"))
    assert f"bucket={bucket}" not in _parts(store.path), "a partition without rows goes"
    assert len(_rows(store)) == 2 * (39 - len(alone))


def test_ingest_into_a_store(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    store = ChunkStore(spark, str(tmp_path / "store"), "file string, piece string", parts=4)
    for name in ("a.txt", "b.txt"):
        (folder / name).write_text(f"{name}\nline")
        ingest(spark, str(folder), store, str(tmp_path / "mark"), _lines).awaitTermination()
    ingest(spark, str(folder), store, str(tmp_path / "another mark"), _lines).awaitTermination()
    assert _rows(store) == [("a.txt", "a.txt"), ("a.txt", "line"), ("b.txt", "b.txt"), ("b.txt", "line")]


def test_one_archive_for_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    bodies = {f"r/p/e{i}.py": rng.integers(0, 256, 5000, dtype=np.uint8).tobytes() if i % 3 else b"same " * 1000 for i in range(60)}
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.mkdir("r/p")
        for i, (name, body) in enumerate(bodies.items()):
            z.writestr(name, body, zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
        z.writestr("r/empty", b"")
    (tmp_path / "below").mkdir()
    with zipfile.ZipFile(tmp_path / "below" / "two.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", "y")
    archives.register(spark)
    read = lambda path: spark.read.format("zip_entries").option("bytesPerTask", 20_000).load(path)
    one = read(str(tmp_path / "one.zip"))
    assert one.rdd.getNumPartitions() >= 15
    assert {r.path: bytes(r.content) for r in one.collect()} == bodies | {"r/empty": b""}
    assert {r.path for r in read(f"file://{tmp_path}").select("path").collect()} == {*bodies, "r/empty", "x"}
    (tmp_path / "none").mkdir()
    assert read(str(tmp_path / "none")).collect() == []
    assert {r.text for r in files.archive_entries(spark, str(tmp_path / "one.zip"), "p", bytes_per_task=1).filter("text LIKE 'same%'").collect()} == {"same " * 1000}


def test_unreadable_entries_are_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("a", "b" * 100, zipfile.ZIP_LZMA)
    archives.register(spark)
    with pytest.raises(Exception, match="packed in an unknown way"):
        spark.read.format("zip_entries").load(str(tmp_path / "l.zip")).collect()


def _number(*index):
    return (int(hashlib.md5(":".join(map(str, index)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def _features(points, size, gamma, seed):
    normal = lambda i, j: math.sqrt(-2 * math.log(_number(seed, i, j, "a"))) * math.cos(2 * math.pi * _number(seed, i, j, "b"))
    w = np.array([[normal(i, j) * math.sqrt(2 * gamma) for j in range(size)] for i in range(points.shape[1])])
    phase = np.array([2 * math.pi * _number(seed, j) for j in range(size)])
    return np.cos(points @ w + phase) * math.sqrt(2 / size)


def test_fourier_features_come_near_the_kernel(spark):
    points = np.random.default_rng(3).normal(size=(6, 2)).round(3)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, a double, b double")
    z = rows.select("i", F.array(*learners.fourier_features([F.col("a"), F.col("b")], 8, 0.5, 1)).alias("z")).orderBy("i").collect()
    assert np.allclose([r.z for r in z], _features(points, 8, 0.5, 1))
    wide = _features(points, 4000, 0.5, 1)
    kernel = np.exp(-0.5 * ((points[:, None] - points[None]) ** 2).sum(-1))
    assert np.abs(wide @ wide.T - kernel).max() < 0.1


def test_centres_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = spark.createDataFrame([(i, rng.normal(size=3).round(2).tolist()) for i in range(40)], "id long, v array<double>")
    centres = spark.createDataFrame([(i, rng.normal(size=3).round(2).tolist()) for i in range(25)] + [(25, points.first()["v"]), (26, points.first()["v"])], "cluster int, centre array<double>")
    want = sorted(tuple(r) for r in ml.assign_clusters(points, centres, "id", "v").select("id", "cluster", "distance").collect())
    monkeypatch.setattr(ml, "CENTRES_AT_ONCE", 4)
    assert sorted(tuple(r) for r in ml.assign_clusters(points, centres, "id", "v").select("id", "cluster", "distance").collect()) == want
