"""What the operators share: reading tables, cutting lineage, batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import reachable_by_workers
from lodestone.plans.lineage import written as stored

__all__ = ["bounded_batches", "documents", "held", "map_batches", "map_rows", "named_once", "stored", "table"]

#: An Arrow batch sent to a Python worker holds at most so many bytes or rows, however long the texts are.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named_once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs(doc_id, text)`` without the ids that name several different texts, and those ids; none if there are none."""
    each = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    several = stored(each.filter("a <> b").select("doc_id"))
    if several.isEmpty():
        return docs, None
    return docs.join(several, "doc_id", "left_anti"), several


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and rows; smaller bounds that the session has stay."""
    reachable_by_workers(spark)
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


#: What this worker holds for one operator or another (encoders, caches of words), and which of it its task has asked for.
_HELD: dict[str, tuple[object, object]] = {}
_ASKED: set[str] = set()


def held(name: str, key: object, make: Callable[[], object]) -> object:
    """A worker's own thing, made once for each ``key`` and kept from task to task while tasks ask for it."""
    _ASKED.add(name)
    if name not in _HELD or _HELD[name][0] != key:
        _HELD.pop(name, None)
        _HELD[name] = key, make()
    return _HELD[name][1]


def _begin() -> None:
    _ASKED.clear()


def _let_go() -> None:
    """Forget what the running task has not asked for: workers outlive operators, and must not add up what those held."""
    for name in set(_HELD) - _ASKED:
        del _HELD[name]


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function of a partition's batches, which are bounded; any column names will do."""
    bounded_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for n, out in enumerate(work(batch.rename_columns(names) for batch in batches)):
            if not n:
                _let_go()
            yield out

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, schema)


def map_rows(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow of a function from one batch to batches, with bounded input batches; any column names will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return map_batches(df, run, schema)
