"""A chunk store as a partitioned table: a file's chunks lie in one partition, told by a hash of its name.

What asks for files reads the partitions of their names alone, and what changes files rewrites those alone (dynamic
partition overwrite); all other partitions are neither read nor written.  Every change can be repeated: files that are
stored are skipped, replaced files are replaced again, removed ones stay removed.

A change deals rows by partition once, with the names that it is about among them, and writes them once: Spark stages an
overwrite of partitions, and moves it in place when it is whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ToChunks = Callable[[DataFrame], DataFrame]


class ChunkStore:
    """Chunks with the columns of ``schema`` (``file`` among them) under ``path``, in ``parts`` partitions at most."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, parts: int = 256):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = own.names
        self.schema = T.StructType([*own.fields, T.StructField("bucket", T.IntegerType())])

    def _bucket(self, file: Column) -> Column:
        return F.pmod(F.xxhash64(file), F.lit(self.parts)).cast("int")

    def _folder(self, *below: str):
        """The Hadoop path of the store or of a partition, and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored(self) -> DataFrame:
        """All rows, with their bucket."""
        path, fs = self._folder()
        if not fs.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def chunks(self) -> DataFrame:
        return self._stored().select(*(f"`{c}`" for c in self.columns))

    def of_files(self, names: DataFrame) -> DataFrame:
        """Stored chunks of ``names(file)``, with their bucket: only these files' partitions are read."""
        return self._pruned(self._buckets(names)).join(names.select("file").distinct(), "file", "left_semi")

    def _buckets(self, names: DataFrame) -> list[int]:
        """Partitions of some files: ``parts`` numbers at most."""
        return sorted(r.b for r in names.filter("file IS NOT NULL").select(self._bucket(F.col("file")).alias("b")).distinct().collect())

    def _pruned(self, buckets: list[int]) -> DataFrame:
        return self._stored().filter(F.col("bucket").isin(buckets))

    def _place(self, chunks: DataFrame) -> DataFrame:
        return chunks.select(*(f"`{c}`" for c in self.columns), self._bucket(F.col("file")).alias("bucket"))

    def add(self, uploads: DataFrame, to_chunks: ToChunks) -> None:
        """Store the chunks of ``uploads(file, ...)`` whose file is not stored; the others are not even cut.

        Names are compared first; only partitions that have new files are looked at again, with all columns, and if they
        have stored ones too.
        """
        known = uploads.filter("file IS NOT NULL")
        names = known.select("file").distinct()
        held = self._pruned(self._buckets(names)).select("file").distinct()
        state = names.join(held.withColumn("__held", F.lit(True)), "file", "left").groupBy(self._bucket(F.col("file")).alias("b")).agg(F.count("__held").alias("held"), F.count("*").alias("n")).collect()
        new = {r["b"] for r in state if r["held"] < r["n"]}
        if not new:
            return
        fresh = known.filter(self._bucket(F.col("file")).isin(sorted(new)))
        mixed = sorted(r["b"] for r in state if r["b"] in new and r["held"])
        if mixed:
            fresh = fresh.join(self._pruned(mixed).select("file").distinct(), "file", "left_anti")
        self._place(to_chunks(fresh)).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def replace(self, uploads: DataFrame, to_chunks: ToChunks) -> None:
        """Store the chunks of ``uploads(file, ...)`` in place of what their files had."""
        self._rewrite(uploads.filter("file IS NOT NULL").select("file").distinct(), self._place(to_chunks(uploads.filter("file IS NOT NULL"))))

    def remove(self, names: DataFrame) -> None:
        """Take out the chunks of ``names(file)``."""
        self._rewrite(names.filter("file IS NOT NULL").select("file").distinct(), None)

    def _rewrite(self, names: DataFrame, more: DataFrame | None) -> None:
        buckets = self._buckets(names)
        before = {b: self._files(b) for b in buckets}
        rows = self._pruned(buckets).withColumn("__gone", F.lit(False))
        gone = names.select("file", self._bucket(F.col("file")).alias("bucket"), F.lit(True).alias("__gone"))
        rows = rows.unionByName(gone, allowMissingColumns=True)
        if more is not None:
            rows = rows.unionByName(more, allowMissingColumns=True)  # neither: not stored yet
        # By partition, so that what is written needs no other shuffle: names meet their rows in a window there.
        marked = rows.repartition("bucket").withColumn("__any", F.max("__gone").over(W.partitionBy("bucket", "file")))
        left = marked.filter("__gone IS NULL OR NOT __any").drop("__gone", "__any")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        for b in buckets:  # a partition without rows is not overwritten: it goes
            path, fs = self._folder(f"bucket={b}")
            if before[b] and self._files(b) == before[b]:
                fs.delete(path, True)

    def _files(self, bucket: int) -> set[str]:
        path, fs = self._folder(f"bucket={bucket}")
        return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
