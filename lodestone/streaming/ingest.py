"""Incremental ingest: new files of a folder become chunks of a stored table, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.chunk_store import ChunkStore
from lodestone.sources.files import with_text


def ingest(spark: SparkSession, folder: str, store: ChunkStore | str, checkpoint: str, to_chunks: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process what is there and stop; run again for what came since.

    ``to_chunks`` maps ``file, ext, text`` to the rows of the store (a path makes one that takes whatever these are).  Files already in the store are skipped, and only the
    partitions of a batch's files are looked at, so a repeated batch adds nothing.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    if isinstance(store, str):
        none = spark.createDataFrame([], "file string, ext string, text string")
        store = ChunkStore(spark, store, to_chunks(none).schema)
    put = lambda batch, _: store.add(with_text(batch), to_chunks)
    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
