"""Uploads into a lasting store, deletion there, and archives."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking
from lodestone.operators.chunk_store import ChunkStore
from lodestone.plans.lineage import shared_folder
from lodestone.plans.registry import Registry, table
from lodestone.sources import archives
from lodestone.sources.files import archive_entries

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


def _to_chunks(uploads: DataFrame) -> DataFrame:
    return chunking.chunked(uploads, "file").select("file", "start", "piece")


@query(r"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
kept AS (SELECT 'd' || d.doc_id || '.txt' AS file, CASE WHEN quality = 1 THEN text || ' (read again)' ELSE text END AS text
         FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id WHERE text IS NOT NULL AND coalesce(toxic, 0) <> 1),
stripped AS (SELECT file, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM kept),
windows AS (SELECT file, unnest(range(0, length(t), 650)) AS start, t FROM stripped WHERE length(t) > 0)
SELECT file, CAST(start AS INTEGER) AS start, regexp_replace(substr(t, start + 1, 800), '^\s+|\s+$', '', 'g') AS piece
FROM windows WHERE regexp_replace(substr(t, start + 1, 800), '^\s+|\s+$', '', 'g') <> ''
""")
def store_lasting(spark: SparkSession, d: str) -> DataFrame:
    """All documents uploaded twice (the second time adds nothing), those of quality replaced by new texts, toxic ones removed."""
    store = ChunkStore(spark, f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}", "file string, start int, piece string", parts=16)
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("file"), "text")
    marked = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    store.add(docs, _to_chunks)
    store.add(docs, _to_chunks)
    good = docs.join(marked.filter("quality = 1"), "doc_id", "left_semi")
    store.replace(good.withColumn("text", F.concat("text", F.lit(" (read again)"))), _to_chunks)
    store.remove(docs.join(marked.filter("toxic = 1"), "doc_id", "left_semi"))
    return store.chunks()


@query(r"""
SELECT CASE doc_id % 3 WHEN 0 THEN 'lib.d' || doc_id || '.py' ELSE 'lib.sub.d' || doc_id || '.md' END AS file, text
FROM documents WHERE doc_id % 3 < 2 AND regexp_matches(text, '\S')
""")
def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed into zip archives by tasks, and read back entry by entry; a third of the entries is not wanted."""
    folder = f"{shared_folder(spark).rstrip('/')}/zips-{uuid.uuid4().hex}"
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("main/lib/d"), "doc_id", F.lit("/__init__.py"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("main/lib/sub/d"), "doc_id", F.lit(".md"))).otherwise(F.concat(F.lit("main/other/d"), "doc_id", F.lit(".py")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = archives.opened(f"{folder}/{uuid.uuid4().hex}.zip")
        fs.create_dir(path.rsplit("/", 1)[0])
        with fs.open_output_stream(path) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            n = 0
            for b in batches:
                for entry, text in zip(b["name"], b["text"], strict=True):
                    z.writestr(entry, text)
                    n += 1
        yield pd.DataFrame({"n": [n]})

    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(name.alias("name"), "text")
    docs.repartition(8).mapInPandas(pack, "n long").agg(F.sum("n")).collect()
    return archive_entries(spark, folder, "lib", bytes_per_task=1 << 20)
