"""Files to texts: plain text, DOCX, PDF and archives, read by Spark's binaryFile source."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import reachable_by_workers
from lodestone.functions.text import flat_name
from lodestone.sources import archives

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p"))


def _pdf(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError as e:
        raise RuntimeError("reading PDF files needs the package pypdf on the executors") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


@F.pandas_udf(T.StringType())
def _decoded(ext: pd.Series, content: pd.Series) -> pd.Series:
    read = {"docx": _docx, "pdf": _pdf}
    return pd.Series([read.get(e, lambda c: c.decode("utf-8", "ignore"))(c) for e, c in zip(ext, content, strict=True)])


def text_of(ext: Column, content: Column) -> Column:
    """Text by extension; valid UTF-8 of plain files never leaves the JVM, invalid bytes are dropped."""
    plain = ~ext.isin("docx", "pdf") & F.is_valid_utf8(content.cast("string"))
    return F.when(plain, content.cast("string")).otherwise(_decoded(ext, F.when(~plain, content).otherwise(F.lit(b""))))


def with_text(files: DataFrame) -> DataFrame:
    """``file, ext, text`` of a binaryFile frame, batch or streaming."""
    file = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.substring_index(file, ".", -1))
    return files.select(file.alias("file"), ext.alias("ext"), "content").select("file", "ext", text_of(F.col("ext"), F.col("content")).alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return with_text(spark.read.format("binaryFile").load(path))


def wanted(path: Column, package: str, with_tests: bool = False) -> Column:
    """Entries of an archive to keep: the root guide, sources and guides of the package, optionally sources of tests."""
    top = F.substring_index(path, "/", 1)
    keep = (path == "README.md") | ((top == package) & (path.endswith(".py") | path.endswith(".md")))
    return keep | ((top == "tests") & path.endswith(".py")) if with_tests else keep


def archive_entries(spark: SparkSession, path: str, package: str, with_tests: bool = False, bytes_per_task: int = 16 << 20) -> DataFrame:
    """``file, text`` of the kept entries of zip files: root folder stripped, names flattened, blank files left out.

    Entries are dealt to tasks by size, also those of a single archive (:mod:`archives`).
    """
    reachable_by_workers(spark)
    archives.register(spark)
    entries = spark.read.format("zip_entries").option("bytesPerTask", bytes_per_task).load(path).filter(F.contains("path", F.lit("/")))
    named = entries.select(F.expr("substr(path, instr(path, '/') + 1)").alias("path"), "content")
    kept = named.filter(wanted(F.col("path"), package, with_tests)).select("path", text_of(F.lit("txt"), F.col("content")).alias("text")).filter(F.col("text").rlike(r"\S"))
    return kept.select(flat_name("path").alias("file"), "text")
