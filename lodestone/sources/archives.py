"""Entries of zip archives as a data source: many tasks share one archive, each holding one entry at a time.

The driver reads the archives' central directories, which say where every entry begins and how long it is, and deals
entries to tasks by their size.  A task opens the archive, goes to its entries and inflates them one by one.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_LOCAL_HEADER = struct.Struct("<4s5H3L2H")
_ENCRYPTED = 1


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it, of a URI or a plain local path."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


@dataclass
class Entries(InputPartition):
    """Entries of one archive: name, where its header begins, packed and full size, method."""

    archive: str
    entries: list[tuple[str, int, int, int, int]]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        out: list[InputPartition] = []
        for file in sorted(f.path for f in found if f.is_file and f.path.endswith(".zip")):
            with fs.open_input_file(file) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for e in z.infolist():
                    if e.is_dir():
                        continue
                    if e.flag_bits & _ENCRYPTED:
                        raise ValueError(f"{file}: {e.filename} is encrypted")
                    if held and size + e.file_size > self.most:
                        out.append(Entries(file, held))
                        held, size = [], 0
                    held.append((e.filename, e.header_offset, e.compress_size, e.file_size, e.compress_type))
                    size += e.file_size
                if held:
                    out.append(Entries(file, held))
        return out

    def read(self, partition: Entries | None) -> Iterator[tuple[str, str, bytes]]:
        if partition is None:  # no archive at all
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.archive) as f:
            for name, at, packed, full, method in partition.entries:
                f.seek(at)
                head = _LOCAL_HEADER.unpack(f.read(_LOCAL_HEADER.size))
                if head[0] != b"PK\x03\x04":
                    raise ValueError(f"{partition.archive}: no entry at {at}")
                f.seek(at + _LOCAL_HEADER.size + head[-2] + head[-1])
                body = f.read(packed)
                if method == zipfile.ZIP_DEFLATED:
                    body = zlib.decompress(body, -zlib.MAX_WBITS, max(full, 1))
                elif method != zipfile.ZIP_STORED:
                    raise ValueError(f"{partition.archive}: {name} is packed in an unknown way ({method})")
                yield partition.archive, name, body


class ZipEntries(DataSource):
    """``spark.read.format("zip_entries").option("bytesPerTask", n).load(path)``: ``archive, path, content`` of a zip file, or of all below a folder."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return "archive string, path string, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("bytesPerTask", 16 << 20)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipEntries)
