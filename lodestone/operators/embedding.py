"""Embedding behind a protocol: batches of texts to vectors, in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import document_prefix
from lodestone.functions.vectors import normalised


class Embedder(Protocol):
    """What an adapter offers; it is shipped to the executors, so it must be picklable."""

    model: str
    dim: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic and offline: signed feature hashing of lower-cased words, by the first 32 bits of their MD5."""

    def __init__(self, dim: int = 64, model: str = "hash-64"):
        self.dim, self.model = dim, model

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.concatenate([np.zeros((0, self.dim), np.float32), *(self._some(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE))])

    def _some(self, texts: Sequence[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        many = np.fromiter(map(len, words), np.int64, len(words))
        distinct = pa.array(chain.from_iterable(words), pa.large_string(), size=int(many.sum())).dictionary_encode()
        h = _md5_heads(distinct.dictionary)[distinct.indices.to_numpy()]
        cell = np.repeat(np.arange(len(words)) * self.dim, many) + (h >> 1) % self.dim
        return np.bincount(cell, np.where(h & 1, 1.0, -1.0), len(words) * self.dim).astype(np.float32).reshape(len(words), self.dim)


#: Texts whose words are held at once.
AT_ONCE = 4096
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def _md5_heads(words: pa.Array) -> np.ndarray:
    """The first 32 bits of each word's MD5: for words of one block (55 bytes) together, as arrays are much faster than calls."""
    out = np.zeros(len(words), np.int64)
    raw = words.cast(pa.large_binary())
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(size > 55):
        out[i] = int.from_bytes(hashlib.md5(raw[i].as_py(), usedforsecurity=False).digest()[:4], "big")
    short = np.flatnonzero(size <= 55)
    for i in range(0, len(short), 1 << 14):
        some = short[i : i + (1 << 14)]
        n = size[some]
        block = np.zeros((len(some), 64), np.uint8)
        letters = raw.take(pa.array(some)).buffers()[2]
        block[np.arange(64) < n[:, None]] = np.frombuffer(letters or b"", np.uint8)[: n.sum()]
        block[np.arange(len(some)), n] = 0x80
        block.view("<u4")[:, 14] = n * 8
        out[some] = _md5_first(np.ascontiguousarray(block.view("<u4").T)).byteswap()
    return out


def _md5_first(block: np.ndarray) -> np.ndarray:
    """RFC 1321 on columns of sixteen numbers: the first number of each digest."""
    start = np.uint32(0x67452301)
    a, b, c, d = (np.full(block.shape[1], x, np.uint32) for x in (start, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINES[i] + block[g]
        a, d, c, b = d, c, b, b + ((f << _TURNS[i]) | (f >> (np.uint32(32) - _TURNS[i])))
    return a + start


def embed_batch(embedder: Embedder, texts: Sequence[str]) -> np.ndarray:
    """One call for the batch; if it fails or comes back empty, one call for each text.  A wrong count is an error."""
    try:
        got = np.asarray(embedder.embed(texts), np.float32)
        if not len(got):
            raise ValueError("no vectors")
    except Exception:  # noqa: BLE001 an adapter may fail in any way; single calls name the text that does
        got = np.stack([np.asarray(embedder.embed([t]), np.float32)[0] for t in texts])
    if got.shape != (len(texts), embedder.dim):
        raise ValueError(f"{embedder.model}: {len(texts)} texts of dimension {embedder.dim} asked, {got.shape} came back")
    return got


def embedded(chunks: DataFrame, embedder: Embedder, text: str = "embed_text") -> DataFrame:
    """``chunks`` with ``vector``, ``normed``, ``model`` and ``dim``; nulls embed as the empty text."""
    rows = chunks.withColumn("__in", F.concat(document_prefix(F.lit(embedder.model)), F.coalesce(text, F.lit(""))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors = embed_batch(embedder, b.column("__in").to_pylist())
                ends = pa.array(np.arange(b.num_rows + 1) * embedder.dim, pa.int32())
                yield b.drop_columns("__in").append_column("vector", pa.ListArray.from_arrays(ends, pa.array(vectors.ravel())))

    schema = ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes) + ", vector array<float>"
    out = rows.mapInArrow(work, schema)
    return out.select("*", normalised(F.col("vector")).alias("normed"), F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"))
