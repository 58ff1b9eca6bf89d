"""Operator 11: fill-in-middle transformation by overlapping chunks.

A token begins at a character that is no letter, or at a letter whose left neighbour is none: a predicate of two
adjacent characters.  So a text is cut into chunks that overlap by one byte, token and character starts are counted
in every chunk on its own, and prefix sums over the chunks' counts say which chunk holds a cut of given rank.  Only
these two chunks of a text are read again, to find the cut itself.

Work stays where the texts lie: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import documents, map_rows

#: Bytes of a chunk, and of the chunks looked at in one call.
CHUNK, SLAB = 1 << 16, 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are rearranged, and of these so many have their suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20

_INSIDE, _LETTER, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x80:0xC0] = _INSIDE  # bytes that continue a character
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER


class _Chunks:
    """Chunks of a batch's texts, which lie one after the other in ``data``; ``edges`` are the texts' ends from 0."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, chunk: int):
        self.data, self.edges = data, edges
        per_text = -(-np.diff(edges) // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # of each text, and the number of all chunks
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.lo = np.repeat(edges[:-1], per_text) + within * chunk
        self.hi = np.minimum(self.lo + chunk, np.repeat(edges[1:], per_text))
        tokens, chars = np.zeros(len(self.lo), np.int64), np.zeros(len(self.lo), np.int64)
        slab = self.lo // SLAB
        bounds = np.flatnonzero(np.diff(slab, prepend=-1, append=-1)) if len(slab) else np.zeros(1, int)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            begins, starts = self._predicate(int(self.lo[a]), int(self.hi[b - 1]))
            at = self.lo[a:b] - self.lo[a]
            chars[a:b], tokens[a:b] = np.add.reduceat(begins, at, dtype=np.int64), np.add.reduceat(starts, at, dtype=np.int64)
        self.tokens, self.chars = np.concatenate([[0], np.cumsum(tokens)]), np.concatenate([[0], np.cumsum(chars)])

    def _predicate(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Where characters and tokens begin in ``data[lo:hi]``, from these bytes and the one before."""
        kind = _KIND[self.data[lo:hi]]
        letter = kind == _LETTER
        after = np.empty_like(letter)
        after[1:] = letter[:-1]
        after[:1] = lo > 0 and _KIND[self.data[lo - 1]] == _LETTER
        a, b = np.searchsorted(self.edges, [lo, hi])
        after[self.edges[a:b] - lo] = False
        return kind != _INSIDE, (kind == _OTHER) | (letter & ~after)

    def count(self) -> np.ndarray:
        """Tokens of each text."""
        return self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, text: int, rank: int) -> tuple[int, int]:
        """Byte where the token of this rank begins (the text's end, if it has no more), and the characters before it."""
        base, last = self.first[text], self.first[text + 1]
        want = self.tokens[base] + rank
        if want == self.tokens[last]:
            return int(self.edges[text + 1]), int(self.chars[last] - self.chars[base])
        owner = int(np.searchsorted(self.tokens, want, "right")) - 1
        begins, starts = self._predicate(int(self.lo[owner]), int(self.hi[owner]))
        at = int(np.flatnonzero(starts)[want - self.tokens[owner]])
        return int(self.lo[owner]) + at, int(self.chars[owner] - self.chars[base] + np.count_nonzero(begins[:at]))


def transform(df: DataFrame, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every whole ``text``.

    Tokens are runs of ASCII letters and single other characters.  The sha256 of ``1:<doc_id>`` gives four numbers: two
    cut ranks, whether the text is rearranged (``psm`` or ``spm``) or stays ``plain``, and which of both.  Empty and null
    texts (null counts as empty), texts that hold a sentinel, and rows without doc_id stay plain.  Repeated rows and ids
    stay as they are; other columns are not read; an empty table gives an empty table.
    """
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = pc.fill_null(batch.column(1), "")
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        raw = raw[int(edges[0]) : int(edges[-1])] if raw is not None else pa.py_buffer(b"")
        chunks = _Chunks(np.frombuffer(raw, np.uint8), edges - edges[0], chunk)
        count, form, before, between, output = chunks.count(), [], [], [], []
        for i, key in enumerate(batch.column(0).to_pylist()):
            lo, hi, n = int(chunks.edges[i]), int(chunks.edges[i + 1]), int(count[i])
            text = raw[lo:hi].to_pybytes()
            drawn = hashlib.sha256(b"1:%d" % key).digest() if key is not None else b""
            h1, h2, h3, h4 = (int.from_bytes(drawn[4 * k : 4 * k + 4]) for k in range(4))
            if not text or not drawn or h3 % 100 >= rearranged or p in text or s in text or m in text:
                form.append("plain")
                before.append(None)
                between.append(None)
                output.append(text)
                continue
            (a, chars_a), (b, chars_b) = (chunks.cut(i, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
            head, body, tail = text[: a - lo], text[a - lo : b - lo], text[b - lo :]
            spm = h4 % 100 < suffix_first
            form.append("spm" if spm else "psm")
            before.append(chars_a)
            between.append(chars_b - chars_a)
            output.append(b"".join((s, tail, p, head, m, body) if spm else (p, head, s, tail, m, body)))
        cols = [batch.column(0), pa.array(count, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_rows(df.select(F.col("doc_id").cast("long"), "text"), work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text itself, from an output and its form; sentinels stand there once each, as texts that hold one stay plain."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    inner = F.substr(head, F.lit(1 + len(PREFIX)))
    psm = F.concat(F.substring_index(inner, SUFFIX, 1), middle, F.substring_index(inner, SUFFIX, -1))
    spm = F.concat(F.substring_index(inner, PREFIX, -1), middle, F.substring_index(inner, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(documents(spark, sf_dir))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]', 0) AS w, sha256('1:' || doc_id) AS h
  FROM documents
),
drawn AS (
  SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS r1, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS r2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS r3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS r4
  FROM t
),
formed AS (
  SELECT doc_id, text, n, array_to_string(w[:least(r1, r2)], '') AS a, array_to_string(w[least(r1, r2) + 1:greatest(r1, r2)], '') AS b,
         array_to_string(w[greatest(r1, r2) + 1:], '') AS c,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 OR doc_id IS NULL THEN 'plain'
              WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
put AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output
  FROM formed
),
halves AS (SELECT *, substr(string_split(output, '<M>')[1], 4) AS head, string_split(output, '<M>')[-1] AS mid FROM put)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(a) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(b) END AS BIGINT) AS middle_chars,
       sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN string_split(head, '<S>')[1] || mid || string_split(head, '<S>')[2]
                        ELSE string_split(head, '<P>')[2] || mid || string_split(head, '<P>')[1] END) AS restored_sha256
FROM halves
"""
