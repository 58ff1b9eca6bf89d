"""Operator 3: line dedup by winnowing over line hashes, in DataFrame functions alone.

Lines are compared without surrounding spaces; blank lines are never compared and
always stay.  A run is ``RUN`` consecutive lines, or one line of ``ALONE`` characters
or more; a line goes if it belongs to a run that also starts earlier, in a document of
smaller id or higher up in the same one.  Shorter lines (list items, headings) stand
again in many texts by nature: alone they stay.

Every window of ``RUN`` lines has a fingerprint, the smallest of its line hashes (the
first, if several are equal), so equal runs of that length are guaranteed to share
one.  Fingerprints are kept with their positions and the lines around them; positions
whose hash occurs once end there.  The others are joined by hash and extended both
ways, to every window around them that chose them; a window matches an earlier one if
all its hashes do.  Matching windows that overlap make up the maximal runs to delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.tables import documents, named_once, stored

RUN = 2
#: Characters of a line that is a run by itself.
ALONE = 40


def _later(runs: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id, j`` of the runs (hashes ``names``) that an equal one precedes."""
    at = F.struct("doc_id", "j")
    firsts = stored(runs.groupBy(*names).agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    return runs.join(firsts, names).filter(at > F.col("first")).select("doc_id", "j")


def _picked(window: Column, j: Column) -> Column:
    """Place in the document of the fingerprint of the window that starts at ``j``."""
    return j + F.array_position(window, F.array_min(window)).cast("int") - 1


def _runs_of_lines(lined: DataFrame, run: int) -> DataFrame:
    """``doc_id, j``: starts of windows of ``run`` lines that repeat earlier ones."""
    lined = lined.filter(F.size("h") >= run)
    window = lambda h, j: F.slice(h, j + 1, run)
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda j: _picked(window(F.col("h"), j), j)))
    low, high = lambda at: F.greatest(at - run + 1, F.lit(0)), lambda at: F.least(at + run - 1, F.size("h") - 1)
    point = lambda at: F.struct(F.get("h", at).alias("fingerprint"), at.alias("at"), low(at).alias("base"), F.slice("h", low(at) + 1, high(at) - low(at) + 1).alias("around"))
    positions = lined.select("doc_id", F.explode(F.transform(places, point)).alias("p")).select("doc_id", "p.*")
    shared = stored(positions.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    met = positions.join(shared, "fingerprint")
    extended = met.select("doc_id", "at", "base", "around", F.explode(F.sequence(F.lit(0), F.size("around") - run)).alias("o"))
    extended = extended.select("doc_id", "at", (F.col("base") + F.col("o")).alias("j"), window(F.col("around"), F.col("o")).alias("w"))
    names = [f"h{k}" for k in range(run)]
    own = extended.filter(_picked(F.col("w"), F.col("j")) == F.col("at"))
    return _later(stored(own.select("doc_id", "j", *(F.get("w", F.lit(k)).alias(n) for k, n in enumerate(names)))), names)


def _single_lines(docs: DataFrame, full: Column, alone: int) -> DataFrame:
    """``doc_id, j``: lines of ``alone`` characters or more that stand earlier, too."""
    numbered = F.transform(full, lambda p, j: F.struct(j.alias("j"), p["t"].alias("t")))
    each = docs.select("doc_id", F.explode(F.filter(numbered, lambda p: F.length(p["t"]) >= alone)).alias("p"))
    return _later(stored(each.select("doc_id", F.col("p.j").alias("j"), F.xxhash64("p.t").alias("h0"), F.xxhash64("p.t", F.lit(1)).alias("h1"))), ["h0", "h1"])


def repeated_lines(df: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", alone: int | None = ALONE) -> DataFrame:
    """``doc_id, gone array<int>``: numbers (from 0) of the lines to delete, for documents that have any."""
    docs, _ = named_once(df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    docs = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    full = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t"))), lambda p: p["t"] != "")
    hashed = docs.select("doc_id", full.alias("l"))
    lined = stored(hashed.select("doc_id", F.transform("l", lambda p: p["i"]).alias("i"), F.transform("l", lambda p: F.xxhash64(p["t"])).alias("h")).filter("size(i) > 0"))
    runs = _runs_of_lines(lined, run).groupBy("doc_id").agg(F.collect_list("j").alias("js"))
    gone = runs.select("doc_id", F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + run - 1)))).alias("js"))
    if alone is not None:
        singles = _single_lines(docs, full, alone).groupBy("doc_id").agg(F.collect_list("j").alias("js"))
        gone = gone.unionByName(singles).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"))
    found = lined.select("doc_id", "i").join(gone, "doc_id").dropDuplicates(["doc_id"])
    return found.select("doc_id", F.transform("js", lambda j: F.get("i", j)).alias("gone"))


def remove_repeated_lines(df: DataFrame, run: int = RUN, alone: int | None = ALONE) -> DataFrame:
    """``df(doc_id, text, ...)`` with its repeated runs deleted from ``text``, and ``n_lines``, ``n_removed``.

    Other columns stay, except ones named like the two that are added.  A null text stays null and has
    no line; an empty text has one blank line.  Rows with a null doc_id, or with one that names several
    different texts, stay whole and take no part.  Rows that repeat a doc_id and its text count as one document.
    """
    gone = stored(repeated_lines(df, run, alone=alone))
    own = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    named = [F.col(f"`{c}`") for c in own]
    # Texts meet their deletions in a merge join at every size; they are split after it, so they move once.
    rows = df.select(*named).join(gone.withColumnRenamed("gone", "__gone").hint("merge"), "doc_id", "left").withColumn("__lines", F.split("text", "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n"))
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    removed = F.coalesce(F.size("__gone"), F.lit(0))
    out = rows.select(*(left.alias("text") if c == "text" else F.col(f"`{c}`") for c in own), size.alias("n_lines"), F.greatest(removed, F.lit(0)).cast("long").alias("n_removed"))
    return out


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
),
full_lines AS (
  SELECT doc_id, i, trim(line) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM l WHERE trim(line) <> ''
),
runs AS (
  SELECT a.doc_id, a.i AS i0, b.i AS i1,
         row_number() OVER (PARTITION BY a.t, b.t ORDER BY a.doc_id, a.k) AS n
  FROM full_lines a JOIN full_lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1
),
singles AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS n FROM full_lines WHERE length(t) >= 40),
gone AS (
  SELECT doc_id, i FROM singles WHERE n > 1
  UNION
  SELECT doc_id, i0 AS i FROM runs WHERE n > 1
  UNION
  SELECT doc_id, i1 AS i FROM runs WHERE n > 1
),
marked AS (
  SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS is_gone
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
),
kept AS (
  SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN is_gone THEN 1 ELSE 0 END) AS n_removed,
         string_agg(CASE WHEN is_gone THEN NULL ELSE line END, chr(10) ORDER BY i) AS t
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
