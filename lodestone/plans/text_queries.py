"""Chunking, keyword matching, sessions and rendering."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.functions import text
from lodestone.operators import chunking, hybrid, session, store, vector_search
from lodestone.operators.models import ModelList, chat_models
from lodestone.plans.lineage import own_folder, spread
from lodestone.plans.registry import Registry, table
from lodestone.sources.files import wanted, with_text
from lodestone.streaming import conversation

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

QUESTION = "How does the winter-reading trash ontion of the heron work?"

_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_CHUNKS = rf"""
stripped AS (SELECT doc_id, source, {_STRIPPED} AS t FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, source, unnest(range(0, length(t), 650)) AS start, t FROM stripped WHERE length(t) > 0),
raw AS (SELECT doc_id, source, start, regexp_replace(substr(t, start + 1, 800), '^\s+|\s+$', '', 'g') AS piece FROM windows),
chunks AS (SELECT doc_id, source, CAST(start AS INTEGER) AS start, piece FROM raw WHERE piece <> '')
"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """``chunk_id, doc_id, file, text``: chunks of documents; an id is its document's times 2**31, and its start (an int)."""
    pieces = chunking.chunked(spread(_docs(spark, d)), "doc_id", keep=("source",))
    return pieces.select((F.col("doc_id") * (1 << 31) + F.col("start")).alias("chunk_id"), "doc_id", F.col("source").alias("file"), F.col("piece").alias("text"))


@query(f"WITH {_CHUNKS} SELECT doc_id, start, piece FROM chunks")
def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(spread(_docs(spark, d)), "doc_id").select("doc_id", "start", "piece")


@query(f"WITH {_CHUNKS} SELECT source AS file, count(*) AS n_chunks FROM chunks GROUP BY source")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.chunk_counts(document_chunks(spark, d))


_LINES = f"""
lines AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM stripped)),
placed AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
heads AS (SELECT doc_id, pos, line AS title FROM placed WHERE length(line) BETWEEN 1 AND 60)
"""


@query(f"""
WITH {_CHUNKS}, {_LINES},
best AS (SELECT c.doc_id, c.start, max(h.pos) AS pos FROM chunks c LEFT JOIN heads h ON h.doc_id = c.doc_id AND h.pos <= c.start GROUP BY c.doc_id, c.start)
SELECT b.doc_id, b.start, '[' || b.doc_id || CASE WHEN h.title IS NULL THEN '' ELSE ' — ' || h.title END || ']' AS label
FROM best b LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.pos = b.pos
""")
def heading_asof(spark: SparkSession, d: str) -> DataFrame:
    """Lines of at most 60 characters stand for headings, as the documents have no markdown."""
    docs = spread(_docs(spark, d))
    lines = F.split(text.strip("text"), "\n")
    each = docs.select("doc_id", F.posexplode(lines).alias("i", "title"))
    before = F.coalesce(F.sum(F.length("title") + 1).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    heads = each.withColumn("pos", before).filter(F.length("title").between(1, 60)).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "title")).alias("heads"))
    rows = docs.join(heads, "doc_id", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<struct<pos:int,title:string>>")))
    return chunking.labelled(rows, "doc_id", titles=F.col("heads")).select("doc_id", "start", "label")


@query(f"WITH {_CHUNKS} SELECT source AS file, min(doc_id * 2147483648 + start) AS first FROM chunks GROUP BY source")
def doc_names_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return store.document_names(document_chunks(spark, d))


@query(f"WITH {_CHUNKS} SELECT doc_id * 2147483648 + start AS chunk_id, doc_id, source AS file, piece AS text FROM chunks WHERE source <> 'src3'")
def doc_remove(spark: SparkSession, d: str) -> DataFrame:
    return store.remove_document(document_chunks(spark, d), "src3")


@query("SELECT 'd' || doc_id AS file, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def ingest_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    """Uploads whose names are stored are skipped; the labelled documents stand for those stored."""
    named = lambda t: table(spark, d, t).select(F.concat(F.lit("d"), "doc_id").alias("file"), "doc_id")
    return store.new_documents(named("documents"), named("labels"))


_TERMS = f"""
words AS (SELECT unnest(regexp_extract_all('{QUESTION}', '[A-Za-z][A-Za-z0-9_\\-]{{2,}}')) AS w),
terms AS (SELECT DISTINCT replace(replace(lower(w), '-', ''), '_', '') AS term FROM words
          WHERE length(replace(replace(lower(w), '-', ''), '_', '')) >= 3
            AND replace(replace(lower(w), '-', ''), '_', '') NOT IN ('the','and','for','how','what','with','this','that','from','does','use','are','who','why'))
"""
_HITS = """
hay AS (SELECT doc_id * 2147483648 + start AS chunk_id, replace(replace(lower(piece), '-', ''), '_', '') || ' ' || replace(replace(lower(source), '-', ''), '_', '') AS h FROM chunks),
hits AS (SELECT chunk_id, term FROM hay JOIN terms ON contains(h, term)),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
gains AS (SELECT h.chunk_id, sum(0.12 * (1 - df.df / CAST((SELECT count(*) FROM chunks) AS DOUBLE))) AS g FROM hits h JOIN df ON h.term = df.term GROUP BY h.chunk_id)
"""


@query("""
WITH words AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]{2,}')) AS w FROM benchmark),
folded AS (SELECT DISTINCT item_id, replace(replace(lower(w), '-', ''), '_', '') AS term FROM words)
SELECT item_id, term FROM folded
WHERE length(term) >= 3 AND term NOT IN ('the','and','for','how','what','with','this','that','from','does','use','are','who','why')
""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each text of ``benchmark`` as a question."""
    return table(spark, d, "benchmark").select("item_id", F.explode(text.query_terms(F.col("text"))).alias("term"))


@query(f"WITH {_CHUNKS}, {_TERMS}, {_HITS} SELECT term, df FROM df")
def keyword_df(spark: SparkSession, d: str) -> DataFrame:
    terms = text.query_terms(F.lit(QUESTION))
    found = F.transform(F.filter(F.arrays_zip(terms.alias("t"), vector_search.term_hits(F.col("text"), F.col("file"), terms).alias("h")), lambda p: p["h"]), lambda p: p["t"])
    return document_chunks(spark, d).select(F.explode(found).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_CHUNKS}, {_TERMS}, {_HITS} SELECT h.chunk_id, round(least(coalesce(g.g, 0), 0.25), 6) AS boost FROM hay h LEFT JOIN gains g ON h.chunk_id = g.chunk_id")
def keyword_boost(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.keyword_boost(document_chunks(spark, d), QUESTION, keep=["chunk_id"]).select("chunk_id", F.round("boost", 6).alias("boost"))


@query(f"""
WITH {_CHUNKS}, {_TERMS}, {_HITS},
scored AS (SELECT chunk_id, least(g, 0.25) AS score FROM gains WHERE least(g, 0.25) >= 0.1),
ranked AS (SELECT chunk_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored)
SELECT * FROM ranked WHERE rank <= 20
""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    scored = vector_search.keyword_boost(document_chunks(spark, d), QUESTION, keep=["chunk_id"]).filter("boost >= 0.1")
    return vector_search.ranked(scored, 20, by="boost").select("chunk_id", F.round("boost", 6).alias("score"), "rank")


def _named(spark: SparkSession, d: str, endings: tuple[str, ...]) -> DataFrame:
    """``p_partkey, name``: the words of each part's name joined by hyphens, with one of ``endings``, by its key."""
    end = F.get(F.array(*map(F.lit, endings)), (F.col("p_partkey") % len(endings)).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), end).alias("name"))


_MODELS = ("-nomic-embed-text", "/MXBAI-embed-large", "-all-MiniLM", "-instruct", "-E5-small", ":BGE-m3", "")
_NAMES = f"named AS (SELECT p_partkey, replace(p_name, ' ', '-') || {list(_MODELS)}[1 + p_partkey % {len(_MODELS)}] AS name FROM part)"


@query(f"""
WITH {_NAMES}
SELECT p_partkey, name AS model,
  CASE WHEN contains(lower(name), 'nomic-embed') THEN 'search_query: ' WHEN contains(lower(name), 'mxbai-embed') THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END AS query_prefix,
  CASE WHEN contains(lower(name), 'nomic-embed') THEN 'search_document: ' ELSE '' END AS document_prefix
FROM named
""")
def prefix_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Parts stand for models of several families."""
    models = _named(spark, d, _MODELS)
    return models.select("p_partkey", F.col("name").alias("model"), text.query_prefix("name").alias("query_prefix"), text.document_prefix("name").alias("document_prefix"))


@query(f"WITH {_NAMES} SELECT p_partkey, name FROM named WHERE NOT regexp_matches(lower(name), 'embed|minilm|bge|e5-')")
def chat_model_filter(spark: SparkSession, d: str) -> DataFrame:
    return chat_models(_named(spark, d, _MODELS))


@query("""
WITH paths AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'lib' WHEN 1 THEN 'lib/sub' ELSE 'other' END AS dir,
         CASE doc_id % 4 WHEN 0 THEN 'd' || doc_id || '/__init__.py' WHEN 1 THEN 'd' || doc_id || '.py' WHEN 2 THEN 'README' || doc_id || '.md' ELSE 'notes' || doc_id || '.txt' END AS base
  FROM documents
)
SELECT doc_id, dir || '/' || base AS path,
       CASE doc_id % 4 WHEN 0 THEN replace(dir, '/', '.') || '.d' || doc_id || '.py' ELSE replace(dir, '/', '.') || '.' || base END AS file,
       replace(dir, '/', '.') || '.' || CASE doc_id % 4 WHEN 2 THEN 'README' || doc_id WHEN 3 THEN 'notes' || doc_id ELSE 'd' || doc_id END AS module,
       dir <> 'other' AND doc_id % 4 < 3 AS kept
FROM paths
""")
def archive_names(spark: SparkSession, d: str) -> DataFrame:
    """Paths in an archive, one for each document: dotted names, modules, and whether an entry is taken."""
    one_of = lambda *parts: F.get(F.array(*(p if isinstance(p, Column) else F.lit(p) for p in parts)), (F.col("doc_id") % len(parts)).cast("int"))
    key = F.col("doc_id").cast("string")
    base = one_of(F.concat(F.lit("d"), key, F.lit("/__init__.py")), F.concat(F.lit("d"), key, F.lit(".py")), F.concat(F.lit("README"), key, F.lit(".md")), F.concat(F.lit("notes"), key, F.lit(".txt")))
    named = _docs(spark, d).select("doc_id", F.concat_ws("/", one_of("lib", "lib/sub", "other"), base).alias("path")).withColumn("file", text.flat_name("path"))
    return named.select("doc_id", "path", "file", text.module_name("file").alias("module"), wanted(F.col("path"), "lib").alias("kept"))


_HISTORY = r"""
WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
c AS (SELECT *, regexp_replace(regexp_replace(text, '\*\*\[(?:GRAPH|VECTOR)\]\*\*:?\s*', '', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM m WHERE back <= 6),
s AS (SELECT *, CASE WHEN back = 1 THEN text WHEN length(clean) > 400 THEN substr(clean, 1, 400) || '…' ELSE clean END AS content FROM c),
u AS (SELECT *, sum(CASE WHEN back = 1 THEN 0 ELSE length(content) END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM s)
SELECT conv_id, turn, role, content FROM u WHERE used <= 1500
"""


@query(_HISTORY)
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return session.history(table(spark, d, "conversations"))


@query(_HISTORY)
def history_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream: messages come in four parts, state is kept by conversation, the last versions are read."""
    source, versions, checkpoint = (own_folder(spark, kind) for kind in ("messages", "versions", "progress"))
    messages = table(spark, d, "conversations")
    messages.repartitionByRange(4, "turn").write.parquet(source)
    came = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    conversation.keep_versions(conversation.history_stream(came, interval=0), versions, checkpoint, once=True).awaitTermination()
    return conversation.latest(spark.read.schema(conversation.VERSIONS).parquet(versions))



@query("""
SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) > 0.9 * 2048 AS too_long FROM conversations GROUP BY conv_id
""")
def context_warning(spark: SparkSession, d: str) -> DataFrame:
    chars = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    return chars.withColumn("too_long", session.too_long(F.col("chars"), 2048))


@query("""
WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'tool') AS n, coalesce(max(length(text)) FILTER (WHERE role = 'assistant'), 0) AS chars FROM conversations GROUP BY conv_id),
m AS (SELECT *, ['hybrid', 'vector', 'graph'][1 + conv_id % 3] AS mode, CASE WHEN conv_id % 4 < 2 THEN 0 ELSE chars END AS used, conv_id % 5 = 0 AS v, conv_id % 7 = 0 AS g, conv_id % 11 = 0 AS failed FROM c)
SELECT conv_id, CASE mode WHEN 'hybrid' THEN used = 0 AND NOT (v AND g) AND NOT failed WHEN 'vector' THEN n = 0 AND NOT v ELSE false END AS told FROM m
""")
def prompt_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether each conversation's model must be told that nothing was found; modes, empty sides and errors go by its id."""
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "tool").alias("n"), F.coalesce(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.length("text"))), F.lit("")).alias("longest"))
    every = lambda n: F.col("conv_id") % n == 0
    mode = F.get(F.array(*map(F.lit, ("hybrid", "vector", "graph"))), (F.col("conv_id") % 3).cast("int"))
    context = F.when(F.col("conv_id") % 4 < 2, "").otherwise(F.col("longest"))
    return said.select("conv_id", session.no_match(mode, F.col("n"), context, every(5), every(7), every(11).cast("int")).alias("told"))


@query(r"""
WITH e AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM conversations)
SELECT conv_id, turn, replace(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '`([^`\n]+)`', '<code>\1</code>', 'g'), chr(10), '<br>') AS html FROM e
""")
def render_inline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.rendered("text").alias("html"))


@query("""
SELECT conv_id, string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
""")
def plain_context(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns as hits."""
    hits = table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", F.col("turn").alias("rank"), F.col("role").alias("source"), "text")
    return hybrid.plain_context(hits, "conv_id")


#: Characters of a conversation's context: enough for a few turns, so that some are cut and some skipped.
_ROOM = 1200
_HEAD, _NOTE = hybrid.HEADERS, hybrid.CUT_NOTE


@query(f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END AS side FROM conversations WHERE text IS NOT NULL),
h AS (
  SELECT conv_id, side, CASE side WHEN 0 THEN 'graph: ' ELSE 'vector: ' END || role AS source, '[' || role || ']' || chr(10) || text AS block,
         CASE side WHEN 0 THEN '{_HEAD["graph"]}' ELSE '{_HEAD["vector"]}' END AS head,
         CASE WHEN side = 0 AND max(side) OVER (PARTITION BY conv_id) = 1 THEN {int(_ROOM * 0.6)} ELSE {_ROOM} END AS budget,
         row_number() OVER (PARTITION BY conv_id ORDER BY side, turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
),
st(conv_id, i, used, g, v, truncated, parts, sources) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM t
  UNION ALL
  SELECT conv_id, i, used + CASE WHEN placed THEN length(body) + 2 + lead ELSE 0 END, g + CASE WHEN placed AND side = 0 THEN 1 ELSE 0 END, v + CASE WHEN placed AND side = 1 THEN 1 ELSE 0 END,
         truncated OR NOT fits, CASE WHEN placed THEN list_append(parts, CASE WHEN lead > 0 THEN head || chr(10) || chr(10) || body ELSE body END) ELSE parts END,
         CASE WHEN placed THEN list_append(sources, source) ELSE sources END
  FROM (
    SELECT *, fits OR room >= 400 AS placed, CASE WHEN fits THEN block ELSE substr(block, 1, room - {len(_NOTE)}) || chr(10) || '{_NOTE.strip()}' END AS body
    FROM (
      SELECT *, length(block) <= room AS fits
      FROM (
        SELECT *, budget - used - lead - 2 AS room
        FROM (SELECT st.conv_id, h.i, used, g, v, truncated, parts, sources, side, block, head, source, budget,
                     CASE WHEN (side = 0 AND g = 0) OR (side = 1 AND v = 0) THEN length(head) + 2 ELSE 0 END AS lead
              FROM st JOIN h ON h.conv_id = st.conv_id AND h.i = st.i + 1)
      )
    )
  )
)
SELECT st.conv_id, array_to_string(parts, chr(10) || chr(10)) AS context, array_to_string(list_sort(list_distinct(sources)), '|') AS sources,
       CAST(g AS INTEGER) AS n_graph, CAST(v AS INTEGER) AS n_vector, truncated
FROM st JOIN (SELECT DISTINCT conv_id, n FROM h) e ON e.conv_id = st.conv_id AND e.n = st.i
""")
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The context of each conversation: answers stand for relations, all other turns for passages."""
    kind = F.when(F.col("role") == "assistant", "graph").otherwise("vector")
    hits = table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", kind.alias("kind"), F.col("turn").alias("rank"), F.col("role").alias("source"), "text")
    packed = hybrid.build_context(hits, _ROOM, ["conv_id"])
    return packed.select("conv_id", "context", F.array_join("sources", "|").alias("sources"), "n_graph", "n_vector", "truncated")


@query("""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '📕' WHEN 1 THEN '📘' WHEN 2 THEN '📄' WHEN 3 THEN '📝' WHEN 4 THEN '🐍' ELSE '📄' END AS icon FROM documents
""")
def file_icons(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("a.pdf", "a.b.DOCX", "c.txt", "Md.md", "x.PY", "pdf.zip", "none")))
    return _docs(spark, d).select("doc_id", text.file_icon(F.get(ends, (F.col("doc_id") % 7).cast("int"))).alias("icon"))


@query("SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.md' END AS file, CASE WHEN doc_id % 2 = 0 THEN 'txt' ELSE 'md' END AS ext, text FROM documents WHERE text IS NOT NULL")
def read_plain_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contents of plain files; every third has bytes that are no UTF-8, which are dropped."""
    name = F.concat(F.lit("file:/in/d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".md"))
    body = F.encode("text", "utf-8")
    bad = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    return with_text(_docs(spark, d).filter("text IS NOT NULL").select(name.alias("path"), F.concat(bad, body).alias("content")))


@query(rf"""
WITH marked AS (SELECT doc_id, source, regexp_replace({_STRIPPED}, '(^|\n)([^\n]{{1,60}})(\n|$)', '\1## \2\3') AS t FROM documents WHERE text IS NOT NULL),
stripped AS (SELECT doc_id, source, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM marked),
windows AS (SELECT doc_id, unnest(range(0, length(t), 650)) AS start, t FROM stripped WHERE length(t) > 0),
chunks AS (SELECT doc_id, CAST(start AS INTEGER) AS start FROM windows WHERE regexp_replace(substr(t, start + 1, 800), '^\s+|\s+$', '', 'g') <> ''),
lines AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(t, chr(10)) AS a FROM stripped)),
placed AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
heads AS (SELECT doc_id, pos, regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*$', 1) AS title FROM placed WHERE regexp_matches(line, '^#{{1,6}}\s+\S')),
best AS (SELECT c.doc_id, c.start, max(h.pos) AS pos FROM chunks c LEFT JOIN heads h ON h.doc_id = c.doc_id AND h.pos <= c.start GROUP BY c.doc_id, c.start)
SELECT b.doc_id, b.start, '[' || b.doc_id || CASE WHEN h.title IS NULL THEN '' ELSE ' — ' || h.title END || ']' AS label
FROM best b LEFT JOIN heads h ON h.doc_id = b.doc_id AND h.pos = b.pos
""")
def markdown_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first short line of each document becomes a markdown heading, which the heading parser must find."""
    marked = F.regexp_replace("stripped", r"(?s)^(|.*?\n)([^\n]{1,60})(\n.*|)$", "$1## $2$3")
    docs = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", text.strip("text").alias("stripped"))
    return chunking.labelled(docs.select("doc_id", marked.alias("text")), "doc_id").select("doc_id", "start", "label")


@query(f"""
WITH {_CHUNKS}, l AS (SELECT doc_id, start, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id || '.py' ELSE 'd' || doc_id || '.md' END AS file, piece FROM chunks)
SELECT file, start, CASE WHEN file LIKE '%.py' THEN '[' || file || ']' || chr(10) || piece ELSE piece END AS text, '[' || file || ']' || chr(10) || piece AS embed_text FROM l
""")
def store_embed_split(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".md"))
    pieces = chunking.chunked(_docs(spark, d).withColumn("file", name), "file").withColumn("label", F.concat(F.lit("["), "file", F.lit("]")))
    return chunking.stored_and_embedded(pieces, "file").select("file", "start", "text", "embed_text")


@query(f"WITH {_CHUNKS} SELECT doc_id * 2147483648 + start AS chunk_id, source AS file, 'm' AS model, 64 AS dim FROM chunks")
def store_append(spark: SparkSession, d: str) -> DataFrame:
    held = document_chunks(spark, d).select("chunk_id", "file", F.lit("m").alias("model"), F.lit(64).alias("dim"))
    odd = F.col("chunk_id") % 2 == 1
    return store.append(held.filter(odd), held.filter(~odd))


@query("SELECT (SELECT count(*) FROM documents) = 0 AS all_empty, (SELECT count(*) FROM documents WHERE source = 'no such source') = 0 AS none_empty")
def store_is_empty(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return spark.range(1).select(F.lit(store.is_empty(docs)).alias("all_empty"), F.lit(store.is_empty(docs.filter("source = 'no such source'"))).alias("none_empty"))


@query(f"""
WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS context, count(*) AS n, ['hybrid', 'graph', 'vector', 'chat'][1 + conv_id % 4] AS mode FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
t AS (SELECT *, conv_id % 3 = 0 AS missing FROM c)
SELECT conv_id, concat_ws(chr(10) || chr(10), 'Be kind.',
  CASE WHEN missing THEN '{session.NO_MATCH}' WHEN length(context) > 0 THEN
    CASE mode {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in session.INSTRUCTIONS.items())} END || chr(10) || chr(10) || context END, '{session.LANGUAGE}') AS prompt FROM t
""")
def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    """The system prompt of each conversation, whose turns stand for the context."""
    said = table(spark, d, "conversations").filter("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    context = F.array_join(F.transform("turns", lambda t: t["text"]), " ")
    mode = F.get(F.array(*map(F.lit, ("hybrid", "graph", "vector", "chat"))), (F.col("conv_id") % 4).cast("int"))
    return said.select("conv_id", session.prompt(F.lit("Be kind."), mode, context, F.col("conv_id") % 3 == 0).alias("prompt"))


@query("""
SELECT conv_id, CASE WHEN bool_or(contains(lower(text), 'the')) THEN 6 ELSE 4 END AS top_k, 'hybrid' AS mode, CAST(0.3 AS DOUBLE) AS min_score, CAST(0.7 AS DOUBLE) AS mmr_lambda, 3 AS graph_depth, 8192 AS num_ctx
FROM conversations GROUP BY conv_id
""")
def session_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each conversation's session: defaults, but for what its messages ask for."""
    held = asdict(settings.Session())
    asks = F.bool_or(F.lower("text").contains("the"))
    convs = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(asks, F.lit(False)).alias("more"))
    kept = [F.lit(held[k]).alias(k) for k in ("mode", "min_score", "mmr_lambda", "graph_depth", "num_ctx")]
    return convs.select("conv_id", F.when(F.col("more"), 6).otherwise(held["top_k"]).alias("top_k"), *kept)


@query("SELECT DISTINCT source AS name FROM documents WHERE source IS NOT NULL")
def model_list(spark: SparkSession, d: str) -> DataFrame:
    """A client's list, asked once and held; the sources' names stand for models, and a failing client has none."""

    class Client:
        asked = 0

        def list_models(self) -> list[str]:
            self.asked += 1
            if self.asked > 1:
                raise OSError("down")
            return [r.source for r in _docs(spark, d).select("source").distinct().filter("source IS NOT NULL").collect()]

    held = ModelList(Client())
    held.get()
    names = spark.createDataFrame([(n,) for n in held.get()], "name string")
    return chat_models(names)
