"""Traversal of edge tables, and graphs of code that is generated from a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.operators import code_graph, code_parse, code_query, hybrid, traversal, vector_search
from lodestone.plans.fixtures import CHAIN, RULES, TURNED, generated, generated_graph, ruled, ruled_graph, turned_graph
from lodestone.plans.registry import Registry, table
from lodestone.plans.text_queries import _CHUNKS, _HITS, _TERMS, QUESTION, document_chunks

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle



def _quoted(text: str) -> str:
    """SQL of a text with line ends."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_EDGES = """
edges AS (SELECT src, dst, bool_or(certain) AS certain FROM (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_linestatus <> 'O' AS certain FROM lineitem WHERE l_returnflag <> 'A'
  UNION ALL
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_linestatus <> 'O' AS certain FROM lineitem WHERE l_returnflag = 'A'
) GROUP BY src, dst)
"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    s, p = F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey")
    out = F.col("l_returnflag") != "A"
    each = items.select(F.when(out, s).otherwise(p).alias("src"), F.when(out, p).otherwise(s).alias("dst"), (F.col("l_linestatus") != "O").alias("certain"))
    return each.groupBy("src", "dst").agg(F.bool_or("certain").alias("certain"))


def _levels(src: str, dst: str, depth: int = 3) -> str:
    parts = [_EDGES, "l0 AS (SELECT 's1' AS node, 0 AS level, false AS uncertain)", "seen0 AS (SELECT node FROM l0)"]
    for i in range(1, depth + 1):
        parts.append(f"l{i} AS (SELECT e.{dst} AS node, {i} AS level, bool_and(f.uncertain OR NOT e.certain) AS uncertain FROM l{i - 1} f JOIN edges e ON f.node = e.{src} WHERE e.{dst} NOT IN (SELECT node FROM seen{i - 1}) GROUP BY e.{dst})")
        parts.append(f"seen{i} AS (SELECT node FROM seen{i - 1} UNION ALL SELECT node FROM l{i})")
    return "WITH " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT node, CAST(level AS INTEGER) AS level, uncertain FROM l{i}" for i in range(1, depth + 1))


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s1",)], "node string")


@query(_levels("src", "dst"))
def bfs_callees_3(spark: SparkSession, d: str) -> DataFrame:
    return traversal.callees(_edges(spark, d), _start(spark), 3)


@query(_levels("dst", "src"))
def bfs_callers_3(spark: SparkSession, d: str) -> DataFrame:
    return traversal.callers(_edges(spark, d), _start(spark), 3)


@query(f"""
WITH p AS (SELECT p_brand, p_type, regexp_extract(p_name, '([^ ]+)$', 1) || '_' || p_size AS called FROM part),
m AS (SELECT DISTINCT p_brand || '.' || called AS name, called FROM p),
g AS (SELECT DISTINCT p_type AS src, called FROM p),
few AS (SELECT called FROM m GROUP BY called HAVING count(*) <= {settings.AMBIGUOUS_LIMIT})
SELECT src, m.name AS dst FROM g JOIN m ON g.called = m.called WHERE g.called IN (SELECT called FROM few)
""")
def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    """Brands stand for classes, last words of names with sizes for methods, types for callers."""
    called = F.concat(F.substring_index("p_name", " ", -1), F.lit("_"), "p_size")
    parts = table(spark, d, "part").select("p_brand", "p_type", called.alias("called"))
    methods = parts.select(F.lit("method").alias("kind"), F.concat("p_brand", F.lit("."), "called").alias("name")).distinct()
    return code_graph.guessed(methods, parts.select(F.col("p_type").alias("src"), "called").distinct())


#: Modules and definitions of the packages of ``ruled``, by supplier.
_RULED = """
k AS (SELECT s_suppkey AS k, 't' || s_suppkey AS t FROM supplier),
modules AS (SELECT t AS name FROM k UNION ALL SELECT t || '.base' FROM k UNION ALL SELECT t || '.use' FROM k UNION ALL SELECT t || '.long' FROM k)
"""


@query(f"""
WITH {_RULED}
SELECT name AS dotted, name AS target FROM modules
UNION ALL SELECT 'base', min_by(t || '.base', t || '.base.py') FROM k
UNION ALL SELECT 'use', min_by(t || '.use', t || '.use.py') FROM k
UNION ALL SELECT 'long', min_by(t || '.long', t || '.long.py') FROM k
""")
def suffix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Last parts that many modules share find the first of them."""
    return code_graph.module_table(ruled_graph(spark, d).nodes)


@query(f"""
WITH {_RULED}
SELECT name, 'module' AS kind FROM modules
UNION ALL SELECT t || '.base.Base', 'class' FROM k UNION ALL SELECT t || '.use.Child', 'class' FROM k
UNION ALL SELECT t || unnest(['.base.helper', '.use.typed', '.use.called', '.long.long']), 'function' FROM k
UNION ALL SELECT t || unnest(['.base.Base.__init__', '.base.Base.ready', '.base.Base.only' || k, '.use.Child.only' || k]), 'method' FROM k
""")
def code_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Packages generated from suppliers; files that do not parse define nothing."""
    return ruled_graph(spark, d).nodes.select("name", "kind")


@query(f"""
WITH {_RULED}
SELECT t || '.base.Base.__init__' AS src, t || '.base.Base.ready' AS dst, true AS certain FROM k
UNION ALL SELECT t || '.base.helper', t || '.base.Base.__init__', true FROM k
UNION ALL SELECT t || '.use.Child.only' || k, t || '.base.Base.ready', true FROM k
UNION ALL SELECT t || '.use.typed', t || '.base.Base.' || unnest(['ready', 'only' || k]), true FROM k
UNION ALL SELECT t || '.use.called', t || '.base.' || unnest(['helper', 'Base.__init__', 'Base.ready']), true FROM k
UNION ALL SELECT t || '.use.called', t || unnest(['.base.Base.only' || k, '.use.Child.only' || k]), false FROM k
""")
def code_calls(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of all forms, aliases, star and relative imports, outside names, constructors, and calls that can only be guessed."""
    return ruled_graph(spark, d).calls


@query(f"WITH {_RULED} SELECT t AS src, t || '.base' AS dst FROM k UNION ALL SELECT t || '.use', unnest([t, t || '.base']) FROM k")
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return ruled_graph(spark, d).imports


@query(f"WITH {_RULED} SELECT t || '.use.Child' AS src, t || '.base.Base' AS dst FROM k")
def code_bases(spark: SparkSession, d: str) -> DataFrame:
    return ruled_graph(spark, d).bases.select("src", "dst")


@query(f"""
WITH {_RULED}, f AS (SELECT 't' || s_suppkey || part AS module, replace(text, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS text, part FROM supplier, (VALUES {", ".join(f"('{part}', {_quoted(text)})" for part, text in RULES.items())}) v(part, text)),
whole AS (
  SELECT module || '.py' AS file, 0 AS seg, 'function long' AS label, regexp_replace(text, '\\s+$', '') AS code FROM f WHERE part = '.long'
  UNION ALL SELECT module || '.py', 0, NULL, text FROM f WHERE part = '.broken'
),
starts AS (SELECT *, unnest(range(0, length(code), 650)) AS start FROM (SELECT file, seg, label, regexp_replace(code, '^\\s+|\\s+$', '', 'g') AS code FROM whole)),
pieces AS (SELECT file, label, start, regexp_replace(substr(code, start + 1, 800), '^\\s+|\\s+$', '', 'g') AS piece FROM starts)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY start) - 1 AS INTEGER) AS ord, '[' || file || ' — ' || label || ']' AS label, piece FROM pieces WHERE piece <> ''
""")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A function too long for one chunk, whose windows repeat its label, and a file that does not parse."""
    return code_parse.code_chunks(ruled(spark, d).filter("file LIKE '%.long.py' OR file LIKE '%.broken.py'"))


@query(f"""
WITH {_RULED}, m AS (SELECT 'short' AS question, unnest([t || '.base.Base.ready', t || '.base.helper']) AS name, t || '.base.py' AS file, unnest([1, 2]) AS o FROM k),
r AS (SELECT question, name, CAST(row_number() OVER (ORDER BY file, o) AS INTEGER) AS rank FROM m)
SELECT * FROM r WHERE rank <= 5
UNION ALL SELECT 'exact', t || '.base.Base.only' || k, 1 FROM k WHERE k = 1
""")
def code_find_matches(spark: SparkSession, d: str) -> DataFrame:
    nodes = ruled_graph(spark, d).nodes
    asked = {"exact": "Who calls Base.only1 and helper?", "short": "what is ready or helper for"}
    a, b = (code_query.find_matches(nodes, q).select(F.lit(k).alias("question"), "name", "rank") for k, q in asked.items())
    return a.unionByName(b)


@query(f"WITH {_RULED} SELECT 1 AS level, t || unnest(['', '.use']) AS node FROM k WHERE k = 1")
def import_levels(spark: SparkSession, d: str) -> DataFrame:
    return code_query.import_levels(ruled_graph(spark, d), "t1.base", 3).select("level", "node")


@query(f"""
WITH {_RULED}, one AS (SELECT * FROM k WHERE k = 1)
SELECT 'header' AS section, 0 AS ord, 'method t1.base.Base.ready (t1.base.py:10)' AS line FROM one
UNION ALL SELECT 'affected', 1, 't1.base.Base.__init__, t1.use.Child.only1, t1.use.called, t1.use.typed' FROM one
UNION ALL SELECT 'affected', 2, 't1.base.helper' FROM one
UNION ALL SELECT 'total', 0, '5 nodes in 2 files' FROM one
""")
def code_describe(spark: SparkSession, d: str) -> DataFrame:
    return code_query.report(ruled_graph(spark, d), "t1.base.Base.ready", 3)


_MODULES = f"""
k AS (SELECT s_suppkey AS k FROM supplier),
g AS (SELECT k, k % {CHAIN} AS p, 'c' || (k // {CHAIN}) || '.m' || k AS module, 'c' || (k // {CHAIN}) || '.m' || (k - 1) AS before, 'c' || (k // {CHAIN}) || '.m' || ({CHAIN} * (k // {CHAIN})) AS root, 'C' || ({CHAIN} * (k // {CHAIN})) AS top FROM k),
nodes AS (
  SELECT module AS name, 'module' AS kind, k, 0 AS ord, module FROM g UNION ALL SELECT module || '.C' || k, 'class', k, 2, module FROM g UNION ALL SELECT module || '.go', 'function', k, 4, module FROM g
  UNION ALL SELECT module || '.f', 'function', k, 1, module FROM g WHERE p = 0 UNION ALL SELECT module || '.C' || k || '.hello', 'method', k, 3, module FROM g WHERE p = 0),
calls AS (
  SELECT module || '.go' AS src, unnest([root || '.f', module || '.C' || k, root || '.' || top || '.hello']) AS dst FROM g
  UNION ALL SELECT module || '.C' || k || '.hello', module || '.f' FROM g WHERE p = 0),
imports AS (SELECT module AS src, before AS dst FROM g WHERE p > 0)
"""


@query(f"WITH {_MODULES} SELECT name, kind FROM nodes")
def generated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Modules generated from suppliers, in packages of thirteen that import in a row."""
    return generated_graph(spark, d).nodes.select("name", "kind")


@query(f"WITH {_MODULES} SELECT src, dst, true AS certain FROM calls")
def generated_calls(spark: SparkSession, d: str) -> DataFrame:
    """Names found over twelve imports, methods over twelve base classes."""
    return generated_graph(spark, d).calls


@query(f"WITH {_MODULES} SELECT src, dst FROM imports")
def generated_imports(spark: SparkSession, d: str) -> DataFrame:
    return generated_graph(spark, d).imports


@query(f"WITH {_MODULES} SELECT module || '.C' || k AS src, before || '.C' || (k - 1) AS dst FROM g WHERE p > 0")
def generated_bases(spark: SparkSession, d: str) -> DataFrame:
    return generated_graph(spark, d).bases.select("src", "dst")


@query(f"WITH {_MODULES} SELECT module AS dotted, module AS target FROM g UNION ALL SELECT 'm' || k, module FROM g")
def generated_suffixes(spark: SparkSession, d: str) -> DataFrame:
    return code_graph.module_table(generated_graph(spark, d).nodes)


@query(f"""
WITH {_MODULES} SELECT src, dst FROM calls
WHERE src NOT LIKE 'c0.m1.%' AND (src NOT LIKE 'c0.m%' OR src LIKE 'c0.m0.%' OR dst LIKE 'c0.m_.C%' AND dst NOT LIKE '%.hello' OR dst LIKE 'c0.m__.C%' AND dst NOT LIKE '%.hello')
""")
def generated_without_file(spark: SparkSession, d: str) -> DataFrame:
    """With one file removed, what its package saw through it is gone and all else stays."""
    return generated_graph(spark, d, "c0.m1.py").calls.select("src", "dst")


#: The packages after the update: ``r`` is the module that their names come from, none where that was removed.
_TURNED = f"""
k AS (SELECT s_suppkey AS k FROM supplier),
g AS (SELECT k, k % {CHAIN} AS p, k // {CHAIN} AS c, 'c' || (k // {CHAIN}) || '.m' AS m FROM k),
t AS (SELECT *, CASE WHEN p < {TURNED} THEN 0 WHEN c % 2 = 1 THEN {TURNED} END AS r FROM g WHERE NOT (c % 2 = 0 AND p = {TURNED})),
u AS (SELECT *, {CHAIN} * c + r AS rk FROM t)
"""


@query(f"""
WITH {_TURNED}
SELECT m || k || '.go' AS src, m || k || '.C' || k AS dst, true AS certain FROM u
UNION ALL SELECT m || k || '.go', unnest([m || rk || '.f', m || rk || '.C' || rk || '.hello']), true FROM u WHERE r IS NOT NULL
UNION ALL SELECT m || k || '.C' || k || '.hello', m || k || '.f', true FROM u WHERE p = r
""")
def graph_update_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls after files of the generated packages were taken away and written anew: only what reads from them is resolved again."""
    return turned_graph(spark, d).calls


@query(f"WITH {_TURNED} SELECT m || k AS src, m || (k - 1) AS dst FROM u WHERE p > 0 AND p <> coalesce(r, {TURNED + 1})")
def graph_update_imports(spark: SparkSession, d: str) -> DataFrame:
    return turned_graph(spark, d).imports


@query(f"""
WITH {_TURNED}
SELECT m || k || '.C' || k AS class, 'hello' AS method, m || rk || '.C' || rk || '.hello' AS target FROM u WHERE r IS NOT NULL
""")
def graph_update_methods(spark: SparkSession, d: str) -> DataFrame:
    """Own and inherited methods of every class after the update."""
    return turned_graph(spark, d).methods


@query(f"""
WITH {_MODULES}, s AS (
  SELECT module || '.py' AS file, 0 AS ord, CASE WHEN p = 0 THEN 'function f' ELSE 'imports' END AS label, CASE WHEN p = 0 THEN 'def f():~    return 1' ELSE 'from .m' || (k - 1) || ' import C' || (k - 1) || ', f' END AS piece FROM g
  UNION ALL SELECT module || '.py', 1, 'class C' || k, CASE WHEN p = 0 THEN 'class C' || k || ':~    def hello(self):~        return f()' ELSE 'class C' || k || '(C' || (k - 1) || '):~    pass' END FROM g
  UNION ALL SELECT module || '.py', 2, 'function go', 'def go():~    c = C' || k || '()~    f()~    return c.hello()' FROM g)
SELECT file, ord, '[' || file || ' — ' || label || ']' AS label, replace(piece, '~', chr(10)) AS piece FROM s
""")
def generated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Imports and definitions of every generated module."""
    return code_parse.code_chunks(generated(spark, d))


@query(f"WITH {_MODULES} SELECT module || '.py' AS file, count(*) AS n_nodes FROM nodes GROUP BY module")
def generated_files(spark: SparkSession, d: str) -> DataFrame:
    return code_query.file_names(generated_graph(spark, d)).select("file", "n_nodes")


@query(f"WITH {_MODULES} SELECT module AS node, CAST(p AS INTEGER) AS level FROM g WHERE k BETWEEN 1 AND 3")
def generated_import_levels(spark: SparkSession, d: str) -> DataFrame:
    return code_query.import_levels(generated_graph(spark, d), "c0.m0", 3).select("node", "level")


@query(f"WITH {_MODULES} SELECT name AS node FROM nodes WHERE name LIKE 'c0.m0.C0%'")
def generated_start_set(spark: SparkSession, d: str) -> DataFrame:
    """A class stands for itself and its methods."""
    return code_query.start_set(generated_graph(spark, d).nodes, "c0.m0.C0")


@query(f"WITH {_MODULES} SELECT module || '.go' AS node, 1 AS level, false AS uncertain FROM g WHERE root = 'c0.m0'")
def generated_callers(spark: SparkSession, d: str) -> DataFrame:
    """Who is affected by a class: every module of its package, through an inherited method."""
    return code_query.traverse(generated_graph(spark, d), "c0.m0.C0")


@query(f"""
WITH {_MODULES}, f AS (SELECT name, row_number() OVER (ORDER BY module || '.py', ord) AS rank FROM nodes WHERE name LIKE '%.go' OR name LIKE '%.f'), e AS (SELECT name, 1 AS rank FROM nodes WHERE name = 'c0.m3.go')
SELECT 'short' AS question, name, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5 UNION ALL SELECT 'exact', name, rank FROM e
""")
def generated_matches(spark: SparkSession, d: str) -> DataFrame:
    nodes = generated_graph(spark, d).nodes
    asked = {"exact": "what does m3.go do, and f?", "short": "where is go or f used"}
    a, b = (code_query.find_matches(nodes, q).select(F.lit(k).alias("question"), "name", "rank") for k, q in asked.items())
    return a.unionByName(b)


_LISTED = "array_to_string(a[:12], ', ') || CASE WHEN len(a) > 12 THEN ' +' || (len(a) - 12) ELSE '' END"


@query(f"""
WITH {_MODULES}, f AS (SELECT list(src ORDER BY src) AS a, count(*) AS n, count(DISTINCT split_part(src, '.', 2)) AS files FROM calls WHERE dst = 'c0.m0.f'),
c AS (SELECT list(module || '.go' ORDER BY module || '.go') AS a, count(*) AS n FROM g WHERE root = 'c0.m0'), i AS (SELECT count(*) AS n FROM g WHERE k BETWEEN 2 AND 4)
SELECT 'f' AS node, 'header' AS section, 0 AS ord, 'function c0.m0.f (c0.m0.py:1)' AS line UNION ALL SELECT 'f', 'affected', 1, {_LISTED} FROM f UNION ALL SELECT 'f', 'total', 0, n || ' nodes in ' || files || ' files' FROM f
UNION ALL SELECT 'C0', 'header', 0, 'class c0.m0.C0 (c0.m0.py:5)' UNION ALL SELECT 'C0', 'methods', 0, 'hello' UNION ALL SELECT 'C0', 'affected', 1, {_LISTED} FROM c UNION ALL SELECT 'C0', 'total', 0, n || ' nodes in ' || n || ' files' FROM c
UNION ALL SELECT 'm1', 'header', 0, 'module c0.m1 (c0.m1.py)' UNION ALL SELECT 'm1', 'defines', 0, 'C1, go' UNION ALL SELECT 'm1', 'imports', 0, 'c0.m0'
UNION ALL SELECT 'm1', 'affected', CAST(k - 1 AS INTEGER), module FROM g WHERE k BETWEEN 2 AND 4 UNION ALL SELECT 'm1', 'total', 0, n || ' nodes in ' || n || ' files' FROM i
""")
def generated_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports on a function, a class and a module; long lists are cut and counted."""
    graph = generated_graph(spark, d)
    parts = [code_query.report(graph, n, 3).select(F.lit(n.split(".")[-1]).alias("node"), "section", "ord", "line") for n in ("c0.m0.f", "c0.m0.C0", "c0.m1")]
    return reduce(DataFrame.unionByName, parts)


_FOUND = "SELECT 1 AS rank, 'c0.m3.go' AS node, 'c0.m3.py' AS source, 'function c0.m3.go (c0.m3.py:8)' || chr(10) || 'calls: ' || string_agg(dst, ', ' ORDER BY dst) AS text FROM calls WHERE src = 'c0.m3.go'"


@query(f"WITH {_MODULES} {_FOUND}")
def generated_search(spark: SparkSession, d: str) -> DataFrame:
    return code_query.search(generated_graph(spark, d), "impact of m3.go", 3)


@query(f"""
WITH {_MODULES}, {_CHUNKS}, {_TERMS}, {_HITS}, graph AS ({_FOUND}),
best AS (SELECT chunk_id, least(g, 0.25) AS score, row_number() OVER (ORDER BY least(g, 0.25) DESC, chunk_id) AS rank FROM gains)
SELECT 'graph' AS kind, rank, source, text, CAST(NULL AS DOUBLE) AS score FROM graph
UNION ALL SELECT 'vector', CAST(rank AS INTEGER), source, piece, round(score, 6) FROM best JOIN chunks ON chunk_id = doc_id * 2147483648 + start WHERE rank <= 2
""")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a hybrid search: a report on generated code, and passages of the documents."""
    graph = generated_graph(spark, d)
    scored = vector_search.keyword_boost(document_chunks(spark, d), QUESTION)
    sides = {
        "graph": lambda: code_query.search(graph, "what is affected by m3.go", 3, 2),
        "vector": lambda: vector_search.ranked(scored, 2, by="boost").select("rank", F.col("file").alias("source"), "text", F.round("boost", 6).alias("score")),
    }
    return hybrid.hybrid_search(sides).rows.select("kind", "rank", "source", "text", "score")
