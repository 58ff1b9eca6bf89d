"""Questions on a code graph: which nodes are meant, who is affected, and a textual report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.operators import traversal
from lodestone.operators.code_graph import CodeGraph


def depth_for(query: str) -> int:
    """Three levels for a question about impact, else one."""
    return 3 if any(k in query.lower() for k in settings.IMPACT_KEYWORDS) else 1


def find_matches(nodes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """``nodes`` that a question names, with ``rank``: by dotted names if any fits, else by short names, functions first."""
    q = F.lit(query)
    dotted = F.array_distinct(F.regexp_extract_all(q, F.lit(r"(?U)[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+"), F.lit(0)))
    tokens = F.array_distinct(F.regexp_extract_all(q, F.lit(r"(?U)[A-Za-z_]\w*"), F.lit(0)))
    exact = F.exists(dotted, lambda d: (F.col("name") == d) | F.endswith(F.col("name"), F.concat(F.lit("."), d)))
    short = F.array_contains(tokens, F.substring_index("name", ".", -1))
    marked = nodes.withColumn("tier", F.when(exact, 0).when(short, 1)).filter("tier IS NOT NULL")
    callable_last = F.when(F.col("tier") == 0, 0).otherwise(F.when(F.col("kind").isin("function", "method"), 0).otherwise(1))
    ordered = marked.withColumn("__kind", callable_last).orderBy("tier", "__kind", "seq").limit(limit)
    # The limit keeps exact hits first, so a short hit stays only if there is no exact one.
    best = F.min("tier").over(W.partitionBy(F.lit(0)))
    top = ordered.withColumn("__best", best).filter(F.col("tier") == F.col("__best"))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("__kind", "seq"))
    return top.withColumn("rank", rank).drop("tier", "__kind", "__best")


def start_set(nodes: DataFrame, name: str) -> DataFrame:
    """A class with its methods; anything else alone."""
    return nodes.filter((F.col("name") == name) | (F.col("owner") == name)).select(F.col("name").alias("node"))


def traverse(graph: CodeGraph, name: str, direction: str = "callers", depth: int = 3) -> DataFrame:
    """``node, level, uncertain`` around one node."""
    walk = traversal.callers if direction == "callers" else traversal.callees
    return walk(graph.calls, start_set(graph.nodes, name), depth)


def import_levels(graph: CodeGraph, module: str, depth: int = 3) -> DataFrame:
    """``node, level``: modules that import a module, directly or through others."""
    start = graph.nodes.filter(F.col("name") == module).select(F.col("name").alias("node"))
    return traversal.callers(graph.imports.withColumn("certain", F.lit(True)), start, depth).select("node", "level")


def listed(items: Column, cap: int = settings.LIST_CAP) -> Column:
    """Up to ``cap`` items and how many more there are."""
    more = F.size(items) - cap
    return F.concat(F.array_join(F.slice(items, 1, cap), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def _marked(name: Column, uncertain: Column) -> Column:
    return F.concat(name, F.when(uncertain, " (?)").otherwise(""))


def _by_level(found: DataFrame) -> DataFrame:
    """``level, line, n``: one line for each level, nodes in order of their names."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("node", "uncertain"))), lambda x: _marked(x["node"], x["uncertain"]))
    return found.groupBy("level").agg(items.alias("items")).select("level", listed(F.col("items")).alias("line"), F.size("items").alias("n"))


def report(graph: CodeGraph, name: str, depth: int = 3) -> DataFrame:
    """``section, ord, line`` about one node: header, document line, members or calls, and who is affected, level by level."""
    node = graph.nodes.filter(F.col("name") == name)
    header = F.concat(F.col("kind"), F.lit(" "), F.col("name"), F.lit(" ("), F.col("file"), F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""), F.lit(")"))
    parts = [node.select(F.lit("header").alias("section"), F.lit(0).alias("ord"), header.alias("line")), node.filter("doc <> ''").select(F.lit("doc"), F.lit(0), F.col("doc"))]
    found = node.select("kind").first()
    if found is None:
        return parts[0]

    def gather(section: str, rows: DataFrame, *order: str) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(o).alias(f"by{i}") for i, o in enumerate(order)), "item"))), lambda x: x["item"])
        return rows.agg(items.alias("items")).filter(F.size("items") > 0).select(F.lit(section), F.lit(0), listed(F.col("items")))

    short = F.substring_index("name", ".", -1).alias("item")
    if found["kind"] == "module":
        defined = graph.nodes.filter((F.col("module") == name) & F.col("kind").isin("function", "class"))
        parts.append(gather("defines", defined.select("seq", short), "seq"))
        parts.append(gather("imports", graph.imports.filter(F.col("src") == name).select(F.col("dst").alias("item")), "item"))
        around = import_levels(graph, name, depth).withColumn("uncertain", F.lit(False))
    else:
        if found["kind"] == "class":
            parts.append(gather("bases", graph.bases.filter(F.col("src") == name).select("ord", F.col("dst").alias("item")), "ord"))
            parts.append(gather("methods", graph.nodes.filter(F.col("owner") == name).select("seq", short), "seq"))
        else:
            direct = graph.calls.filter(F.col("src") == name).select((~F.col("certain")).alias("maybe"), F.col("dst"))
            parts.append(gather("calls", direct.select("maybe", _marked(F.col("dst"), F.col("maybe")).alias("item")), "maybe"))
            deeper = _by_level(traverse(graph, name, "callees", depth).filter("level > 1"))
            parts.append(deeper.select(F.lit("calls deeper"), "level", "line"))
        around = traverse(graph, name, "callers", depth)
    parts.append(_by_level(around).select(F.lit("affected"), "level", "line"))
    files = around.join(graph.nodes.select(F.col("name").alias("node"), "file"), "node")
    total = files.agg(F.count("*").alias("n"), F.countDistinct("file").alias("f")).filter("n > 0")
    parts.append(total.select(F.lit("total"), F.lit(0), F.concat(F.col("n").cast("string"), F.lit(" nodes in "), F.col("f").cast("string"), F.lit(" files"))))
    return reduce(DataFrame.union, parts)


#: Order of a report's sections in its text.
SECTIONS = ("header", "doc", "defines", "imports", "bases", "methods", "calls", "calls deeper", "affected", "total")


def report_text(rows: DataFrame) -> DataFrame:
    """One row ``text`` of a report."""
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    line = F.when(F.col("section").isin("header", "doc"), F.col("line")).when(F.col("ord") > 0, F.concat("section", F.lit(" "), F.col("ord").cast("string"), F.lit(": "), "line")).otherwise(F.concat("section", F.lit(": "), "line"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "ord", line.alias("l")))), lambda x: x["l"])
    return rows.agg(F.array_join(items, "\n").alias("text"))


def search(graph: CodeGraph, query: str, top_k: int = 5, depth: int | None = None) -> DataFrame:
    """``rank, node, source, text``: a report for each node that a question names, ``top_k`` at most."""
    depth = depth_for(query) if depth is None else depth
    hits = find_matches(graph.nodes, query, top_k).select("rank", "name", "file").orderBy("rank").collect()
    found = [report_text(report(graph, h["name"], depth)).select(F.lit(h["rank"]).alias("rank"), F.lit(h["name"]).alias("node"), F.lit(h["file"]).alias("source"), "text") for h in hits]
    if not found:
        return graph.nodes.filter("false").select(F.lit(0).alias("rank"), F.col("name").alias("node"), F.col("file").alias("source"), F.lit("").alias("text"))
    return reduce(DataFrame.unionByName, found)


def file_names(graph: CodeGraph) -> DataFrame:
    """Files in the order of their first node."""
    return graph.nodes.groupBy("file").agg(F.min("seq").alias("first"), F.count("*").alias("n_nodes"))
