"""Python sources to facts, one task row per file: nodes, imports, calls, types and bases.

Facts come as one tagged stream, ``fact, name, a, b, c, n, doc, file, seq``:

========  =========================  ==============  ===========  ==========  =======
fact      name                       a               b            c           n
========  =========================  ==============  ===========  ==========  =======
node      node                       kind            module       owner       line
import    module                     target
alias     module                     local           target
from      module                     local           source       original
star      module                     source                                   order
relative  module                     base            local        original    level
call      caller                     name or attr    base         called
type      scope                      variable        type
base      class                      expression                               order
========  =========================  ==============  ===========  ==========  =======
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import settings

FACTS = "fact string, name string, a string, b string, c string, n int, doc string, file string, seq int"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NAME = re.compile(r"[A-Za-z_][\w.]*")


def dotted(e: ast.expr | None) -> str | None:
    """``a.b.c`` of a chain of plain names, else nothing."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        head = dotted(e.value)
        return head and f"{head}.{e.attr}"
    return None


def annotated(e: ast.expr | None) -> str | None:
    """The one class that an annotation names: plain, quoted, optional or one side of a union."""
    match e:
        case ast.Constant(value=str() as s):
            return s.strip() if _NAME.fullmatch(s.strip()) else None
        case ast.Name() | ast.Attribute():
            return dotted(e)
        case ast.BinOp(left=left, op=ast.BitOr(), right=right):
            sides = (annotated(s) for s in (left, right))
            return next((s for s in sides if s and s != "None"), None)
        case ast.Subscript(value=v, slice=inner) if dotted(v) in ("Optional", "typing.Optional"):
            return annotated(inner)
    return None


def _own_scope(body: Iterable[ast.AST]) -> Iterator[ast.AST]:
    """Nodes of a scope in order; definitions are seen but not entered."""
    for node in body:
        yield node
        if not isinstance(node, (*_DEFS, ast.ClassDef)):
            yield from _own_scope(ast.iter_child_nodes(node))


def _call_facts(scope: str, nodes: list[ast.AST]) -> Iterator[dict]:
    for f in {(type(x.func), dotted(getattr(x.func, "value", None)), getattr(x.func, "attr", getattr(x.func, "id", None))) for x in nodes if isinstance(x, ast.Call)}:
        if f[0] is ast.Name:
            yield {"fact": "call", "name": scope, "a": "name", "c": f[2]}
        elif f[0] is ast.Attribute:
            yield {"fact": "call", "name": scope, "a": "attr", "b": f[1], "c": f[2]}


def _type_facts(scope: str, nodes: list[ast.AST], known: dict[str, str]) -> Iterator[dict]:
    """An annotation decides; without one, the first constructor call assigned does."""
    for x in nodes:
        if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
            if t := annotated(x.annotation):
                known[x.target.id] = t
        elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (t := dotted(x.value.func)):
            for target in x.targets:
                if isinstance(target, ast.Name):
                    known.setdefault(target.id, t)
    return ({"fact": "type", "name": scope, "a": v, "b": t} for v, t in known.items())


def _import_facts(module: str, tree: ast.Module) -> Iterator[dict]:
    order = 0
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for n in x.names:
                yield {"fact": "import", "name": module, "a": n.name}
                local = n.asname or n.name.partition(".")[0]
                yield {"fact": "alias", "name": module, "a": local, "b": n.name if n.asname else local}
        elif isinstance(x, ast.ImportFrom) and x.level:
            for n in x.names:
                yield {"fact": "relative", "name": module, "n": x.level, "a": x.module or "", "b": n.asname or n.name, "c": n.name}
        elif isinstance(x, ast.ImportFrom):
            yield {"fact": "import", "name": module, "a": x.module}
            for n in x.names:
                if n.name == "*":
                    order += 1
                    yield {"fact": "star", "name": module, "a": x.module, "n": order}
                else:
                    yield {"fact": "from", "name": module, "a": n.asname or n.name, "b": x.module, "c": n.name}


def _doc(node) -> str:
    return (ast.get_docstring(node) or "").split("\n")[0][: settings.DOC_CHARS]


def facts(module: str, source: str) -> Iterator[dict]:
    """Facts of one file; none if it has a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return

    def node(name: str, kind: str, x, owner: str | None = None) -> dict:
        return {"fact": "node", "name": name, "a": kind, "b": module, "c": owner, "n": getattr(x, "lineno", 0), "doc": _doc(x)}

    def function(x, prefix: str, kind: str, owner: str | None) -> Iterator[dict]:
        name, inside = f"{prefix}.{x.name}", list(ast.walk(x))
        yield node(name, kind, x, owner)
        yield from _call_facts(name, inside)
        args = [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]
        yield from _type_facts(name, inside, {a.arg: t for a in args if (t := annotated(a.annotation))})

    yield node(module, "module", tree)
    yield from _import_facts(module, tree)
    scope = list(_own_scope(tree.body))
    yield from _call_facts(module, scope)
    yield from _type_facts(module, scope, {})
    for x in tree.body:
        if isinstance(x, _DEFS):
            yield from function(x, module, "function", None)
        elif isinstance(x, ast.ClassDef):
            name = f"{module}.{x.name}"
            yield node(name, "class", x)
            yield from ({"fact": "base", "name": name, "a": b, "n": i} for i, b in enumerate(filter(None, map(dotted, x.bases))))
            for item in x.body:
                if isinstance(item, _DEFS):
                    yield from function(item, name, "method", name)


def parsed(files: DataFrame) -> DataFrame:
    """The fact stream of ``files(file, module, text)``; files are independent of each other."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            rows = [f | {"file": file, "seq": i} for file, module, text in zip(batch["file"], batch["module"], batch["text"], strict=True) for i, f in enumerate(facts(module, text or ""))]
            out = pd.DataFrame(rows, columns=names)
            out["n"] = out["n"].astype("Int32")
            yield out

    return files.select("file", "module", "text").mapInPandas(work, FACTS)


def _segments(source: str) -> list[tuple[str, str]] | None:
    """``(label, code)`` of what a file defines at its top; none if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    pick = lambda x: ast.get_source_segment(source, x) or ""
    head = [ast.get_docstring(tree) or "", *(pick(x) for x in tree.body if isinstance(x, (ast.Import, ast.ImportFrom)))]
    header = "\n".join(filter(None, head)).strip()
    own = [("class" if isinstance(x, ast.ClassDef) else "function", x.name, pick(x)) for x in tree.body if isinstance(x, (*_DEFS, ast.ClassDef))]
    return [("imports", header)] * bool(header) + [(f"{kind} {name}", code) for kind, name, code in own if code]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("code", T.StringType())])))
def _segment_column(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _segments(t or ""))


def code_chunks(files: DataFrame, most: int = settings.CODE_CHUNK_CHARS) -> DataFrame:
    """``file, ord, label, piece``: a chunk of imports, then one for each top-level definition.

    Longer segments are cut into windows that repeat the label; files that do not parse, or define
    nothing, become plain windows without a label.
    """
    from lodestone.operators.chunking import spans, steps

    rows = files.select("file", "text", _segment_column("text").alias("segments"))
    plain = F.transform(spans(steps(F.col("text"))), lambda p: F.struct(F.lit(None).cast("string").alias("label"), p["piece"].alias("piece")))

    def cut(s: Column) -> Column:
        label = F.concat(F.lit("["), F.col("file"), F.lit(" — "), s["label"], F.lit("]"))
        whole = F.array(F.struct(label.alias("label"), s["code"].alias("piece")))
        parts = F.transform(spans(steps(s["code"])), lambda p: F.struct(label.alias("label"), p["piece"].alias("piece")))
        return F.when(F.length(s["code"]) <= most, whole).otherwise(parts)

    pieces = F.when(F.size("segments") > 0, F.flatten(F.transform("segments", cut))).otherwise(plain)
    return rows.select("file", F.posexplode(pieces).alias("ord", "c")).select("file", "ord", "c.label", "c.piece")
