"""Facts to a code graph: names are resolved with joins, rule by rule.

A name that a file uses is resolved to what it names in the data set by the first rule
that *applies*, even if it then leads nowhere: own definition, from-import (followed
through re-exports), import alias, star imports in order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import settings
from lodestone.functions.text import module_name
from lodestone.operators.code_parse import parsed
from lodestone.plans.lineage import joined_in_tasks, spread, written


@dataclass
class CodeGraph:
    """``nodes(name, kind, module, owner, line, doc, file, seq)``, ``calls(src, dst, certain)``, ``imports(src, dst)``, ``bases(src, dst, ord)``.

    The other tables are what :func:`update` goes on from: facts by file, resolved names, ends of from-imports, methods
    of classes with inherited ones, and calls of which only the method's name is known.
    """

    nodes: DataFrame
    calls: DataFrame
    imports: DataFrame
    bases: DataFrame
    facts: DataFrame
    symbols: DataFrame
    ends: DataFrame
    methods: DataFrame
    guesses: DataFrame


def _last(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def _head(c: Column) -> Column:
    """All but the last part; null for a single part."""
    return F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", ""))


def _first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def module_table(nodes: DataFrame) -> DataFrame:
    """``dotted, target``: every suffix of every module name, to the module that it finds (exact first, then file order).

    The lookup by suffix becomes an equi-join.
    """
    modules = nodes.filter("kind = 'module'").select("name", "seq")
    parts = F.split("name", r"\.")
    suffix = modules.select("name", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("dotted"))
    ranked = suffix.groupBy("dotted").agg(F.min_by("name", F.struct(F.col("dotted") != F.col("name"), "seq")).alias("target"))
    return ranked


def _absolute(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``from``, ``star`` and ``import`` facts with relative ones made absolute."""
    modules = nodes.filter("kind = 'module'").select(F.col("name").alias("module"))
    # A module is a package if some module's name goes on below it, at any depth.
    names = F.split("module", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "."))
    packages = modules.filter(F.col("module").contains(".")).select(F.explode(above).alias("module")).distinct().withColumn("package", F.lit(True))
    rel = facts.filter("fact = 'relative'").join(packages, F.col("name") == F.col("module"), "left").drop("module")
    parts = F.split("name", r"\.")
    own = F.when(F.col("package"), parts).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    up = F.col("n") - 1
    rel = rel.withColumn("own", own).filter(up <= F.size("own"))
    pkg = F.array_join(F.slice("own", 1, F.size("own") - up), ".")
    rel = rel.withColumn("base", F.concat_ws(".", F.nullif(pkg, F.lit("")), F.nullif(F.col("a"), F.lit(""))))
    plain = facts.filter("fact = 'from'").select(F.col("name").alias("module"), F.col("a").alias("local"), F.col("b").alias("source"), F.col("c").alias("original"), F.lit(0).alias("rel"), "seq")
    more = rel.filter("c <> '*'").select(F.col("name").alias("module"), F.col("b").alias("local"), F.col("base").alias("source"), F.col("c").alias("original"), F.lit(1).alias("rel"), "seq")
    # Of several bindings of a name the last absolute one holds, else the first relative one.
    froms = _first_by(plain.unionByName(more), ["module", "local"], F.col("rel"), F.when(F.col("rel") == 0, -F.col("seq")).otherwise(F.col("seq"))).drop("rel", "seq")
    stars = facts.filter("fact = 'star'").select(F.col("name").alias("module"), F.col("a").alias("source"), F.col("n").alias("ord"))
    stars = stars.unionByName(rel.filter("c = '*' AND base <> ''").select(F.col("name").alias("module"), F.col("base").alias("source"), (F.col("seq") + (1 << 30)).alias("ord")))
    imports = facts.filter("fact = 'import'").select(F.col("name").alias("module"), F.col("a").alias("dotted"))
    imports = imports.unionByName(rel.filter("a <> ''").select(F.col("name").alias("module"), F.col("base").alias("dotted")))
    imports = imports.unionByName(rel.filter("base = '' AND c <> '*'").select(F.col("name").alias("module"), F.col("c").alias("dotted")))
    return froms, stars, imports.distinct()


@dataclass
class _Names:
    """What decides a name in a module: own definitions, from-imports, aliases, star imports, and modules by suffix."""

    own: DataFrame  # name
    froms: DataFrame  # module, local, source, original
    aliases: DataFrame  # module, local, to
    stars: DataFrame  # module, source, ord
    find: DataFrame  # dotted, target

    def classed(self, states: DataFrame) -> DataFrame:
        """``states(module, local, ...)`` with ``rule``, the first that applies, and ``answer`` where that rule has one at once."""
        rows = states.join(self.own.select(F.col("name").alias("__own")), F.concat_ws(".", "module", "local") == F.col("__own"), "left")
        rows = rows.join(self.froms.select("module", "local", F.lit("from").alias("__from")), ["module", "local"], "left")
        alias = self.aliases.join(self.find, F.col("to") == F.col("dotted"), "left").select("module", "local", F.lit("alias").alias("__alias"), F.col("target").alias("__to"))
        rows = rows.join(alias, ["module", "local"], "left")
        rows = rows.join(self.stars.select("module").distinct().withColumn("__star", F.lit("star")), "module", "left")
        rule = F.when(F.col("__own").isNotNull(), "own").otherwise(F.coalesce("__from", "__alias", "__star", F.lit("none")))
        answer = F.coalesce("__own", F.when(F.col("__from").isNull(), F.col("__to")))
        return rows.withColumn("rule", rule).withColumn("answer", answer).drop("__own", "__from", "__alias", "__to", "__star")


def from_ends(names: _Names, only: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """``module, local, into, name, target``: where each from-import leads at the end of its chain.

    That is ``target``, or first what (``into``, ``name``), a name that star imports decide, comes to.  Every from-import
    points at what it imports; pointers double their reach each round, so a chain of a thousand imports takes ten.  What
    a chain meets behind its end (submodules of the same name, the deepest first) is carried along.  With ``only`` the
    other modules' ends are ``known``.  Imports in a ring are followed one by one until they come round.
    """
    froms = names.froms if only is None else names.froms.join(only, "module", "left_semi")
    into = froms.join(names.find.select(F.col("dotted").alias("source"), F.col("target").alias("into")), "source", "left")
    dotted = F.concat_ws(".", F.nullif(F.col("source"), F.lit("")), "original")
    each = into.withColumn("dotted", dotted).join(names.find.select("dotted", F.col("target").alias("sub")), "dotted", "left")
    mark = lambda module, local: F.when(F.col(module).isNotNull(), F.concat_ws("/", module, local))
    rows = each.select(mark("module", "local").alias("key"), F.col("into").alias("module"), F.col("original").alias("local"), "sub")
    rows = names.classed(rows)
    star = F.col("rule") == "star"
    first = rows.select(
        "key",
        F.when(F.col("rule") == "from", mark("module", "local")).alias("up"),
        F.when(star, F.col("module")).alias("into"),
        F.when(star, F.col("local")).alias("name"),
        F.coalesce(F.when(F.col("module").isNotNull(), F.col("answer")), "sub").alias("target"),
    )
    first = written(first)
    done, active = first.filter("up IS NULL"), first.filter("up IS NOT NULL")
    if known is not None:
        done = done.unionByName(known.select(mark("module", "local").alias("key"), F.lit(None).cast("string").alias("up"), "into", "name", "target"))
    left = active.count()
    while left:
        ahead = done.unionByName(active).select(F.col("key").alias("up"), F.col("up").alias("__up"), F.col("into").alias("__into"), F.col("name").alias("__name"), F.col("target").alias("__target"))
        jumped = active.join(ahead, "up").select("key", F.col("__up").alias("up"), F.col("__into").alias("into"), F.col("__name").alias("name"), F.coalesce("__target", "target").alias("target"))
        jumped = written(jumped)
        done, active = done.unionByName(jumped.filter("up IS NULL")), jumped.filter("up IS NOT NULL")
        before, left = left, active.count()
        if left == before:  # every chain that ends has its next one end in each round, so these are rings and what leads to them
            done = done.unionByName(_rings(first, active))
            break
    split = F.split("key", "/")
    return done.select(F.get(split, F.lit(0)).alias("module"), F.get(split, F.lit(1)).alias("local"), "into", "name", "target")


def _rings(first: DataFrame, endless: DataFrame) -> DataFrame:
    """Ends of from-imports that never end: the last submodule that is met before a name comes again."""
    hop = first.select(F.col("key").alias("at"), "up", F.col("target").alias("sub"))
    walk = written(first.join(endless.select("key"), "key", "left_semi").select("key", F.col("up").alias("at"), "target", F.array("key").alias("seen")))
    done = None
    while True:  # ends: ``seen`` grows along every walk and holds a name once
        ends = walk.filter(F.array_contains("seen", F.col("at")))
        ended = ends.select("key", F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("into"), F.lit(None).cast("string").alias("name"), "target")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.filter(~F.array_contains("seen", F.col("at"))).join(hop, "at")
        walk = written(walk.select("key", F.col("up").alias("at"), F.coalesce("sub", "target").alias("target"), F.array_append("seen", F.col("at")).alias("seen")))
        if walk.isEmpty():
            return done


def symbol_table(names: _Names, ends: DataFrame, wanted: DataFrame) -> DataFrame:
    """``module, local, target`` for each ``wanted(module, local)`` that names something in the data set.

    From-imports are at their ends at once; what is left to walk are star imports, a level of them a round.  ``path``
    orders a search's branches.  A search that comes to a name a second time goes on only if its new path is the smaller
    one: the larger would find the same, later.  A branch that comes back to where it was has the larger path.
    """
    none = F.array().cast("array<int>")
    led = ends.select("module", "local", "into", "name", F.col("target").alias("led"))

    def moved(states: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
        """Answers (``keep, path, target``) of ``states(keep, path, module, local)``, and star imports to walk (``keep, path, module, local``)."""
        rows = written(names.classed(states))
        answers = rows.filter("rule IN ('own', 'alias') AND answer IS NOT NULL").select(*keep, "path", F.col("answer").alias("target"))
        by_from = rows.filter("rule = 'from'").join(led, ["module", "local"])
        after = F.concat("path", F.array(F.lit(1)))
        answers = answers.unionByName(by_from.filter("led IS NOT NULL").select(*keep, after.alias("path"), F.col("led").alias("target")))
        further = by_from.filter("into IS NOT NULL").select(*keep, F.concat("path", F.array(F.lit(0))).alias("path"), F.col("into").alias("module"), F.col("name").alias("local"))
        return answers, further.unionByName(rows.filter("rule = 'star'").select(*keep, "path", "module", "local"))

    keep = ["root", "want"]
    start = wanted.distinct().select(F.col("module").alias("root"), F.col("local").alias("want"), none.alias("path"), "module", "local")
    found, further = moved(start, keep)
    found, todo = written(found), written(further)
    seen = todo
    while not todo.isEmpty():
        sources = names.stars.join(names.find.select(F.col("dotted").alias("source"), F.col("target").alias("into")), "source").select("module", "into", "ord")
        branch = todo.join(sources, "module").select(*keep, F.concat("path", F.array("ord")).alias("path"), F.col("into").alias("module"), "local")
        answers, further = moved(branch, keep)
        found = found.unionByName(written(answers))
        arrived = further.groupBy(*keep, "module", "local").agg(F.min("path").alias("path"))
        earlier = seen.groupBy(*keep, "module", "local").agg(F.min("path").alias("__path"))
        todo = arrived.join(earlier, [*keep, "module", "local"], "left").filter("__path IS NULL OR path < __path").drop("__path")
        todo = written(todo.select(*keep, "path", "module", "local"))
        seen = seen.unionByName(todo)
    best = found.groupBy(*keep).agg(F.min_by("target", "path").alias("target"))
    return best.select(F.col("root").alias("module"), F.col("want").alias("local"), "target")


class _Resolver:
    """Tables that the rules join to."""

    def __init__(self, facts: DataFrame, nodes: DataFrame):
        """Tables of all modules that follow from facts without walking."""
        self.nodes, self.kinds = nodes, nodes.select(F.col("name").alias("target"), F.col("kind").alias("target_kind"))
        self.modules = written(module_table(nodes))
        self.froms, self.stars, self.imports = (written(x) for x in _absolute(facts, nodes))
        alias = facts.filter("fact = 'alias'").select(F.col("name").alias("module"), F.col("a").alias("local"), F.col("b").alias("to"), "seq")
        self.aliases = written(_first_by(alias, ["module", "local"], F.desc("seq")).drop("seq"))
        self.names = _Names(nodes.select("name").distinct(), self.froms, self.aliases, self.stars, self.modules)
        self.facts = facts

    def resolve(self, only: DataFrame | None = None, ends: DataFrame | None = None) -> None:
        """Names that modules use: of all modules, or of those in ``only(module)``, the others' from-imports having ``ends``."""
        own = (lambda rows: rows) if only is None else (lambda rows: rows.join(only, "module", "left_semi"))
        known = None if only is None else ends.join(only, "module", "left_anti")
        self.ends = written(from_ends(self.names, only, known))
        calls = own(self.facts.filter("fact = 'call'").join(self.nodes.select("name", "module", "owner"), "name"))
        types = own(self.facts.filter("fact = 'type'").join(self.nodes.select("name", "module"), "name"))
        bases = own(self.facts.filter("fact = 'base'").join(self.nodes.select("name", "module"), "name"))
        used = [calls.filter("a = 'name'").select("module", F.col("c").alias("local")), calls.filter("b IS NOT NULL").select("module", F.substring_index("b", ".", 1).alias("local")), types.select("module", F.substring_index("b", ".", 1).alias("local")), bases.select("module", F.substring_index("a", ".", 1).alias("local"))]
        wanted = used[0].unionByName(used[1]).unionByName(used[2]).unionByName(used[3])
        self.symbols = written(symbol_table(self.names, self.ends, wanted))
        self.calls, self.types, self.base_facts = written(calls), types, bases
        bound = own(self.froms.select("module", "local").unionByName(self.aliases.select("module", "local"))).distinct()
        self.external = written(bound.join(self.symbols, ["module", "local"], "left_anti"))

    def module_of(self, df: DataFrame, expr: str, into: str) -> DataFrame:
        """Adds ``into``: the module that the dotted expression in column ``expr`` means in the row's module."""
        first, rest = F.substring_index(expr, ".", 1), F.when(F.col(expr).contains("."), F.regexp_replace(expr, r"^[^.]*\.", ""))
        rows = df.withColumn("__first", first).withColumn("__rest", rest)
        rows = rows.join(self.aliases.select("module", F.col("local").alias("__first"), F.col("to").alias("__to")), ["module", "__first"], "left")
        symbols = self.symbols.join(self.kinds.filter("target_kind = 'module'").select("target"), "target").select("module", F.col("local").alias("__first"), F.col("target").alias("__sym"))
        rows = rows.join(symbols, ["module", "__first"], "left")
        path = F.when(F.col("__to").isNotNull(), F.concat_ws(".", "__to", "__rest")).when(F.col("__sym").isNotNull() & F.col("__rest").isNotNull(), F.concat_ws(".", "__sym", "__rest"))
        rows = rows.withColumn("__path", path).join(self.modules.select(F.col("dotted").alias("__path"), F.col("target").alias("__mod")), "__path", "left")
        plain = F.when(F.col("__to").isNull() & F.col("__rest").isNull(), F.col("__sym"))
        return rows.withColumn(into, F.coalesce("__mod", plain)).drop("__first", "__rest", "__to", "__sym", "__path", "__mod")

    def class_of(self, df: DataFrame, expr: str, into: str) -> DataFrame:
        """Adds ``into``: the class that the expression in column ``expr`` names in the row's module."""
        rows = df.withColumn("__head", _head(F.col(expr)))
        rows = self.module_of(rows, "__head", "__in")
        rows = rows.join(self.symbols.select("module", F.col("local").alias(expr), F.col("target").alias("__sym")), ["module", expr], "left")
        rows = rows.withColumn("__key", F.when(F.col("__head").isNull(), F.col("__sym")).when(F.col("__in").isNotNull(), F.concat_ws(".", "__in", _last(F.col(expr)))))
        classes = self.kinds.filter("target_kind = 'class'").select(F.col("target").alias("__key"), F.col("target").alias(into))
        return rows.join(classes, "__key", "left").drop("__head", "__in", "__sym", "__key")


def base_order(classes: DataFrame, bases: DataFrame) -> DataFrame:
    """``class, at, path``: each class and all its bases, ordered by ``path`` as a depth-first visit in listed order meets them.

    ``far`` has what is exactly 2^k steps up, ``order`` all that is at most that far; each round doubles both, and of
    several ways to a base only the first is kept, so classes that inherit in diamonds do not multiply.
    """
    own = classes.select("class", F.col("class").alias("at"), F.array().cast("array<int>").alias("path"))
    far = written(bases.select(F.col("src").alias("class"), F.col("dst").alias("at"), F.array("ord").alias("path")))
    order = written(own.unionByName(far))

    def beyond(up: DataFrame) -> DataFrame:
        ahead = up.select(F.col("class").alias("at"), F.col("at").alias("__at"), F.col("path").alias("__path"))
        return far.join(ahead, "at").select("class", F.col("__at").alias("at"), F.concat("path", "__path").alias("path"))

    first = lambda rows: rows.groupBy("class", "at").agg(F.min("path").alias("path"))
    while not far.isEmpty():
        further = written(beyond(order))
        if not further.filter("class = at").isEmpty():
            return _order_in_rings(own, bases)
        order, far = written(first(order.unionByName(further))), written(first(beyond(far)))
    return order


def _order_in_rings(own: DataFrame, bases: DataFrame) -> DataFrame:
    """The same where classes inherit from one another, which no running program does: way by way, none through a class twice."""
    every = walk = written(own.withColumn("seen", F.array("class")))
    while True:  # ends: no way holds a class twice
        walk = walk.join(bases, F.col("at") == F.col("src")).filter(~F.array_contains("seen", F.col("dst")))
        walk = written(walk.select("class", F.col("dst").alias("at"), F.concat("path", F.array("ord")).alias("path"), F.array_append("seen", F.col("dst")).alias("seen")))
        if walk.isEmpty():
            return every.groupBy("class", "at").agg(F.min("path").alias("path"))
        every = every.unionByName(walk)


def method_table(nodes: DataFrame, bases: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``class, method, target``: own and inherited methods of each class (of modules in ``only``); bases depth first, in listed order."""
    classes = nodes.filter("kind = 'class'").select(F.col("name").alias("class"), "module")
    order = base_order(classes, bases)
    if only is not None:
        order = order.join(classes.join(only, "module", "left_semi").select("class"), "class", "left_semi")
    methods = nodes.filter("kind = 'method'").select(F.col("owner").alias("at"), _last(F.col("name")).alias("method"), F.col("name").alias("target"))
    return order.join(methods, "at").groupBy("class", "method").agg(F.min_by("target", "path").alias("target"))


def guessed(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """``src, dst`` of ``calls(src, called)`` that could mean a method of ``nodes``: every method of that name but the caller.

    Names that containers and strings have, and names of more than a few methods, are no guess.
    """
    named = nodes.filter("kind = 'method'").select(_last(F.col("name")).alias("called"), F.col("name").alias("dst")).filter(~F.col("called").isin(*settings.COMMON_METHODS))
    few = named.groupBy("called").count().filter(F.col("count") <= settings.AMBIGUOUS_LIMIT + 1).select("called")
    many = calls.join(named.join(few, "called", "left_semi"), "called").filter("src <> dst")
    allowed = many.groupBy("src", "called").count().filter(F.col("count") <= settings.AMBIGUOUS_LIMIT).select("src", "called")
    return many.join(allowed, ["src", "called"], "left_semi").select("src", "dst").distinct()


def _resolved_calls(r: _Resolver, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``src, dst`` of certain calls, and ``src, called`` of those to guess.  Each call gets the answer of the first rule that applies to it, be it empty."""
    calls = r.calls.select(F.col("name").alias("src"), "module", "owner", F.col("a").alias("tag"), F.col("b").alias("base"), F.col("c").alias("called"))
    calls = written(calls.distinct().withColumn("first", F.substring_index("base", ".", 1)).withColumn("single", ~F.col("base").contains(".")))
    id_ = ["src", "tag", "base", "called"]
    own = calls.filter("tag = 'name'").join(r.symbols.select("module", F.col("local").alias("called"), "target"), ["module", "called"])
    answers = [own.select(*id_, F.lit(0).alias("rule"), "target", F.lit("call").alias("how"))]
    attr = calls.filter("tag = 'attr'")
    none, guess = F.lit(None).cast("string"), F.lit("guess")
    answers.append(attr.filter("base IS NULL").select(*id_, F.lit(1).alias("rule"), none.alias("target"), guess.alias("how")))
    self_ = attr.filter("single AND first IN ('self', 'cls') AND owner IS NOT NULL")
    owned = methods.select(F.col("class").alias("owner"), F.col("method").alias("called"), "target")
    answers.append(self_.join(owned, ["owner", "called"], "left").select(*id_, F.lit(2).alias("rule"), "target", F.lit("is").alias("how")))
    kinds = r.types.select(F.col("name").alias("scope"), F.col("a").alias("first"), F.col("b").alias("type"))
    typed = attr.filter("first NOT IN ('self', 'cls')").join(kinds.select(F.col("scope").alias("src"), "first", F.col("type").alias("t1")), ["src", "first"], "left")
    typed = typed.join(kinds.select(F.col("scope").alias("module"), "first", F.col("type").alias("t2")), ["module", "first"], "left")
    typed = r.class_of(typed.withColumn("type", F.coalesce("t1", "t2")).filter("type IS NOT NULL"), "type", "class")
    of_class = typed.filter("class IS NOT NULL")
    found = of_class.filter("single").join(methods.select("class", F.col("method").alias("called"), "target"), ["class", "called"], "left")
    answers.append(found.select(*id_, F.lit(3).alias("rule"), "target", F.lit("is").alias("how")))
    answers.append(of_class.filter("NOT single").select(*id_, F.lit(3).alias("rule"), none.alias("target"), guess.alias("how")))
    out = typed.filter("class IS NULL").withColumn("local", F.substring_index("type", ".", 1)).join(r.external, ["module", "local"], "left_semi")
    answers.append(out.select(*id_, F.lit(3).alias("rule"), none.alias("target"), F.lit("is").alias("how")))
    sym = attr.filter("single").join(r.symbols.select("module", F.col("local").alias("first"), F.col("target").alias("sym")), ["module", "first"])
    sym = sym.join(r.kinds.select(F.col("target").alias("sym"), "target_kind"), "sym")
    member = sym.filter("target_kind = 'module'").withColumn("target", F.concat_ws(".", "sym", "called")).join(r.kinds.select("target"), "target", "left_semi")
    answers.append(member.select(*id_, F.lit(4).alias("rule"), "target", F.lit("call").alias("how")))
    of_sym = sym.filter("target_kind = 'class'").join(methods.select(F.col("class").alias("sym"), F.col("method").alias("called"), "target"), ["sym", "called"])
    answers.append(of_sym.select(*id_, F.lit(4).alias("rule"), "target", F.lit("is").alias("how")))
    answers.append(sym.select(*id_, F.lit(5).alias("rule"), none.alias("target"), F.lit("is").alias("how")))
    multi = r.module_of(attr.filter("NOT single"), "base", "mod")
    in_mod = multi.filter("mod IS NOT NULL").withColumn("target", F.concat_ws(".", "mod", "called"))
    answers.append(in_mod.join(r.kinds.select("target"), "target", "left_semi").select(*id_, F.lit(6).alias("rule"), "target", F.lit("call").alias("how")))
    answers.append(in_mod.select(*id_, F.lit(7).alias("rule"), none.alias("target"), F.lit("is").alias("how")))
    of_mod = r.module_of(multi.filter("mod IS NULL").drop("mod").withColumn("head", _head(F.col("base"))), "head", "mod")
    of_mod = of_mod.filter("mod IS NOT NULL").withColumn("class", F.concat_ws(".", "mod", _last(F.col("base")))).join(r.kinds.filter("target_kind = 'class'").select(F.col("target").alias("class")), "class")
    of_mod = of_mod.join(methods.select("class", F.col("method").alias("called"), "target"), ["class", "called"], "left")
    answers.append(of_mod.select(*id_, F.lit(8).alias("rule"), "target", F.lit("is").alias("how")))
    answers.append(attr.join(r.external.select("module", F.col("local").alias("first")), ["module", "first"], "left_semi").select(*id_, F.lit(9).alias("rule"), none.alias("target"), F.lit("is").alias("how")))
    answers.append(attr.select(*id_, F.lit(10).alias("rule"), none.alias("target"), guess.alias("how")))
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    first = every.withColumn("k", F.rank().over(W.partitionBy(*id_).orderBy("rule"))).filter("k = 1")
    first = written(first)
    inits = r.kinds.select(F.col("target").alias("init"))
    real = first.filter("target IS NOT NULL").join(r.kinds, "target").withColumn("init", F.when((F.col("target_kind") == "class") & (F.col("how") == "call"), F.concat("target", F.lit(".__init__"))))
    real = real.join(inits.withColumn("has", F.lit(True)), "init", "left").filter("NOT (how = 'call' AND target_kind = 'module')")
    certain = real.select("src", F.when(F.col("has"), F.col("init")).otherwise(F.col("target")).alias("dst")).filter("src <> dst").distinct()
    return certain, first.filter("how = 'guess'").select("src", "called").distinct()


def _nodes(facts: DataFrame) -> DataFrame:
    raw = facts.filter("fact = 'node'").select("name", F.col("a").alias("kind"), F.col("b").alias("module"), F.col("c").alias("owner"), F.col("n").alias("line"), "doc", "file", F.struct("file", "seq").alias("at"))
    # A name defined again keeps its first place and its last definition.
    last = raw.groupBy("name").agg(F.min("at").alias("seq"), F.max_by(F.struct("kind", "module", "owner", "line", "doc", "file"), "at").alias("v"))
    return last.select("name", "v.*", "seq")


def _imported(r: _Resolver) -> DataFrame:
    """``src, dst`` of modules."""
    sub = r.froms.select("module", F.concat_ws(".", F.nullif(F.col("source"), F.lit("")), "original").alias("dotted"))
    deps = r.imports.unionByName(sub).distinct().join(r.modules, "dotted").filter("target <> module")
    return deps.select(F.col("module").alias("src"), F.col("target").alias("dst")).distinct()


def _listed_bases(r: _Resolver) -> DataFrame:
    based = r.class_of(r.base_facts.select("name", "module", F.col("a").alias("expr"), F.col("n").alias("ord")), "expr", "dst")
    return based.filter("dst IS NOT NULL AND dst <> name").select(F.col("name").alias("src"), "dst", "ord")


def _with_guesses(nodes: DataFrame, certain: DataFrame, guesses: DataFrame) -> DataFrame:
    maybe = guessed(nodes, guesses).join(certain, ["src", "dst"], "left_anti")
    return certain.withColumn("certain", F.lit(True)).unionByName(maybe.withColumn("certain", F.lit(False)))


def _with_modules(files: DataFrame) -> DataFrame:
    return spread(files.filter("file IS NOT NULL")).withColumn("module", module_name("file"))


@joined_in_tasks
def build(files: DataFrame) -> CodeGraph:
    """The graph of ``files(file, text)``, computed anew from all of them."""
    facts = written(parsed(_with_modules(files)))
    nodes = written(_nodes(facts))
    r = _Resolver(facts, nodes)
    r.resolve()
    bases = written(_listed_bases(r))
    methods = written(method_table(nodes, bases))
    certain, guesses = _resolved_calls(r, methods)
    guesses = written(guesses)
    return CodeGraph(nodes, written(_with_guesses(nodes, certain, guesses)), written(_imported(r)), bases, facts, r.symbols, r.ends, methods, guesses)


def _lookups(facts: DataFrame) -> DataFrame:
    """``module, part``: every name that a module's facts hold.  A dotted name that finds a module ends with that module's last part."""
    own = facts.filter("fact <> 'node'").select(module_name("file").alias("module"), F.explode(F.split(F.concat_ws(".", "name", "a", "b", "c"), r"\.")).alias("part"))
    return own.distinct()


def _reads(facts: DataFrame, nodes: DataFrame, r: _Resolver) -> DataFrame:
    """``src, dst``: whose tables a module's names may be looked up in: what it imports, and what its dotted expressions may find."""
    by_alias = r.aliases.join(r.modules, F.col("to") == F.col("dotted")).select(F.col("module").alias("src"), F.col("target").alias("dst"))
    by_star = r.stars.join(r.modules, F.col("source") == F.col("dotted")).select(F.col("module").alias("src"), F.col("target").alias("dst"))
    expression = F.when(F.col("fact").isin("call", "type"), F.col("b")).when(F.col("fact") == "base", F.col("a"))
    parts = facts.withColumn("e", expression).filter(F.col("e").contains(".")).select(module_name("file").alias("src"), F.explode(F.split("e", r"\.")).alias("part")).distinct()
    modules = nodes.filter("kind = 'module'").select(F.col("name").alias("dst"), _last(F.col("name")).alias("part"))
    return _imported(r).unionByName(by_alias).unionByName(by_star).unionByName(parts.join(modules, "part").select("src", "dst")).distinct()


def affected_modules(graph: CodeGraph, gone: DataFrame, fresh: DataFrame, r: _Resolver) -> DataFrame:
    """``module`` of all whose names may come to something else when the files ``gone(file)`` give way to the facts ``fresh``.

    These are the changed modules themselves; those that hold the last part of the name of a module that came or went
    (:func:`_lookups`), or lie above it; and all that read from one of them, directly or through others, then or now.
    """
    was = lambda nodes: nodes.filter("kind = 'module'").select(F.col("name").alias("module"))
    touched = gone.select(module_name("file").alias("module")).unionByName(fresh.select(module_name("file").alias("module"))).distinct()
    old, new = was(graph.nodes), was(r.nodes)
    turned = written(old.join(new, "module", "left_anti").unionByName(new.join(old, "module", "left_anti")))
    holding = _lookups(graph.facts).unionByName(_lookups(r.facts)).join(turned.select(_last(F.col("module")).alias("part")).distinct(), "part", "left_semi").select("module")
    parts = F.split("module", r"\.")
    above = turned.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("module"))
    reads = written(_reads(graph.facts, graph.nodes, _Resolver(graph.facts, graph.nodes)).unionByName(_reads(r.facts, r.nodes, r)).distinct())
    reached = frontier = written(touched.unionByName(holding).unionByName(above).distinct())
    while True:
        frontier = reads.join(frontier.select(F.col("module").alias("dst")), "dst", "left_semi").select(F.col("src").alias("module")).distinct()
        frontier = written(frontier.join(reached, "module", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


@joined_in_tasks
def update(graph: CodeGraph, changed: DataFrame | None = None, removed: DataFrame | None = None) -> CodeGraph:
    """``graph`` after the files ``changed(file, text)`` were added or written anew and ``removed(file)`` taken away.

    Only changed files are parsed.  What follows from facts without walking (names, suffixes of modules, absolute imports)
    is one join each and made for all; imports are followed, bases ordered into methods and calls decided for
    :func:`affected_modules` alone, and guesses made again for methods' names that the change has touched.  The result is
    that of :func:`build` over the files as they are then.
    """
    names = [x.select("file") for x in (changed, removed) if x is not None]
    if not names:
        return graph
    gone = written(reduce(DataFrame.unionByName, names).filter("file IS NOT NULL").distinct())
    kept = graph.facts.join(gone, "file", "left_anti")
    fresh = written(parsed(_with_modules(changed))) if changed is not None else graph.facts.filter("false")
    facts = written(kept.unionByName(fresh))
    nodes = written(_nodes(facts))
    r = _Resolver(facts, nodes)
    only = written(affected_modules(graph, gone, fresh, r).distinct())
    r.resolve(only, graph.ends)
    home = nodes.select(F.col("name").alias("src"), "module").join(only, "module", "left_anti").select("src")  # names of modules that stay as they are
    stays = lambda rows: rows.join(home, "src", "left_semi")
    bases = written(stays(graph.bases).unionByName(_listed_bases(r)))
    methods = graph.methods.join(home.withColumnRenamed("src", "class"), "class", "left_semi").unionByName(method_table(nodes, bases, only))
    methods = written(methods)
    certain, guesses = _resolved_calls(r, methods)
    new = written(guesses)
    guesses = written(stays(graph.guesses).unionByName(new))
    method_names = lambda rows, of: rows.join(of, "file", "left_semi").filter("kind = 'method'").select(_last(F.col("name")).alias("called"))
    renamed = written(method_names(graph.nodes, gone).unionByName(method_names(nodes, gone)).distinct())
    old = stays(graph.calls).withColumn("called", _last(F.col("dst")))
    held = old.filter("NOT certain").join(renamed, "called", "left_anti").select("src", "dst", "certain")
    sure = written(stays(graph.calls).filter("certain").select("src", "dst").unionByName(certain))
    again = guesses.join(renamed, "called", "left_semi").unionByName(new).distinct()
    calls = written(_with_guesses(nodes, sure, again).unionByName(held).distinct())
    symbols = graph.symbols.join(only, "module", "left_anti").unionByName(r.symbols)
    return CodeGraph(nodes, calls, written(_imported(r)), bases, facts, written(symbols), r.ends, methods, guesses)
