"""Names over long chains, diamonds and rings; graphs that are updated; the small package in full."""

import random

from lodestone.operators import code_graph, code_parse, code_query
from lodestone.plans.fixtures import package, package_graph

FILES = "file string, text string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _long_and_wide():
    """A chain of a thousand imports, twenty layers of diamonds of bases and of star imports, and rings of both."""
    files = [("n0.py", "def far():\n    pass\n")] + [(f"n{i}.py", f"from n{i - 1} import far\n") for i in range(1, 1000)]
    files += [("end.py", "from n999 import far\n\n\ndef go():\n    far()\n")]
    layers = ["class L0:\n    def deep(self):\n        pass\n", "class R0(L0):\n    pass\n"]
    layers += [f"class {side}{i}(L{i - 1}, R{i - 1}):\n    pass\n" for i in range(1, 20) for side in "LR"]
    files += [("layers.py", "\n".join([*layers, "def go():\n    x = R19()\n    x.deep()\n"]))]
    files += [("s0.py", "def star():\n    pass\n"), ("t0.py", "from s0 import *\n")]
    files += [(f"{side}{i}.py", f"from s{i - 1} import *\nfrom t{i - 1} import *\n") for i in range(1, 20) for side in "st"]
    files += [("sky.py", "from t19 import star\n\n\ndef go():\n    star()\n")]
    files += [("ring.py", "from gnir import lost\n\n\ndef go():\n    lost()\n"), ("gnir.py", "from knot import lost\n"), ("knot.py", "from ring import lost\nfrom ring import *\n"), ("knot.lost.py", "")]
    files += [("circle.py", "class A(B):\n    def a(self):\n        pass\n\n\nclass B(A, C):\n    def b(self):\n        pass\n\n\nclass C:\n    def a(self):\n        pass\n\n    def c(self):\n        pass\n\n\ndef go(x: B):\n    x.a()\n    x.c()\n")]
    return files


def test_long_chains_diamonds_and_rings(spark, monkeypatch):
    steps, real = [], code_graph.written
    monkeypatch.setattr(code_graph, "written", lambda df: steps.append(1) or real(df))
    straight = [f for f in _long_and_wide() if not f[0].startswith("circle")]
    graph = code_graph.build(spark.createDataFrame(straight, FILES).repartition(4))
    assert len(steps) < 120, "rounds grow with the logarithm of a chain"
    calls = {(r.src, r.dst, r.certain) for r in graph.calls.collect()}
    assert calls == {("end.go", "n0.far", True), ("layers.go", "layers.R19", True), ("layers.go", "layers.L0.deep", True), ("sky.go", "s0.star", True)}
    found = {(r.module, r.local): r.target for r in graph.symbols.collect()}
    assert found["ring", "lost"] == "knot.lost", "in a ring the last submodule met holds"
    assert graph.methods.count() == 40
    order = code_graph.base_order(graph.nodes.filter("kind = 'class'").selectExpr("name AS class"), graph.bases)
    assert order.count() <= 40 * 41 // 2, "a row for each class and base, not for each way between them"


def test_bases_in_a_ring(spark):
    files = [f for f in _long_and_wide() if f[0].startswith("circle")]
    graph = code_graph.build(spark.createDataFrame(files, FILES))
    assert {(r["class"], r.method): r.target for r in graph.methods.collect()} == {
        ("circle.A", "a"): "circle.A.a", ("circle.A", "b"): "circle.B.b", ("circle.A", "c"): "circle.C.c",
        ("circle.B", "a"): "circle.A.a", ("circle.B", "b"): "circle.B.b", ("circle.B", "c"): "circle.C.c",
        ("circle.C", "a"): "circle.C.a", ("circle.C", "c"): "circle.C.c",
    }


def _random_files(seed, packages):
    rng, out = random.Random(seed), []
    for p in range(packages):
        mods = [f"p{p}.m{i}" for i in range(5)] + [f"p{p}.m0.x"]
        for m in mods:
            lines = []
            for _ in range(rng.randrange(5)):
                o, n = rng.choice(mods), rng.choice("abcdAB")
                kinds = [f"from {o} import {n}", f"from {o} import {n} as {rng.choice('abcd')}", f"import {o}", f"import {o} as {rng.choice('abcz')}", f"from {o} import *", f"from . import {rng.choice(['m1', 'x'])}", f"from .m{rng.randrange(5)} import {n}", f"from .. import m{rng.randrange(5)}", f"from p{p}.m0 import x"]
                lines.append(rng.choice(kinds))
            lines += [f"def {n}():\n    {rng.choice('abcd')}()\n    {rng.choice('abcd')}.{rng.choice('fgh')}()" for n in "ab" if rng.random() < 0.35]
            for c in "AB":
                if rng.random() < 0.5:
                    base = rng.choice(["", "(A)", "(B)", "(A, B)", "(m1.A)", f"({rng.choice(mods)}.B)"])
                    lines.append(f"class {c}{base}:\n    def {rng.choice('fgh')}(self):\n        self.{rng.choice('fgh')}()\n        {rng.choice(mods)}.{rng.choice('ab')}()")
            lines.append(f"def go(q: {rng.choice(['A', 'B', 'm1.A'])}):\n    v = {rng.choice(['A', 'B', 'a'])}()\n    v.{rng.choice('fgh')}()\n    q.{rng.choice('fgh')}()\n    m1.a()\n    {rng.choice(mods)}.A.f()\n    z.a()")
            out.append((m + ".py", "\n".join(lines) + "\n"))
    return out


def test_updated_graph_equals_a_new_one(spark):
    before, other = dict(_random_files(1, 6)), dict(_random_files(2, 6))
    rng = random.Random(3)
    gone = rng.sample(sorted(before), 4)
    changed = {k: other[k] for k in rng.sample(sorted(set(before) - set(gone)), 4)} | {"p3.m9.py": "def a():\n    pass\n", "p4.m0.x.y.py": "class A:\n    def f(self):\n        pass\n"}
    after = {k: v for k, v in before.items() if k not in gone} | changed
    graph = code_graph.build(spark.createDataFrame(list(before.items()), FILES).repartition(3))
    new = code_graph.update(graph, spark.createDataFrame(list(changed.items()), FILES), spark.createDataFrame([(g,) for g in gone], "file string"))
    full = code_graph.build(spark.createDataFrame(list(after.items()), FILES).repartition(3))
    for name in ("nodes", "calls", "imports", "bases", "symbols", "ends", "methods", "guesses"):
        assert _rows(getattr(new, name)) == _rows(getattr(full, name)), name
    assert _rows(new.calls) != _rows(graph.calls)
    gone_again = code_graph.update(new, removed=spark.createDataFrame([(k,) for k in after], "file string"))
    assert gone_again.nodes.isEmpty() and gone_again.calls.isEmpty() and gone_again.ends.isEmpty()


def test_only_readers_of_a_change_are_resolved_again(spark):
    files = [("a.py", "def f():\n    pass\n"), ("b.py", "from a import f\n"), ("c.py", "from b import f\nf()\n"), ("d.py", "def g():\n    pass\n"), ("e.py", "from d import g\ng()\n")]
    graph = code_graph.build(spark.createDataFrame(files, FILES))
    fresh = spark.createDataFrame([("a.py", "def f():\n    f()\n\n\ndef h():\n    f()\n")], FILES)
    gone = fresh.select("file")
    facts = code_parse.parsed(code_graph._with_modules(fresh))
    every = graph.facts.join(gone, "file", "left_anti").unionByName(facts)
    r = code_graph._Resolver(every, code_graph._nodes(every))
    assert {m.module for m in code_graph.affected_modules(graph, gone, facts, r).collect()} == {"a", "b", "c"}
    calls = {(c.src, c.dst) for c in code_graph.update(graph, fresh).calls.collect()}
    assert calls == {("a.h", "a.f"), ("c", "a.f"), ("e", "d.g")}
    assert code_graph.update(graph) is graph


def test_small_package(spark):
    graph = package_graph(spark)
    assert {(r.src, r.dst, r.certain) for r in graph.calls.collect()} == {
        ("app", "app.main", True), ("app", "zoo.animals.dog.Dog", True), ("app.main", "app.thing", True), ("app.main", "zoo.animals.dog.Dog.fetch", True),
        ("app.main", "zoo.animals.base.register", True), ("app.main", "zoo.animals.cat.Cat", True), ("app.main", "zoo.toys.Ball.roll", False),
        ("zoo.animals.base.Animal.speak", "zoo.animals.base.Animal.noise", True), ("zoo.animals.cat.Cat.groom", "zoo.animals.cat.Cat.noise", True),
        ("zoo.animals.cat.Cat.groom", "zoo.animals.base.Animal.speak", True), ("zoo.animals.dog.Dog.fetch", "zoo.toys.Ball.roll", False),
        ("zoo.animals.dog.Dog.fetch", "zoo.animals.base.register", True), ("zoo.toys.Ball.bounce", "zoo.toys.Ball.roll", True),
        ("zoo.toys.play", "zoo.animals.cat.Cat.groom", True), ("zoo.toys.play", "zoo.animals.cat.Cat", True),
    }
    assert {(r.src, r.dst) for r in graph.imports.collect()} == {
        ("app", "zoo"), ("app", "zoo.animals"), ("zoo", "zoo.animals"), ("zoo", "zoo.animals.base"), ("zoo.animals", "zoo.animals.cat"), ("zoo.animals", "zoo.animals.dog"),
        ("zoo.animals.cat", "zoo.animals.base"), ("zoo.animals.dog", "zoo.animals.base"), ("zoo.toys", "zoo.animals.cat"),
    }
    assert {(r.src, r.dst) for r in graph.bases.collect()} == {("zoo.animals.cat.Cat", "zoo.animals.base.Animal"), ("zoo.animals.dog.Dog", "zoo.animals.base.Animal")}
    found = code_parse.code_chunks(package(spark).filter("file = 'zoo.toys.py'")).orderBy("ord").collect()
    assert [(r.label, len(r.piece)) for r in found] == [("[zoo.toys.py — imports]", 37), ("[zoo.toys.py — class Ball]", 156), ("[zoo.toys.py — function play]", 78)]
    assert {(r.level, r.node) for r in code_query.import_levels(graph, "zoo.animals.base", 3).collect()} == {(1, "zoo"), (1, "zoo.animals.cat"), (1, "zoo.animals.dog"), (2, "app"), (2, "zoo.animals"), (2, "zoo.toys")}
    assert {tuple(r) for r in code_query.report(graph, "zoo.animals.base.register", 3).collect()} == {
        ("header", 0, "function zoo.animals.base.register (zoo.animals.base.py:16)"), ("doc", 0, "Keep an animal."),
        ("affected", 1, "app.main, zoo.animals.dog.Dog.fetch"), ("affected", 2, "app"), ("total", 0, "3 nodes in 2 files"),
    }
    exact = code_query.find_matches(graph.nodes, "Who calls Cat.noise and noise?").collect()
    assert [r.name for r in exact] == ["zoo.animals.cat.Cat.noise"]
