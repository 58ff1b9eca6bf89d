"""The engine's queries against SQL, and its operators on small cases."""

import io
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestone.functions import text as fn
from lodestone.operators import chunking, code_graph, code_query, embedding, hybrid, learners, ml, models, session, store, traversal, vector_search
from lodestone.plans import catalog
from lodestone.plans.fixtures import PACKAGE, package, package_graph
from lodestone.sources import files
from lodestone.streaming.ingest import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["chunk_id", "score", "rank"]


def test_strip_and_windows(spark):
    cases = [(0, ""), (1, "    "), (2, None), (3, "a"), (4, "x" * 650), (5, "x" * 651), (6, "x" * 800), (7, " y" * 1000 + "\n"), (8, "é😀" * 700)]
    df = spark.createDataFrame(cases, "id long, text string")
    got = {i: [] for i, _ in cases}
    for r in chunking.chunked(df, "id").orderBy("id", "ord").collect():
        got[r.id].append((r.start, r.piece))
    for i, t in cases:
        t = (t or "").strip()
        want = [(s, t[s : s + 800].strip()) for s in range(0, len(t), 650)]
        assert got[i] == [w for w in want if w[1]]


def test_windows_of_any_size(spark):
    t = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(1, t)], "id long, text string")
    for size, overlap in ((10, 7), (5, 0), (3, 5)):
        step = max(size - overlap, 1)
        got = [r.piece for r in chunking.chunked(df, "id", size=size, overlap=overlap).orderBy("ord").collect()]
        assert got == [t[s : s + size] for s in range(0, len(t), step)]


def test_markdown_labels(spark):
    t = "intro\n# One\n" + "a " * 400 + "\n## Two\n" + "b " * 400
    rows = chunking.labelled(spark.createDataFrame([("g.md", t), ("p.md", "plain")], "file string, text string"), "file").orderBy("file", "ord").collect()
    assert [r.label for r in rows] == ["[g.md]", "[g.md — One]", "[g.md — Two]", "[p.md]"]
    both = chunking.stored_and_embedded(spark.createDataFrame([("a.py", "[a.py]", "x"), ("b.md", "[b.md]", "y")], "file string, label string, piece string"), "file").collect()
    assert [(r.text, r.embed_text) for r in both] == [("[a.py]\nx", "[a.py]\nx"), ("y", "[b.md]\ny")]


def _mmr(score, u, k, weight):
    chosen = [0]
    while len(chosen) < min(k, len(score)):
        left = [j for j in range(len(score)) if j not in chosen]
        chosen.append(max(left, key=lambda j: (weight * score[j] - (1 - weight) * max(u[j] @ u[i] for i in chosen), -j)))
    return chosen


@pytest.mark.parametrize(("k", "weight"), [(1, 0.7), (4, 0.0), (4, 0.5), (4, 1.0), (9, 0.7)])
def test_mmr(spark, k, weight):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(8, 5))
    u = x / (np.linalg.norm(x, axis=1)[:, None] + 1e-8)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "chunk_id long, normed array<double>")
    query = rng.normal(size=5)
    got = vector_search.search(chunks, "", query.tolist(), top_k=k, min_score=-2, mmr_lambda=weight, boost=False).orderBy("rank").collect()
    score = u @ (query / (np.linalg.norm(query) + 1e-8))
    order = np.lexsort([np.arange(8), -score])
    want = _mmr(score[order], u[order], k, weight)
    assert [r.chunk_id for r in got] == [int(order[j]) for j in want]
    if weight == 1.0:
        assert [r.chunk_id for r in got] == order[:k].tolist()


def test_search_off_topic_and_boost(spark):
    chunks = spark.createDataFrame([(0, "f_x.md", "the red_fox", [1.0, 0.0]), (1, "g.md", "nothing", [1.0, 0.0])], "chunk_id long, file string, text string, normed array<double>")
    assert vector_search.search(chunks, "zzz", [0.0, 1.0]).collect() == []
    assert [(r.chunk_id, round(r.boost, 6)) for r in vector_search.keyword_boost(chunks, "What is RedFox and the fx?").orderBy("chunk_id").collect()] == [(0, 0.06), (1, 0.0)]


def test_embedder_errors(spark):
    class Moody:
        model, dim = "moody", 2

        def embed(self, texts):
            if len(texts) > 1:
                raise RuntimeError("one at a time")
            return np.ones((1, 2))

    assert embedding.embed_batch(Moody(), ["a", "b"]).tolist() == [[1, 1], [1, 1]]
    Moody.dim = 3
    with pytest.raises(ValueError, match="moody"):
        embedding.embed_batch(Moody(), ["a"])
    rows = embedding.embedded(spark.createDataFrame([(1, "a b"), (2, None)], "chunk_id long, embed_text string"), embedding.HashEmbedder()).collect()
    assert [sum(abs(x) for x in r.vector) for r in rows] == [2.0, 0.0]


def test_store(spark):
    a = spark.createDataFrame([(1, "x", "m", 2)], "chunk_id long, file string, model string, dim int")
    b = spark.createDataFrame([(2, "y", "m", 3)], "chunk_id long, file string, model string, dim int")
    with pytest.raises(ValueError, match="one store"):
        store.append(a, b)
    both = store.append(a, b.selectExpr("chunk_id", "file", "model", "2 AS dim"))
    assert store.remove_document(both, "y").collect() == a.collect()
    assert not store.is_empty(both)


def _levels(edges, start, depth):
    seen, frontier, out = {start}, {start: False}, []
    for level in range(1, depth + 1):
        arrivals = {}
        for s, d, c in edges:
            if s in frontier and d not in seen:
                arrivals.setdefault(d, []).append(frontier[s] or not c)
        frontier = {d: all(a) for d, a in arrivals.items()}
        seen |= set(frontier)
        out += [(n, level, u) for n, u in frontier.items()]
    return sorted(out)


def test_traversal(spark):
    rng = np.random.default_rng(0)
    edges = sorted({(f"n{a}", f"n{b}", bool(c)) for a, b, c in zip(*rng.integers(0, 25, (2, 60)), rng.integers(0, 2, 60), strict=True)}, key=str)
    edges = list({(s, d): (s, d, c) for s, d, c in edges}.values())
    df = spark.createDataFrame(edges, "src string, dst string, certain boolean")
    start = spark.createDataFrame([("n0",)], "node string")
    for depth in (0, 1, 3):
        assert sorted(tuple(r) for r in traversal.callees(df, start, depth).collect()) == _levels(edges, "n0", depth)
    back = [(d, s, c) for s, d, c in edges]
    assert sorted(tuple(r) for r in traversal.callers(df, start, 2).collect()) == _levels(back, "n0", 2)


def test_code_graph_without_a_file(spark):
    rest = package(spark).filter("file <> 'zoo.toys.py'")
    graph = code_graph.build(rest)
    calls = {(r.src, r.dst) for r in graph.calls.collect()}
    assert ("app.main", "zoo.animals.dog.Dog.fetch") in calls
    assert not any("zoo.toys" in d for _, d in calls)
    full = {(r.src, r.dst) for r in package_graph(spark).calls.collect()}
    assert calls == {(s, d) for s, d in full if "zoo.toys" not in s + d}


def test_code_reports(spark):
    graph = package_graph(spark)
    (hit,) = code_query.search(graph, "what is the impact of Animal.speak", 3).collect()
    assert hit.node == "zoo.animals.base.Animal.speak"
    assert "calls: zoo.animals.base.Animal.noise" in hit.text
    assert "affected 2: zoo.toys.play" in hit.text
    (hit,) = code_query.search(graph, "describe toys", 3).collect()
    assert "defines: Ball, play" in hit.text
    (hit,) = code_query.search(graph, "Ball", 3, 3).collect()
    assert "methods: roll, bounce" in hit.text
    assert "affected 1: app.main (?), zoo.animals.dog.Dog.fetch (?)" in hit.text
    assert code_query.search(graph, "nothing here", 3).collect() == []
    assert {r.file for r in code_query.file_names(graph).collect()} == set(PACKAGE) - {"broken.py"}
    assert code_query.depth_for("IMPACT of x") == 3
    assert code_query.depth_for("who calls x") == 1


def test_names_over_many_hops(spark):
    """Twelve imports in a row, twelve base classes in a row, packages nested deeper than eight."""
    files = [("deep.py", "from a.b.c.d.e.f.g.h.i.j import far\n\n\ndef go():\n    far()\n"), ("a.b.c.d.e.f.g.h.i.j.py", "from .k import far\n"), ("a.b.c.d.e.f.g.h.i.j.k.py", "def far():\n    pass\n")]
    files += [("m12.py", "def f():\n    pass\n\n\nclass C12:\n    def hello(self):\n        pass\n")]
    files += [(f"m{i}.py", f"from m{i + 1} import C{i + 1}, f\n\n\nclass C{i}(C{i + 1}):\n    pass\n") for i in range(12)]
    files += [("user.py", "from m0 import C0, f\n\n\ndef go():\n    c = C0()\n    f()\n    c.hello()\n")]
    files += [("ring.py", "from gnir import lost\nlost()\n"), ("gnir.py", "from ring import lost\n")]
    calls = {(r.src, r.dst, r.certain) for r in code_graph.build(spark.createDataFrame(files, "file string, text string")).calls.collect()}
    assert calls == {("deep.go", "a.b.c.d.e.f.g.h.i.j.k.far", True), ("user.go", "m0.C0", True), ("user.go", "m12.f", True), ("user.go", "m12.C12.hello", True)}


def test_hybrid(spark):
    def broken():
        raise RuntimeError("down")

    good = lambda: spark.createDataFrame([(1, "s", "t")], "rank int, source string, text string")
    hits = hybrid.hybrid_search({"graph": broken, "vector": good})
    assert hits.errors == ["Graph: down"]
    assert [(r.kind, r.source) for r in hits.rows.collect()] == [("vector", "s")]
    assert hybrid.hybrid_search({"graph": None, "vector": None}).rows is None
    long = spark.createDataFrame([("graph", 1, "g", "x" * 9000), ("vector", 1, "v", "y" * 9000)], "kind string, rank int, source string, text string")
    (row,) = hybrid.build_context(long, 5000).collect()
    assert len(row.context) <= 5000
    assert (row.n_graph, row.n_vector, row.truncated) == (1, 1, True)
    (row,) = hybrid.build_context(long.filter("false"), 5000).collect()
    assert (row.context, row.n_graph, row.truncated) == ("", 0, False)


def test_session(spark):
    rows = [(1, t, "user", "**[GRAPH]** " + "m" * n) for t, n in enumerate([10, 400, 389, 500, 2000])]
    got = session.history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [len(r.content) for r in got] == [10, 400, 389, 401, 2012]
    ticks = iter(range(100))
    assert list(session.throttled(iter("abcd"), interval=2, clock=lambda: next(ticks)))[-1] == "abcd"
    assert list(session.throttled((1 / 0 for _ in "a"))) == ["Error: division by zero"]
    (p,) = spark.range(1).select(session.prompt(*(fn.F.lit(x) for x in ("base", "vector", "ctx", False))).alias("p")).collect()
    assert p.p == "base\n\n" + session.INSTRUCTIONS["vector"] + "\n\nctx\n\n" + session.LANGUAGE


def test_model_list():
    class Client:
        calls = 0

        def list_models(self):
            Client.calls += 1
            if Client.calls > 1:
                raise OSError
            return ["a"]

    now = [0.0]
    held = models.ModelList(Client(), clock=lambda: now[0])
    assert (held.get(), held.get(), Client.calls) == (["a"], ["a"], 1)
    now[0] = 16.0
    assert held.get() == []


def _docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sources_and_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"ok \xff\xc3\xa9")
    (folder / "b.docx").write_bytes(_docx("one", "two"))
    got = {r.file: (r.ext, r.text) for r in files.read_files(spark, str(folder)).collect()}
    assert got == {"a.txt": ("txt", "ok é"), "b.docx": ("docx", "one\ntwo")}
    table, mark = str(tmp_path / "table"), str(tmp_path / "mark")
    to_chunks = lambda texts: chunking.chunked(texts, "file")
    ingest(spark, str(folder), table, mark, to_chunks).awaitTermination()
    (folder / "c.md").write_text("# hi")
    ingest(spark, str(folder), table, mark, to_chunks).awaitTermination()
    assert sorted(r.file for r in spark.read.parquet(table).collect()) == ["a.txt", "b.docx", "c.md"]


def test_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, body in {"r-main/README.md": "hi", "r-main/p/__init__.py": "x = 1", "r-main/p/a.py": " \n", "r-main/q/b.py": "y", "r-main/tests/t.py": "t"}.items():
            z.writestr(name, body)
    assert {(r.file, r.text) for r in files.archive_entries(spark, str(tmp_path / "z.zip"), "p", with_tests=True).collect()} == {("README.md", "hi"), ("p.py", "x = 1"), ("tests.t.py", "t")}


def test_numbers(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(10)], "x double, y double")
    w, b, losses = ml.fit_linear(rows, ["x"], "y", 60, 0.02)
    assert losses[-1] < losses[0] / 50
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.x for r in ml.minmax_scaled(constant, ["x"]).collect()] == [0.0, 0.0]
    assert [r.x for r in ml.standard_scaled(constant, ["x"]).collect()] == [0.0, 0.0]
    points = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5)]) for i in range(10)], "id long, v array<double>")
    start = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [99.0])], "cluster int, centre array<double>")
    assert sorted(round(r.centre[0], 3) for r in ml.kmeans(points, start, "id", "v").collect()) == [2.0, 12.0, 99.0]
    pieces = spark.createDataFrame([(["a", "b", "a", "b"], 3), (["a", "a", "a"], 1)], "symbols array<string>, n long")
    assert ml.fit_merges(pieces, 2)[0] == ("a", "b", "ab")
    assert [r.symbols for r in ml.merged(pieces, "a", "a", "aa").collect()][1] == ["aa", "a"]
    words = spark.createDataFrame([("abab",), ("abc",), ("",), ("ba",)], "word string")
    vocab = spark.createDataFrame([("a",), ("ab",), ("##b",), ("##ab",), ("b",), ("b",)], "piece string")
    found = {r.word: r.pieces for r in ml.wordpiece(words, vocab).collect()}
    assert found == {"abab": ["ab", "##ab"], "abc": ["<unk>"], "": [], "ba": ["<unk>"]}
    many = spark.createDataFrame([(i % 3, i, 1.0) for i in range(300)], "k long, x long, v double")
    assert {(r.k, r.x): r.s for r in ml.running(many, ["x"], {"s": "v"}, ("k",)).collect()} == {(i % 3, i): i // 3 + 1.0 for i in range(300)}
    assert ml.kmeans_start(points, 99, "id", "v").count() == 10


def test_learners(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), int(3 < i < 12)) for i in range(20)], "x double, z double, y int")
    tree = learners.grow_tree(rows, ["x", "z"], "y", depth=2)
    assert (tree.feature, tree.threshold) == ("x", 11.0)
    assert rows.filter(tree.predicted() != rows.y).isEmpty()
    assert learners.grow_tree(rows.filter("false"), ["x"], "y").value == 0.0
    three = rows.withColumn("k", F.when(F.col("x") < 5, 2).when(F.col("x") < 11, 0).otherwise(1))
    assert three.filter(learners.grow_tree(three, ["z", "x"], "k", depth=2).predicted() != three.k).isEmpty()
    numbers = rows.withColumn("v", F.when(F.col("x") < 5, 2.5).otherwise(F.when(F.col("x") < 8, -1.0).otherwise(7.0)))
    assert numbers.filter(learners.grow_tree(numbers, ["z", "x"], "v", depth=2, regression=True).predicted() != numbers.v).isEmpty()
    odd = rows.unionByName(spark.createDataFrame([(None, None, None), (None, 1.0, 1)], rows.schema))
    assert learners.grow_tree(odd, ["x", "z"], "y", depth=2).feature == "x"
    for rule in ("sgd", "momentum", "adagrad", "adam"):
        p = spark.createDataFrame([(0, 0, 4.0, 8.0, 0.0, 0.0)], "i long, j long, v double, g double, m double, s double")
        for step in range(1, 13):
            p = learners.optimised(p, rule, step, 0.4).withColumn("g", 2 * F.col("v"))
        assert abs(p.first().v) < 2.5
    m = spark.range(4000).select(learners.initialised(F.col("id"), F.col("id"), "he", 8, 4, 3).alias("w"))
    assert abs(m.agg(F.stddev("w")).first()[0] - 0.5) < 0.05
    loss = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5])], "t array<double>, p array<double>").agg(learners.one_hot_loss(F.col("t"), F.col("p")).alias("l"))
    assert abs(loss.first().l - 0.6931) < 1e-3
