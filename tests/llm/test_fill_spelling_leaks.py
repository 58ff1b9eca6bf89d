"""Operators 11 to 13 against brute force, and on null, empty, long, tied, repeated and clashing inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, fill_middle, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = "n long, form string, output string, key long, word string, wid long, h long, found string, `row` int, `a.b` string"


def _rows(texts):
    return [(i, t, 1, "f", "o", 2, "w", 3, 4, "x", 5, "d") for i, t in enumerate(texts)]


# Operator 11


def _fim(key, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if key is None:
        return n, "plain", None, None, text
    hexed = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "ab cd", "<P>", "x <S> y", "<", "<<P", "a<P", "S>b", "é", "éa", "日本語 text", "\U0001f600a\U0001f600", "a\x00b", "word " * 40_000, "z" * 200_000, "é" * 100_000, "a b" * 50_000]
    letters = "abXY Zé日\U0001f600\n<>PSM"
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_fill_middle_equals_brute_force(spark, chunk):
    texts = [t if chunk > 1 or t is None else t[:3000] for t in _texts()]
    rows = _rows(texts) + _rows(texts[:20]) + [(None, *r[1:]) for r in _rows(texts[4:8])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)
    out = fill_middle.transform(df, chunk=chunk)
    got = out.withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((k, *_fim(k, t), t or "") for k, t, *_ in rows)
    assert Counter(map(tuple, got)) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_of_no_rows(spark):
    assert fill_middle.transform(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_cuts_at_slab_borders(monkeypatch, spark):
    monkeypatch.setattr(fill_middle, "SLAB", 64)
    data = "".join(random.Random(1).choice("ab é") for _ in range(3000)).encode()
    chunks = fill_middle._Chunks(np.frombuffer(data, np.uint8), np.array([0, 700, 700, len(data)]) if (data[700] & 0xC0) != 0x80 else np.array([0, 701, 701, len(data)]), 16)
    edges = chunks.edges.tolist()
    for i in range(3):
        text = data[edges[i] : edges[i + 1]].decode()
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert chunks.count()[i] == len(tokens)
        for r in range(len(tokens) + 1):
            head = "".join(tokens[:r])
            assert chunks.cut(i, r) == (edges[i] + len(head.encode()), len(head))


# Operator 12


def _worn(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            if key is not None:
                h = zlib.crc32(f"{key}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts, length=6, occurrences=5, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= occurrences}
    near = {w: [v for v in words if v != w and _near(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def _spelled():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcàÿ") for _ in range(rng.randrange(6, 10))) for _ in range(12)]
    docs = []
    for i in range(400):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + rng.randrange(12)])
            if rng.random() < 0.4:
                at, c = rng.randrange(len(w)), rng.choice("abcàÿ")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and "ÿ" not in w else w)
        docs.append((i, " ".join(words)))
    long = "".join(rng.choice("abc") for _ in range(5000))
    docs += [(1000 + i, f"{long} {long[:2500] + 'x' + long[2501:]}, {long[1:]} {'q' * 3000} {'q' * 2999}") for i in range(6)]
    docs += [(None, "kettling " * 5 + "kettlink " * 30 + "kettlonk " * 160)]
    docs += [(2000, None), (2001, ""), (2002, "12 34"), (None, "abcabcabc " * 7), *docs[:30]]
    return docs


def test_spelling_equals_brute_force(spark):
    docs = _spelled()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, word string, n long").repartition(3)
    counts = _worn(docs)
    assert {tuple(r) for r in spelling.variants(df).collect()} == _variants(counts)
    chains = {w: f for w, f, *_ in _variants(counts) if f}
    assert chains and any(f in chains for f in chains.values()), "the fixture should have a chain of forms"


def test_spelling_hands_on_what_a_task_holds(spark, monkeypatch):
    counter = spelling._Counter(6, 199)
    docs = _spelled()
    counter.add([k for k, _ in docs], [t and t.encode() for _, t in docs])
    got = Counter()
    for batch in counter.counted():
        for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got[w] += n
    want = {w: n for w, n in _worn(docs).items() if len(w) >= 6}
    assert {w: n for w, n in got.items() if n} == want


def test_collisions_of_keys_link_nothing(spark, monkeypatch):
    """With all hashes equal, strings still decide."""
    docs = _spelled()[:120]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    named = spelling.stored(spelling.words(df).withColumn("wid", F.monotonically_increasing_id()))
    want = {tuple(r) for r in spelling.near(named).collect()}
    keys = spelling._keys(named).withColumn("key", F.col("key").bitwiseAND(1))
    monkeypatch.setattr(spelling, "_keys", lambda _: keys)
    assert {tuple(r) for r in spelling.near(named).collect()} == want and want


def test_spelling_of_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Operator 13


def _words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def _leaks(docs, items):
    windows = {}
    for key, text in items:
        w = _words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(key)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = _words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        ids = sorted(str(k) for k in found if k is not None)
        out.append((key, len(w), len(hit), len(ids), ids))
    return sorted(out, key=repr)


def _leaking():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdéñ7") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(8, 40))) for i in range(30)] + [(100, text(1)), (101, text(3)), (102, text(9)), (103, None), (104, ""), (105, "..."), (106, "same " * 30)]
    items += [(200, items[0][1]), (201, items[0][1].upper().replace(" ", ", ")), (None, text(12)), (3, items[4][1])]
    docs = []
    for i in range(200):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(1, 30)]).title() if rng.random() < 0.3 else " ".join(w), text(rng.randrange(6))]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(parts)))
    docs += [(300, None), (301, ""), (302, "!?"), (303, "same " * 5000), (304, "x" * 3_000_000 + " " + items[2][1]), (305, items[0][1] + "\0" + items[1][1]), (None, items[5][1]), docs[0], docs[1]]
    docs += [(400 + i, items[7][1]) for i in range(300)]  # a passage that many hold
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = _leaking()
    df = spark.createDataFrame([(k, t, *r[2:]) for (k, t), r in zip(docs, _rows([None] * len(docs)), strict=True)], f"doc_id long, text string, {CLASHING}").repartition(4)
    bench = spark.createDataFrame([(k, t, "n") for k, t in items], "item_id long, text string, words string").repartition(2)
    got = decontaminate.leaks(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans").collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == _leaks(docs, items)
    for r in got:
        assert sum(s.n for s in r.spans or []) == r.n_hit
    assert 0 < sum(r.n_hit > 0 for r in got) < len(got)


def test_every_long_shared_span_has_its_fingerprint():
    """Winnowing's guarantee: equal runs of ten words have equal fingerprints wherever they stand."""
    rng = random.Random(2)
    shared = " ".join(rng.choice("abcdef") for _ in range(10)).encode()
    alone = decontaminate._Words([shared]).fingerprints(10, 10, 5)
    for _ in range(50):
        before = [rng.choice("abcdef") for _ in range(rng.randrange(20))]
        words = decontaminate._Words([" ".join(before).encode() + b" " + shared + b" f e"])
        assert words.fingerprints(10, 10, 5)[len(before)] == alone[0]


def test_hashing_in_slabs(monkeypatch):
    text = "  ".join("".join(random.Random(i).choice("abé") for _ in range(1 + i % 40)) for i in range(400)).encode()
    whole = decontaminate._Words([text, None, text[:999]])
    monkeypatch.setattr(decontaminate, "SLAB", 16)
    parts = decontaminate._Words([text, None, text[:999]])
    assert (whole.hash == parts.hash).all() and (whole.first == parts.first).all() and len(whole.hash) > 400


@pytest.mark.parametrize("side", ["docs", "items", "both"])
def test_leaks_of_empty_tables(spark, side):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b c")], "doc_id long, item_id long, text string")
    got = decontaminate.leaks(none if side != "items" else some, none if side != "docs" else some).collect()
    assert [tuple(r) for r in got] == ([(1, 3, 0, 0, [], None)] if side == "items" else [])


def test_registered_queries_on_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in decontaminate.op13_benchmark_decontamination(spark, d).collect()}
    for key, n, hit, n_items, ids in _leaks(docs, items):
        assert (got[key].n_words, got[key].n_hit, got[key].n_items, got[key].contaminated) == (n, hit, n_items, hit > 0)
        assert got[key].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert {tuple(r) for r in spelling.op12_spelling_variants(spark, d).collect()} == _variants(_worn(docs))
    texts = dict(docs)
    for r in fill_middle.op11_fill_in_middle(spark, d).collect():
        n, form, a, b, output = _fim(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (n, form, a, b, hashlib.sha256(output.encode()).hexdigest())
        assert r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
