"""Held-out accuracy of the two classifiers, and every pipeline stage on its own input."""

import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import quality, similar_texts, toxicity

DATA = "/root/testdata/sf0.01"


def _accuracy(rows, labels, label):
    pairs = [(r.predicted, labels[r.doc_id][label]) for r in rows if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in pairs) / len(pairs), len(pairs)


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_quality_held_out(spark, labels):
    rows = quality.op1_quality_attention(spark, DATA).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    accuracy, n = _accuracy(rows, labels, "quality")
    assert n > 50
    assert accuracy >= 0.97


def test_attention_by_hand():
    """Encoder, gated attention, weighted sum and score of bags of passages, written out passage by passage."""
    rng = np.random.default_rng(3)
    n, h, a = quality.FEATURES, quality.HIDDEN, quality.ATTENTION
    w = {"W": rng.normal(size=(n, h)), "b": rng.normal(size=h), "V": rng.normal(size=(h, a)), "U": rng.normal(size=(h, a)), "a": rng.normal(size=a), "c": rng.normal(size=h), "d": np.array(0.3)}
    model = quality.Attention(rng.normal(size=n), rng.uniform(0.5, 2, n), w)
    bags = np.array([1, 4, 2])
    x = rng.normal(size=(bags.sum(), n))
    want, at = [], 0
    for size in bags:
        encoded = [np.tanh((p - model.mean) / model.scale @ w["W"] + w["b"]) for p in x[at : at + size]]
        weight = [math.exp(float((np.tanh(e @ w["V"]) / (1 + np.exp(-(e @ w["U"])))) @ w["a"])) for e in encoded]
        z = sum(g * e for g, e in zip(weight, encoded, strict=True)) / sum(weight)
        want.append(1 / (1 + math.exp(-float(z @ w["c"] + w["d"]))))
        at += size
    assert np.allclose(model.score(x, bags), want)


def test_attention_learns_where_to_look():
    """Only one passage of a bag tells the label; the trained weights single it out."""
    rng = np.random.default_rng(4)
    y, bags = rng.integers(0, 2, 300), rng.integers(2, 7, 300)
    x = rng.normal(size=(bags.sum(), quality.FEATURES)) * 0.3
    first = np.cumsum(bags) - bags
    x[first, 0], x[first, 1] = 3.0, np.where(y == 1, 2.0, -2.0)
    model = quality.learn(x[: first[200]], bags[:200], y[:200].astype(float))
    got = model.forward(x[first[200] :], bags[200:])
    assert ((got["p"] > 0.5) == y[200:]).mean() > 0.95
    assert got["att"][first[200:] - first[200]].mean() > 1.5 * (1 / bags[200:]).mean()


def test_posterior_by_hand():
    rng = np.random.default_rng(5)
    model = toxicity.LabelModel(rng.uniform(0.05, 0.4, 5), rng.uniform(0.5, 0.9, 5), np.array([1, 0.5, 0.5, 1, 1]), 0.2)
    votes = rng.integers(0, 2, (20, 5)).astype(float)
    for row, got in zip(votes, model.posterior(votes), strict=True):
        like = []
        for prior, chance in ((0.2, model.toxic), (0.8, model.clean)):
            like.append(prior * math.prod((c if v else 1 - c) ** s for v, c, s in zip(row, chance, model.share, strict=True)))
        assert abs(got - like[0] / sum(like)) < 1e-9


def test_toxicity_held_out(spark, labels):
    rows = toxicity.op9_toxicity_weak_supervision(spark, DATA).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    accuracy, n = _accuracy(rows, labels, "toxic")
    assert n > 40
    assert accuracy >= 0.93


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    rates = [(0.8, 0.05), (0.7, 0.1), (0.6, 0.02)]
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in rates], axis=1)
    votes = np.column_stack([votes, votes[:, 0], ~votes.any(axis=1)]).astype(float)  # a copy of the first voter; none
    model = toxicity.fit_labels(votes, 0.3)
    assert np.allclose(model.toxic[:3], [a for a, _ in rates], atol=0.2)
    assert model.share[0] < 0.7
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_shouting_at_every_length():
    """Over half of all letters, whatever the length, the alphabet and the place of the capitals."""
    fires = lambda t: bool(toxicity.Voters(["x"]).votes(t)[-2])
    for times in (1, 40, 60, 100, 1000):  # 10 to 10,000 characters
        for text, want in (("ABCDEF ghi", True), ("ABCD efghi", False), ("ABC 12 de!", True), ("ÄÖÜ éè 日 ", False), ("ÄÖÜÉ éè -", True), ("A\u0301B c 1 ", True)):
            assert fires(text * times) == want, (text, times)
    assert not fires("Abcdefgh" * 4096) and not fires("") and not fires(None) and not fires("12 34")
    rng = np.random.default_rng(2)
    for n in (5, 300, 3000):
        text = "".join(rng.choice(list("abXYZ éÖß٣日ǅ\n"), n))
        assert toxicity.shouts(text) == (2 * sum(map(str.isupper, text)) > sum(map(str.isalpha, text)))


def test_classifiers_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "idiot", "z"), (1, "z" * 200_000, "w"), (3, "you idiot moron", "v")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    scored = quality.score(docs, quality.train(docs, none)).collect()
    assert [r.score for r in scored] == [1.0] * 5
    model = toxicity.train(docs, none)
    low_high = sorted((r.score >= 0.5) for r in toxicity.score(docs, model).collect())
    assert low_high == [False, False, False, True, True]
    assert sorted(r.score for r in toxicity.accepted(docs, model).collect()) == ["w", "x", "y"]
    for empty in (docs.filter("false"),):
        assert quality.score(empty, None).collect() == []
        assert toxicity.accepted(empty, model).collect() == []


def test_training_takes_each_document_once(spark):
    """A doc_id that fills a third of the table, with equal and with several texts, is one row to learn from."""
    one = spark.range(2000).selectExpr("5L AS doc_id", "'same words' AS text", "1 AS y").union(spark.range(9).selectExpr("5L", "'zz ' || id", "1"))
    docs = one.union(spark.range(10, 4000).selectExpr("id", "CAST(id AS STRING)", "0")).union(spark.createDataFrame([(6, None, 1)], "doc_id long, text string, y int"))
    marks = spark.createDataFrame([(5, 1), (5, 1), (6, 1), (None, 1)], "doc_id long, toxic int").union(spark.range(10, 4000).selectExpr("id", "0"))
    never = F.lit(False)
    rows = quality.training_rows(docs, marks, "toxic", never, 50).collect()
    assert sorted(r.text for r in rows if r.y == 1) == ["", "same words"]
    assert len({r.text for r in rows if r.y == 0}) == len([r for r in rows if r.y == 0]) == 50


def test_voters_are_those_of_the_classifier():
    """Classifiers that follow each other in one worker, each freed before the next: none meets another's voters."""
    word = lambda n: "w" + chr(97 + n % 26) + chr(97 + n // 26 % 26)
    for n in range(300):
        weights = np.zeros(1 + toxicity.PATTERNS)
        weights[0] = 5.0
        shared = SimpleNamespace(value=toxicity.Classifier([word(n)], weights, 0.0))
        without, other, own = toxicity._scores(shared, ["plain", word(n + 1), word(n)])
        assert without == other == 0.5 < own


def _similarity(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_duplicates_of_texts(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    for i in range(20):  # one or two words changed: similarity 0.87 to 0.94
        w = texts[i].split()
        for at in rng.choice(150, 1 + i % 2, replace=False):
            w[at] = "changed"
        texts.append(" ".join(w))
    texts += texts[:5] + ["", None, "  "]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "null key", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = similar_texts.one_of_each_group(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: -1 if i is None else i)
    assert all(_similarity(texts[i], texts[i + 40]) >= 0.8 for i in range(20))
    assert ids == [None, *range(40), 65]


def _kept_by_brute_force(texts):
    """Smallest numbers of the groups of texts linked at similarity 0.8, over all pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and _similarity(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return sorted(set(root))


def test_near_duplicates_among_texts_of_one_template(spark, monkeypatch):
    """Pairs at 0.8 or more among texts of which any two share a long passage; also over several blocks."""
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    passage, texts = word(160), []
    for _ in range(40):
        own = word(40)
        texts += [" ".join(passage + own), " ".join(passage + own[:20] + word(20))]
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    want = _kept_by_brute_force(texts)
    assert len(want) == 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (256, 16):
        monkeypatch.setattr(similar_texts, "BLOCK", block, raising=False)
        assert sorted(r.doc_id for r in similar_texts.one_of_each_group(df).collect()) == want


def test_equal_fingerprints_of_unlike_texts_are_no_link(spark):
    """A word repeated often decides the fingerprint; texts that share nothing else stay, with and without near copies."""
    rng = np.random.default_rng(6)
    texts = [" ".join([f"w{i}" for i in rng.integers(0, 1 << 40, 60)] + ["again"] * 100) for _ in range(12)]
    texts += [texts[i].replace("again", f"x{i} again", 1) for i in (3, 8)] + [texts[4].upper(), "again " * 100, "", "\t"]
    fps = {similar_texts.simhash.fingerprint(similar_texts.simhash.shingle_hashes(t, 5)) for t in texts[:12]}
    assert len(fps) == 1 and max(_similarity(texts[i], texts[0]) for i in range(1, 12)) < 0.05
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = [*range(12), 15, 16]
    assert _kept_by_brute_force(texts[:16]) == want[:-1]
    assert sorted(r.doc_id for r in similar_texts.one_of_each_group(df).collect()) == want


def test_near_duplicates_of_a_whole_table(spark):
    """Against all pairs of all documents: nothing else goes, and nearly all that should."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets, holders = [], {}
    for i, (_, t) in enumerate(rows):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
        for s in sets[-1]:
            holders.setdefault(s, []).append(i)
    root = list(range(len(rows)))
    for i, own in enumerate(sets):
        for j, both in Counter(j for s in own for j in holders[s] if j < i).items():
            if root[i] != root[j] and both >= 0.8 * (len(own) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    want = {rows[i][0] for i in range(len(rows)) if root[i] != i}
    gone = {i for i, _ in rows} - {r.doc_id for r in similar_texts.one_of_each_group(docs).collect()}
    assert gone <= want
    assert len(want) > 50 and len(gone) >= 0.99 * len(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.dtypes, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, seen[-1], DATA))
        if name != "best_fit_packing":
            assert out.dtypes == columns
            assert out.filter("n_chars <> length(text)").isEmpty()
            assert out.join(seen[-1], "doc_id", "left_anti").isEmpty()
        seen.append(out)
    toxic, lines, near, cut, packed = seen[1:]
    assert 850 <= toxic.count() <= 960
    assert lines.count() == toxic.count()
    assert 700 <= near.count() < lines.count()
    assert cut.count() == near.count()
    assert packed.select("doc_id").distinct().count() == cut.count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").isEmpty()


def test_stages_on_odd_tables(spark):
    rows = [(1, None, "en", "s", None), (2, "", None, "s", 0), (None, "a b c", "en", None, 5), (3, "x\ny\nz", "en", "s", 5), (4, "x\ny\nz", "en", "s", 5), (4, "x\ny\nz", "en", "s", 5)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.filter("false")):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, out, DATA))
        assert (out.count() == 0) == docs.isEmpty()
