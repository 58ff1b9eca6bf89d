"""Each operator against brute force, and on null, empty, long, tied, repeated and clashing inputs."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import bpe, embedding_dedup, encoding, exact_search, line_dedup, packing, quality, similar_texts, simhash, suffix_dedup, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SHARED = "the quick brown heron walked over the frozen river while nobody at all was watching it from the far bank of stones"


def texts():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(1, 9))) for _ in range(300)]
    body = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    lines = ["\n".join(" ".join(rng.choice(words, 6)) for _ in range(8)) for _ in range(4)]
    out = [*body, body[0], body[1] + " tail", "head " + body[1], body[2] + "\n" + SHARED + "\n" + body[3], SHARED + body[4], *lines, lines[0], "x\n" + lines[1] + "\ny", lines[2] + "\n\n" + lines[2]]
    out += [None, "", "   ", "\n\n", "a", "Ünï cödé Σίσυφος ½ ②  don't '' <|endoftext|> x", "é" * 90, "ab" * 3000, "word " * 4000, "z" * 5000, "日本語 " * 50]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    clashing = "hash long, fp long, spans string, key string, node long, bucket int, gone string, n_lines int, `a.b` string"
    rows = [(i, t, 1, 2, "s", "k", 3, 4, "g", 5, "d") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clashing}").repartition(3)


@pytest.fixture(scope="module")
def awkward(spark, docs):
    """With repeated rows and null keys."""
    return docs.unionByName(docs.filter("doc_id IN (0, 3)")).unionByName(docs.filter("doc_id = 1").selectExpr("CAST(NULL AS LONG) AS doc_id", *(f"`{c}`" for c in docs.columns[1:])))


def test_encoding_equals_the_library(docs):
    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in encoding.round_trip(docs, PATH).collect()}
    for i, t in enumerate(texts()):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_character_equals_the_library():
    """All code points, doubled between letters: classes, case and composition are those of the library."""
    tok, encoder = Tokenizer.from_file(PATH), bpe.Encoder(bpe.compile_automaton(PATH))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 2000):
        block = [f"q{chr(c)}{chr(c)}q" for c in points[lo : lo + 2000]]
        got = encoder.encode(block)
        for unit, mine, theirs in zip(block, got, tok.encode_batch(block, add_special_tokens=False), strict=True):
            assert np.frombuffer(mine, "<u4").tolist() == theirs.ids, ascii(unit)


def test_encoded_ids_decode_again(docs):
    tok = Tokenizer.from_file(PATH)
    ids = encoding.encode(docs, PATH)
    again = {r.doc_id: r.text for r in encoding.decode(ids, PATH).collect()}
    assert again[29] == tok.decode(tok.encode(texts()[29], add_special_tokens=False).ids, skip_special_tokens=False)


ODD = [
    "hello wonderful don't 12", "we're they'll I've 're 'r ''re -'s", "Ünï cödé Σίσυφος ΑΣ ½ ②", "e\u0301a\u0327\u0301 \u0301x a\u0308\u0323 \ud55c \u1112\u1161\u11ab x", "İstanbul ǅ ﬁ ſ",
    "<|endoftext|> a <|startoftext|>b<|endoftext|>", "a\x1cb \x1f c\u2028d\u00a0e", "日本語 テキスト🙂👍🏽 x", "...!!! --'s ;) a1b2", "\t\n  lead", "नमस्ते क्षि", "z" * 90, "",
]


def test_prefix_tables_equal_encoding_each_prefix(spark):
    """Every prefix that a table lists has the count of its own encoding, and all plain characters are listed."""
    tok = Tokenizer.from_file(PATH)
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = token_counts.prefix_table(spark.createDataFrame([*enumerate(ODD), (99, None)], "doc_id long, text string"), PATH).collect()
    for r in rows:
        raw = (ODD[r.doc_id] if r.doc_id < 99 else "").encode()
        assert r.counts == [size(raw[:e].decode()) for e in r.ends], raw
        assert r.ends == sorted(set(r.ends))
        if raw.isascii() and b"<|" not in raw:
            assert r.ends == [i for i, c in enumerate(raw.decode(), 1) if c not in "\t\n "]
    table = token_counts.prefix_table(spark.createDataFrame([(1, ODD[0])], "doc_id long, text string"), PATH)
    (fit,) = table.select(token_counts.longest_within("ends", "counts", 2).alias("n"), token_counts.count_at("ends", "counts", 5).alias("c")).collect()
    assert (fit.n, fit.c) == (15, 1)


def test_token_counts_equal_the_library(spark, awkward):
    tok = Tokenizer.from_file(PATH)
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    for r in token_counts.count_tokens(awkward, PATH).collect():
        t = texts()[1 if r.doc_id is None else r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len((t or "").encode()), size(t))
        assert r.n_tokens > 2048 or (r.fit_bytes, r.fit_tokens) == (r.n_bytes, r.n_tokens)
        assert r.fit_tokens == size((t or "").encode()[: r.fit_bytes].decode()) <= 2048
    odd = spark.createDataFrame([(i, f"{t} {t}", "k", 1) for i, t in enumerate(ODD)], "doc_id long, text string, key string, n_bytes long")
    tables = {r.doc_id: r for r in token_counts.prefix_table(odd, PATH).collect()}
    for budget in (0, 1, 5, 9):
        for r in token_counts.count_tokens(odd, PATH, budget=budget).collect():
            held = tables[r.doc_id]
            want = max([(e, c) for e, c in zip(held.ends, held.counts, strict=True) if c <= budget], default=(0, 0))
            assert (r.fit_bytes, r.fit_tokens) == ((r.n_bytes, r.n_tokens) if r.n_tokens <= budget else want), (budget, ODD[r.doc_id])


def test_packing(spark, awkward):
    tok = Tokenizer.from_file(PATH)
    pieces = packing.cut(awkward, PATH, with_ids=True)
    rows = packing.pack(pieces).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts()):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, a, len(ids[a : a + 2048]), zlib.crc32(struct.pack(f"<{len(ids[a : a + 2048])}I", *ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted(by[i]) == sorted(want * (2 if i in (0, 3) else 1))
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(placed) <= -(-sum(r.length for r in rows) // 2048) + 1
    whole = packing.assemble(pieces, spark.createDataFrame(rows)).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole)


def test_packing_rows_without_ids(spark):
    """Equal pieces without id are dealt to all buckets, and assembled."""
    n = 60_000
    same = spark.range(n).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "7L AS length", "1L AS ids_crc32")
    packed = packing.pack(same)
    per = packed.selectExpr("sequence_id >> 32 AS b").groupBy("b").count().collect()
    assert len(per) == 4 and max(r["count"] for r in per) < packing.BUCKET_PIECES and sum(r["count"] for r in per) == n
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "d"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    pieces = packing.cut(df, PATH, with_ids=True)
    whole = packing.assemble(pieces, packing.pack(pieces)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(r.length for r in whole) == 4 * 4 + 2


def test_packing_many_lengths():
    rng = np.random.default_rng(0)
    lengths = np.concatenate([rng.integers(1, 2049, 3000), np.full(50, 2048), np.full(50, 1)])
    sequence, offset = packing.pack_lengths(lengths)
    for s in np.unique(sequence):
        own = np.flatnonzero(sequence == s)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()
        assert lengths[own].sum() <= 2048
    assert len(np.unique(sequence)) <= 1.03 * lengths.sum() / 2048 + 1


def _brute_line_dedup(rows):
    seen, out = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for a, b in zip(at, at[1:], strict=False):
            pair = (lines[a].strip(" "), lines[b].strip(" "))
            gone |= {a, b} if pair in seen else set()
            seen.add(pair)
        for a in at:
            line = lines[a].strip(" ")
            gone |= {a} if len(line) >= 40 and line in seen else set()
            seen.add(line)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(awkward):
    want = _brute_line_dedup(list(enumerate(texts())))
    got = line_dedup.remove_repeated_lines(awkward)
    assert got.columns == [*(c for c in awkward.columns if c != "n_lines"), "n_lines", "n_removed"]
    rows = got.collect()
    assert len(rows) == len(texts()) + 3
    for r in rows:
        if r.doc_id is None:
            assert r.text == texts()[1]
        else:
            assert (r.text or "") == want[r.doc_id]


def test_line_dedup_of_single_long_lines(spark):
    """A long line between different ones goes where it stands again; short ones and the first stay."""
    long, other = "licence " * 40, "é" * 299
    rows = [(5, f"a\n {long}\nb"), (2, f"c\n{long}\nd\n{long}"), (3, f"{other}\ne\nf"), (4, f"g\n{other}\nh\ne\nf"), (6, f"{long}x"), (7, None), (None, long), (8, long)]
    want = {2: f"c\n{long}\nd", 3: rows[2][1], 4: f"g\n{other}\nh", 5: "a\nb", 6: f"{long}x", 7: None, None: long, 8: ""}
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3)
    got = line_dedup.remove_repeated_lines(df, alone=300)
    assert [dict(zip(got.columns, r, strict=True)) for r in got.filter("doc_id = 4").collect()] == [{"doc_id": 4, "text": want[4], "n_lines": 5, "n_removed": 2}]
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == 9 and dict(found) == want
    kept = corpus_pipeline.drop_repeated_lines(spark, df, "")
    assert {r.doc_id: r.text for r in kept.collect()} == want | {4: "g\nh"}
    assert "Python" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_winnowing_finds_all_runs(spark, run):
    """Runs of few different lines, so that fingerprints tie and matches overlap; longer windows too."""
    rng = np.random.default_rng(run)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " d "], rng.integers(0, 14)))) for i in range(60)]
    seen, want = set(), {}
    for i, t in rows:
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for k in range(len(at) - run + 1):
            window = tuple(lines[j].strip() for j in at[k : k + run])
            gone |= set(at[k : k + run]) if window in seen else set()
            seen.add(window)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), run=run, alone=None)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_ids_of_several_texts_are_left_alone(spark):
    """A doc_id that names different texts takes no part, in any operator that keeps positions or classes by it."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"{long}\n{long}x"), (2, f"{long}\n{long}x"), (2, "other text of this id"), (3, f"{long}\n{long}x"), (3, f"{long}\n{long}x"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted((r.doc_id, r.text or "") for r in df.collect())
    lines = sorted((r.doc_id, r.text or "") for r in line_dedup.remove_repeated_lines(df).collect())
    assert lines == [x if x[0] != 3 else (3, "") for x in whole]
    cut = sorted((r.doc_id, r.text or "") for r in suffix_dedup.cut_repeats(df).collect())
    assert [x for x in cut if x[0] in (2, 4)] == [x for x in whole if x[0] in (2, 4)]
    assert all(len(t) < 100 for i, t in cut if i == 3)
    assert sorted((r.doc_id, r.text or "") for r in similar_texts.one_of_each_group(df).collect()) == [whole[0], *(x for x in whole if x[0] in (2, 4))]


def test_line_dedup_uses_no_python(docs):
    plan = line_dedup.remove_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _brute_spans(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p] += 1
                gone[p + 100] -= 1
            seen.add(b[p : p + 100])
        out[i] = np.cumsum(gone)[: len(b)] > 0
    return out


def test_suffix_dedup(docs):
    want = _brute_spans(list(enumerate(texts())))
    for r in suffix_dedup.remove_repeats(docs).collect():
        b, gone = (texts()[r.doc_id] or "").encode(), want[r.doc_id]
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), runs), r
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_dedup_hot_passages(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    rows = [(i, " ".join(word() for _ in range(12)) + SHARED * 2 + " ".join(word() for _ in range(12))) for i in range(60)]
    want = _brute_spans(rows)
    monkeypatch.setattr(suffix_dedup, "BATCH_SUFFIXES", 64)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: int(g.sum()) for i, g in want.items()}


@pytest.mark.parametrize("crowded", [8192, 20, 1])
def test_suffix_dedup_of_periodic_and_crowded_texts(spark, monkeypatch, crowded):
    """Periods 1, 2, 7 and 100, alone and between other bytes; hashes with more blocks than a bucket takes."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    period = word(100)
    rows = ["z" * 700, "ab" * 300, "abcdefg" * 90, period * 5, word(80) + "z" * 300 + word(80), word(50) + "ab" * 200, "ab" * 130 + word(70), period * 3 + word(60), word(130) + period[3:] * 2]
    rows += [word(60) + SHARED + word(60) for _ in range(30)] + [word(30) + "-" * n + word(30) for n in (99, 100, 101, 150, 260)]
    rows = list(enumerate(rows))
    monkeypatch.setattr(suffix_dedup, "BATCH_SUFFIXES", 64)
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", 1000)
    want = _brute_spans(rows)
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        b, gone = rows[r.doc_id][1].encode(), want[r.doc_id]
        assert r.n_removed == int(gone.sum()), rows[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def test_suffix_dedup_sends_no_texts_through_the_driver(spark, monkeypatch):
    """Files say little of the size of texts, windows and spans as rows; only hashes may be broadcast."""
    rows = [(i, chr(65 + i) + "a" * 150 + SHARED) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bodies = df.select(F.lit(1).cast("long").alias("hash"), "doc_id", F.lit(0).cast("long").alias("first"), F.col("text").cast("binary").alias("body"))
    monkeypatch.setattr(suffix_dedup, "CROWDED", 1)
    index, repeats = suffix_dedup._of_crowded(bodies, 100)
    assert index.count() == 0 and {r.doc_id for r in repeats.collect()} == set(range(12))
    _, later = suffix_dedup._split_hot(bodies.select("hash", "doc_id", F.col("first").alias("lo"), F.octet_length("body").cast("long").alias("hi"), "body"))
    for found in (repeats, later, suffix_dedup.with_spans(df)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert all("bigint" in x for x in re.findall(r"BroadcastExchange [^\n]*", plan)), plan
    want = _brute_spans(rows)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == {i: int(g.sum()) for i, g in want.items()}


def test_suffix_dedup_sends_a_bounded_number_of_hot_grams(spark, monkeypatch):
    """Whatever the texts share; those in the most documents, and the others are found all the same."""
    rows = [(i, SHARED + " " + (SHARED[::-1] if i % 2 else "") + str(i) * 120) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(suffix_dedup._hot_grams(df, 24, 40).hashes) > 50
    monkeypatch.setattr(suffix_dedup, "HOT_GRAMS", 50)
    some = suffix_dedup._hot_grams(df, 24, 40).hashes
    first = suffix_dedup._gram_hashes(np.frombuffer((SHARED + " ").encode(), np.uint8), 24)
    assert len(some) == 50 and set(some.tolist()) <= set(first.tolist())
    want = _brute_spans(rows)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()} == {i: int(g.sum()) for i, g in want.items()}


def test_texts_of_several_megabytes(spark):
    """Beyond the size at which texts are read in parts: the same blocks, passages and bytes as of the whole."""
    rng = np.random.default_rng(11)
    words = np.array(["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(1, 12, 5000)])
    text = " ".join(rng.choice(words, 900_000)) + " AA|1 " + "x" * 70_000 + " " + " ".join(rng.choice(words, 30_000))
    raw = text.encode()
    assert len(raw) > 5 << 20
    whole = suffix_dedup._joined(suffix_dedup._blocks([raw], 100, 24, suffix_dedup.HotGrams(np.zeros(0, np.int64))))
    for a, b in zip(whole, suffix_dedup.blocks([raw], 100, 24, suffix_dedup.HotGrams(np.zeros(0, np.int64))), strict=True):
        if a is not whole[-1]:
            inside = set(a.tolist())
            assert len(set(b.tolist()) - inside) <= 12  # halves of blocks at the borders
    x, bags = quality._passages([raw])
    y, parts = quality.passages([raw, b""])
    assert (bags[0], 1) == tuple(parts)
    assert np.array_equal(x, y[: bags[0]])
    part = text[1_000_003:1_000_203]
    df = spark.createDataFrame([(1, text), (2, "so " + part + " it is"), (3, "z" * 1_500_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[2].n_removed == 200 and got[2].n_spans == 1
    assert got[3].n_removed == 1_500_000 - 100 + 99
    assert got[1].n_bytes == len(raw)


def test_suffix_dedup_keeps_columns_and_characters(awkward):
    rows = suffix_dedup.cut_repeats(awkward).collect()
    assert rows[0].asDict().keys() == dict.fromkeys(awkward.columns).keys()
    assert len(rows) == len(texts()) + 3
    null = texts().index(None)
    assert {r.doc_id: r.text for r in rows if r.doc_id in (null, null + 1)} == {null: None, null + 1: ""}


def test_suffix_levels():
    rng = np.random.default_rng(1)
    levels, seen = suffix_dedup.SuffixLevels(), set()
    for _ in range(9):
        batch = np.array(["".join(rng.choice(list("ab"), 5)).encode() for _ in range(7)], "S5")
        want = [x in seen or seen.add(x) is not None for x in batch.tolist()]
        assert levels.add(batch).tolist() == want
    weights = [w for w, _ in levels.levels]
    assert weights == sorted(set(weights), reverse=True)
    assert sum(weights) == 9


def _fingerprint(t, words):
    w = (t or "").encode().translate(LOWER).split()
    shingles = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def _least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(texts()) + 2
    want = {i: _fingerprint(t, 3) for i, t in enumerate(texts())}
    for r in rows:
        assert r.fp % (1 << 64) == want[r.doc_id]
    pairs = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 2]
    reach = _least_reachable(want, pairs)
    assert {r.doc_id: r.component_id for r in rows} == reach


def test_simhash_links_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 500, dtype=np.int64)
    near = fps[:300] ^ (1 << rng.integers(0, 60, 300)) ^ (1 << rng.integers(0, 60, 300))
    chain = np.bitwise_xor.accumulate(np.concatenate([[7], 1 << np.arange(40, dtype=np.int64)]))
    every = np.unique(np.concatenate([fps, near, chain]))
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rows = [(int(f), i) for i, f in enumerate(every.tolist())]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, node long")).collect()
    pairs = [(i, int(j)) for i in range(len(every)) for j in np.flatnonzero(np.bitwise_count(every[i] ^ every) <= 2)]
    nodes = range(len(every))
    assert _least_reachable(nodes, [(e.a, e.b) for e in edges]) == _least_reachable(nodes, pairs)


def test_exact_search_with_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(120)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(120, 160)]
    rows += [(500, None), (600, []), (700, [1.0, None, 0.0, 0.0]), (800, [float("nan"), 0.0, 0.0, 0.0]), (900, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    valid = table.filter(F.col("vec_id").isNotNull() & exact_search.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), exact_search.quantised(F.col("embedding")).alias("terms"))
    assert valid.count() == 160
    got = defaultdict(list)
    for r in exact_search.top_k(valid.filter("id % 20 = 0"), valid, 10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = np.floor(np.array([v for _, v in rows[:160]]) * 1024).astype(np.int64)
    for q in range(0, 160, 20):
        score = x @ x[q]
        order = [j for j in np.lexsort([np.arange(160), -score]) if j != q][:10]
        assert sorted(got[q]) == [(n + 1, int(j), int(score[j])) for n, j in enumerate(order)]


def test_exact_search_in_blocks(spark, monkeypatch):
    """Many blocks of queries and candidates, terms of different numbers, clashing names, repeated ids, scores beyond 64 bits."""
    monkeypatch.setattr(exact_search, "QUERY_BYTES", 200)
    monkeypatch.setattr(exact_search, "CANDIDATES_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-5, 6, rng.integers(1, 5))], 1, "q") for i in range(60)] + [(7, [4, 4], 2, "again"), (60, [1 << 62], 3, "wide")]
    table = spark.createDataFrame(rows, "id long, terms array<long>, score int, query_id string").repartition(5)
    got = defaultdict(list)
    for r in exact_search.top_k(table.filter("id % 6 = 0"), table, 4).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    bound = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    for q, terms, *_ in rows:
        if q % 6 == 0:
            scores = sorted(((-bound(sum(a * b for a, b in zip(terms, t, strict=False))), i) for i, t, *_ in rows if i != q))[:4]
            assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 32))
    x = np.concatenate([np.repeat(base, 8, 0) + rng.normal(size=(160, 32)) * rng.uniform(0, 0.4, (160, 1)), rng.normal(size=(200, 32)), np.repeat(base[:1], 12, 0)])
    bad = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] * 32), (1003, []), (1004, [1.0, None]), (1005, [3.0, 4.0])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    want = linked.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all()
    assert found.sum() >= 0.9 * want.sum()
    assert {got[i].component_id for i in range(372 - 12, 372)} == {got[0].component_id}
    for i, _ in bad:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


@pytest.mark.parametrize("block", [16, 64])
def test_embedding_near_duplicates_in_crowded_buckets(spark, monkeypatch, block):
    """Tight groups, groups beside one another, and loose vectors: counts as by brute force where a table meets the pair."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    a, b = rng.normal(size=(2, 24))
    near = lambda c, n, s: c + rng.normal(size=(n, 24)) * s
    x = np.concatenate([near(a, 150, 0.05), near(a + 0.12 * b, 80, 0.08), near(b, 100, 0.2), near(-a, 90, 0.35), rng.normal(size=(60, 24))])
    rows = [(i, v.tolist(), "c", 1) for i, v in enumerate(x)] + [(3, x[3].tolist(), "again", 2), (3, None, "null", 3), (None, x[0].tolist(), "n", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid string, size int").repartition(3)
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) - 1
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    want = linked.sum(axis=1) - 1 + linked[:, 3]
    found = {r.vec_id: r.n_links for r in got if not (r.vec_id == 3 and r.n_links == 0)}
    n = np.array([found[i] for i in range(len(x))])
    assert (n <= want).all()
    assert n.sum() >= 0.95 * want.sum()
    assert (n[:150] >= 149).all()
    reach = _least_reachable(range(len(x)), zip(*np.nonzero(np.triu(linked, 1)), strict=True))
    assert {r.vec_id: r.component_id for r in got if r.vec_id < 150 and r.n_links} == {i: reach[i] for i in range(150)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for df in (
        encoding.round_trip(none, PATH),
        token_counts.count_tokens(none, PATH),
        packing.pack(packing.cut(none, PATH)),
        line_dedup.remove_repeated_lines(none),
        suffix_dedup.remove_repeats(none),
        simhash.near_duplicates(none),
        embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert df.collect() == []
    terms = spark.createDataFrame([], "id long, terms array<long>")
    assert exact_search.top_k(terms, terms).collect() == []


def test_automaton_on_random_words():
    rng = np.random.default_rng(9)
    automaton, tok = bpe.compile_automaton(PATH), Tokenizer.from_file(PATH)
    letters = list("aaabcdeeefghiiijklmnooopqrstuuuvwxyzzß")
    words = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(1500)] + ["a" * n for n in range(1, 120)]
    for word, ids in zip(words, bpe.encode_words(automaton, [w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(word, add_special_tokens=False).ids


def test_workers_forget_what_tasks_do_not_use(docs, spark):
    """An encoder outlives a task that uses it, and not one that does not."""
    from lodestone.llm import tables

    def holding(batch):
        yield pa.RecordBatch.from_arrays([pa.array(sorted(tables._HELD), pa.string())], ["name"])
        yield pa.RecordBatch.from_arrays([pa.array(["then", *sorted(tables._HELD)], pa.string())], ["name"])

    one = docs.coalesce(1)
    encoding.encode(one, PATH).count()
    names = [r.name for r in tables.map_rows(one.select("doc_id").limit(1), holding, "name string").collect()]
    assert names == ["then"] or names == ["encoder", "then"]
