"""BPE as a tokenization automaton: compile, encode, decode, count.

Compilation starts from the automaton over single symbols, in which every
symbol may follow every other, and adds one *merge gadget* per merge rule, in
rank order.  A state stands for the token last read.  The gadget of ``u v -> w``

* adds the state ``w``, whose outgoing arcs are those of ``v``;
* deletes the arc ``u -> v`` (the pair no longer survives as two tokens);
* adds ``p -> w`` for each ``p`` that still has the arc ``p -> u``.

After the last rule, a token sequence spells a word's BPE encoding exactly if
all its arcs exist, so each prefix of a word has one last token.  Encoding walks
the word once: a suffix-matching table gives the tokens ending at each byte, the
arc table picks the only one that continues a valid path.  Decoding emits the
arcs' labels.  The walk keeps, for every prefix, its last token and its token
count: :mod:`token_counts` answers truncation questions from them.

The arc table is kept by classes of tokens with equal rows and equal columns
(about 20 MB for 49 k tokens); its size depends on the vocabulary alone, so it
may be broadcast.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession

from lodestone.llm.tables import held

END = "</w>"
#: Words of more bytes take the scalar walk, so that one odd word does not widen a batch.
BATCH_WORD_BYTES = 40
#: Cached words of one Python worker; the cache starts anew beyond it (results do not depend on it).
CACHED_WORDS = 250_000
#: Columns of the arc table unpacked at once (a multiple of 8).
COLUMNS_AT_ONCE = 1024

#: Unicode White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: Letters and numbers of later Unicode versions than the library's, which it takes for neither.
_NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF "
    "1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Capitals that the library lowers and Python does not know: first, last, and the first one's small letter.
_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
_LOWERED = {c: small + c - first for first, last, small in _CAPITALS for c in range(first, last + 1)}
#: Where all of these are: most texts have nothing there, which is seen sooner.
_BEYOND = re.compile("[\u0558-\u1fff\u2070-\u20ff\ua7cb-\uabff\U00010000-\U0010ffff]")
_A_CAPITAL = re.compile("[" + "".join(map(chr, _LOWERED)) + "]")
_NEWER_CLASS = "[" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in _NEWER.split()) + "]"
_A_NEWER = re.compile(_NEWER_CLASS)
_WORDS_BESIDE_NEWER = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--{_NEWER_CLASS}]+|[\p{{N}}--{_NEWER_CLASS}]|(?:[^{_SPACE}\p{{L}}\p{{N}}]|{_NEWER_CLASS})+")
#: str.split() also splits at these, which are not White_Space.
_CONTROLS = re.compile("[\x1c-\x1f]")

#: Marks that are a word of their own after letters at a unit's end.
_STOPS = frozenset(".,;:!?)")


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Automaton:
    """Tables of a compiled vocabulary; token -1 is none."""

    arcs: np.ndarray  # [column class, row class / 8] bits: may the column's token follow the row's?
    row_class: np.ndarray  # [token], of inner tokens
    col_class: np.ndarray  # [token]
    goto: np.ndarray  # [node's row, byte]: suffix-matching transitions
    goto_row: np.ndarray  # [node]; a leaf moves as its longest proper suffix does
    inner: np.ndarray  # [node]: longest inner token that ends here
    final: np.ndarray  # [node]: longest word-final token that ends here
    shorter: np.ndarray  # [token]: next shorter token of its kind that is a suffix of it
    length: np.ndarray  # [token], bytes
    labels: list[bytes]  # [token]: text of the arc, as the vocabulary writes it
    specials: dict[str, int]

    def follows(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        row = self.row_class[before]
        return (self.arcs[self.col_class[token], row >> 3] >> (row & 7).astype(np.uint8)) & 1 == 1


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the distinct rows, and each row's class."""
    seen: dict[bytes, int] = {}
    kind = np.fromiter((seen.setdefault(r.tobytes(), len(seen)) for r in rows), np.int32, len(rows))
    return np.unique(kind, return_index=True)[1], kind


def _supported(spec: dict) -> None:
    """Refuse a vocabulary file whose normaliser, splitting or model is another than the one written here."""
    steps = spec.get("normalizer") or {}
    kinds = [n["type"] for n in steps.get("normalizers", [steps] if steps else [])]
    split = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    model = spec["model"]
    lowered = kinds[:1] == ["NFC"] and kinds[-1:] == ["Lowercase"]
    if not (lowered and split[-1:] == ["ByteLevel"] and model["type"] == "BPE" and model.get("end_of_word_suffix") == END and not model.get("dropout")):
        raise ValueError(f"not a lower-casing byte-level BPE vocabulary with {END}: {kinds}, {split}, {model['type']}")


def compile_automaton(path: str) -> Automaton:
    """Read a word-end BPE vocabulary (tokenizers' JSON) and add its merge gadgets one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _supported(spec)
    model, symbol = spec["model"], byte_symbols()
    vocab: dict[str, int] = model["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *specials.values()]) + 1
    is_final = {t: t.endswith(END) and len(t) > len(END) for t in vocab}
    spelled = {t: bytes(symbol[c] for c in (t[: -len(END)] if is_final[t] else t)) for t in vocab}

    # The gadgets, on bits: follow[c] has the rows (inner tokens) that column c may follow.
    row = {t: i for i, t in enumerate(t for t in vocab if not is_final[t])}
    single = [t for t in vocab if len(spelled[t]) == 1]
    column = {t: i for i, t in enumerate(single)}
    follow = np.zeros((len(vocab), (len(row) + 7) // 8), np.uint8)
    for t in single:
        if not is_final[t]:
            follow[: len(single), row[t] >> 3] |= np.uint8(1 << (row[t] & 7))
    for u, v in merges:
        w, n = u + v, len(column)
        if not is_final[w]:  # arcs out of w: those out of v, before u -> v goes (u may be v)
            out = (follow[:n, row[v] >> 3] >> np.uint8(row[v] & 7)) & np.uint8(1)
            follow[:n, row[w] >> 3] |= out << np.uint8(row[w] & 7)
        follow[column[v], row[u] >> 3] &= np.uint8(~(1 << (row[u] & 7)) & 0xFF)
        column[w] = n
        follow[n] = follow[column[u]]  # arcs into w: those into u
    first, col_kind = _classes(follow)
    follow, some = follow[first], range(0, len(first), COLUMNS_AT_ONCE)
    unpacked = lambda part: np.unpackbits(part, axis=1, count=len(row), bitorder="little")
    first, row_kind = _classes(np.concatenate([np.packbits(unpacked(follow[lo : lo + COLUMNS_AT_ONCE]).T, axis=1) for lo in some], axis=1))
    arcs = np.concatenate([np.packbits(unpacked(follow[lo : lo + COLUMNS_AT_ONCE])[:, first], axis=1, bitorder="little") for lo in some])

    row_class, col_class = np.zeros(size, np.int32), np.zeros(size, np.int32)
    length, labels = np.zeros(size, np.int32), [b""] * size
    for t, i in vocab.items():
        col_class[i], length[i], labels[i] = col_kind[column[t]], len(spelled[t]), t.encode()
        if not is_final[t]:
            row_class[i] = row_kind[row[t]]
    for t, i in specials.items():
        labels[i] = t.encode()

    # Suffix matching: a trie of all spellings, completed breadth first.
    children: list[dict[int, int]] = [{}]
    node_of = {}
    for t, s in spelled.items():
        at = 0
        for b in s:
            nxt = children[at].get(b)
            if nxt is None:
                nxt = children[at][b] = len(children)
                children.append({})
            at = nxt
        node_of[t] = at
    nodes = len(children)
    goto = np.zeros((sum(map(bool, children)), 256), np.int32)
    goto_row, rows_made = np.zeros(nodes, np.int32), 0
    inner, final = np.full(nodes, -1, np.int32), np.full(nodes, -1, np.int32)
    for t, at in node_of.items():
        (final if is_final[t] else inner)[at] = vocab[t]
    fail, shorter = np.zeros(nodes, np.int64), np.full(size, -1, np.int32)
    queue = [0]
    for at in queue:
        if at:
            for table in (inner, final):
                longer = table[at]
                if longer < 0:
                    table[at] = table[fail[at]]
                else:
                    shorter[longer] = table[fail[at]]
        if not children[at]:
            goto_row[at] = goto_row[fail[at]]
            continue
        row_of_at = goto_row[at] = rows_made
        rows_made += 1
        if at:
            goto[row_of_at] = goto[goto_row[fail[at]]]
        for b, to in children[at].items():
            fail[to] = goto[row_of_at, b] if at else 0
            goto[row_of_at, b] = to
            queue.append(to)
    return Automaton(arcs, row_class, col_class, goto, goto_row, inner, final, shorter, length, labels, specials)


_SHIPPED: dict[tuple[str, str], Broadcast] = {}


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The compiled automaton of ``path``, broadcast once per application (bounded by the vocabulary)."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHIPPED:
        _SHIPPED[key] = spark.sparkContext.broadcast(compile_automaton(path))
    return _SHIPPED[key]


def _walk(a: Automaton, word: bytes, every_end: bool) -> tuple[list[int], list[int], list[int]]:
    """Scalar walk over one word: last inner token and inner count of each prefix, closing token of each prefix."""
    last, count, close = [-1], [0], [-1]
    node = 0

    def pick(token: int, at: int) -> int:
        while token >= 0:
            start = at - int(a.length[token])
            if start == 0:
                return token
            r = int(a.row_class[last[start]])
            if last[start] >= 0 and a.arcs[a.col_class[token], r >> 3] >> (r & 7) & 1:
                return token
            token = int(a.shorter[token])
        raise ValueError("the vocabulary cannot spell this word")

    for at, b in enumerate(word, 1):
        node = int(a.goto[a.goto_row[node], b])
        close.append(pick(int(a.final[node]), at) if every_end or at == len(word) else -1)
        token = pick(int(a.inner[node]), at)
        last.append(token)
        count.append(count[at - int(a.length[token])] + 1)
    return last, count, close


def _walk_batch(a: Automaton, words: Sequence[bytes], every_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same walk over many words at once, column by column; rows are ordered as ``words``."""
    n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = int(sizes.max())
    text = np.zeros((n, width), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(sizes) - sizes
    text[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    last, close = np.full((n, width + 1), -1, np.int32), np.full((n, width + 1), -1, np.int32)
    count = np.zeros((n, width + 1), np.int32)
    node = np.zeros(n, np.int64)

    def pick(rows: np.ndarray, token: np.ndarray, at: int, into: np.ndarray) -> None:
        while len(rows):
            start = at - a.length[token]
            before = last[rows, start]
            good = (start == 0) | a.follows(before, token)
            done = rows[good]
            into[done, at] = token[good]
            rows, token = rows[~good], a.shorter[token[~good]]
            if len(token) and token.min() < 0:
                raise ValueError("the vocabulary cannot spell this word")

    for at in range(1, width + 1):
        rows = np.flatnonzero(sizes >= at)
        node[rows] = a.goto[a.goto_row[node[rows]], text[rows, at - 1]]
        ends = rows if every_end else rows[sizes[rows] == at]
        pick(ends, a.final[node[ends]], at, close)
        if not every_end:
            rows = rows[sizes[rows] > at]
        pick(rows, a.inner[node[rows]], at, last)
        count[rows, at] = count[rows, at - a.length[last[rows, at]]] + 1
    return sizes, last, count, close


def encode_words(a: Automaton, words: Sequence[bytes]) -> list[bytes]:
    """Each word's ids as little-endian 32-bit integers."""
    out: list[bytes] = [b""] * len(words)
    short = [i for i, w in enumerate(words) if len(w) <= BATCH_WORD_BYTES]
    if short:
        sizes, last, count, close = _walk_batch(a, [words[i] for i in short], False)
        rows = np.arange(len(short))
        token, at = close[rows, sizes], sizes.copy()
        total = count[rows, sizes - a.length[token]] + 1
        ends = np.cumsum(total)
        ids, slot = np.empty(int(ends[-1]), "<u4"), ends - 1
        while len(rows):
            ids[slot] = token
            at = at - a.length[token]
            more = at > 0
            rows, at, slot = rows[more], at[more], slot[more] - 1
            token = last[rows, at]
        raw, stops = ids.tobytes(), (ends * 4).tolist()
        for i, lo, hi in zip(short, [0, *stops[:-1]], stops, strict=True):
            out[i] = raw[lo:hi]
    for i, word in enumerate(words):
        if len(word) > BATCH_WORD_BYTES:
            last, _, close = _walk(a, word, False)
            token, at, got = close[-1], len(word), []
            while True:
                got.append(token)
                at -= int(a.length[token])
                if at == 0:
                    break
                token = last[at]
            out[i] = np.array(got[::-1], "<u4").tobytes()
    return out


def prefix_counts(a: Automaton, words: Sequence[bytes]) -> list[np.ndarray]:
    """For each word, the token counts of its prefixes of 1, 2, ... bytes, each closed as a word of its own."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    short = [i for i, w in enumerate(words) if len(w) <= BATCH_WORD_BYTES]
    if short:
        sizes, _, count, close = _walk_batch(a, [words[i] for i in short], True)
        at = np.arange(close.shape[1])
        start = np.maximum(at - a.length[close], 0)
        whole = np.take_along_axis(count, start, 1) + 1
        for k, i in enumerate(short):
            out[i] = whole[k, 1 : sizes[k] + 1]
    for i, word in enumerate(words):
        if len(word) > BATCH_WORD_BYTES:
            _, count, close = _walk(a, word, True)
            out[i] = np.array([count[p - int(a.length[close[p]])] + 1 for p in range(1, len(word) + 1)], np.int32)
    return out


def whole_counts(a: Automaton, words: Sequence[bytes]) -> np.ndarray:
    """Token counts of whole words: the last entry of each word's prefix table."""
    out = np.zeros(len(words), np.int64)
    short = [i for i, w in enumerate(words) if len(w) <= BATCH_WORD_BYTES]
    if short:
        sizes, _, count, close = _walk_batch(a, [words[i] for i in short], False)
        rows = np.arange(len(short))
        out[short] = count[rows, sizes - a.length[close[rows, sizes]]] + 1
    for i, word in enumerate(words):
        if len(word) > BATCH_WORD_BYTES:
            _, count, close = _walk(a, word, False)
            out[i] = count[len(word) - int(a.length[close[-1]])] + 1
    return out


def normalise(text: str) -> str:
    """NFC and lower case by character."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower() would write the final form at a word's end
        if _BEYOND.search(text) and _A_CAPITAL.search(text):
            text = text.translate(_LOWERED)
    return text.lower()


def split_words(text: str) -> list[str]:
    """Pre-split one normalised text without special tokens."""
    return (_WORDS_BESIDE_NEWER if not text.isascii() and _BEYOND.search(text) and _A_NEWER.search(text) else _WORDS).findall(text)


class Encoder:
    """Texts to ids.  White space always ends a word, so what stands between white
    space is encoded once and kept in a bounded cache."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.cache: dict[str, bytes] = {}
        names = "|".join(re.escape(t) for t in sorted(automaton.specials, key=len, reverse=True))
        self.special = re.compile(f"({names})") if names else None
        self.starts = {t[0] for t in automaton.specials}
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in automaton.specials.items()}

    def _units(self, text: str) -> list[str]:
        text = normalise(text)
        return split_words(text) if _CONTROLS.search(text) else text.split()

    def parts(self, text: str | None) -> list:
        """Units of the text before the first special token, that token, units after it, and so on."""
        cut = self.special.split(text) if text and any(c in text for c in self.starts) else [text or ""]
        return [p if i % 2 else self._units(p) for i, p in enumerate(cut)]

    def _learn(self, units: set[str]) -> None:
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        missing = units.difference(cache)
        split: dict[str, list[str]] = {}
        words = set()
        for u in missing:
            if u.isalpha():  # one word, as \p{L}+ is
                words.add(u)
            else:
                body, last = u[:-1], u[-1]
                split[u] = ws = [body, last] if body.isalpha() and last in _STOPS else split_words(u)
                words.update(ws)
        todo = sorted(words.difference(cache))
        for lo in range(0, len(todo), 20_000):
            chunk = todo[lo : lo + 20_000]
            cache.update(zip(chunk, encode_words(self.automaton, [w.encode() for w in chunk]), strict=True))
        known = cache.__getitem__
        cache.update([(u, b"".join(map(known, ws))) for u, ws in split.items()])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers; null is the empty text."""
        parts = [self.parts(t) for t in texts]
        self._learn(set().union(*(p for cut in parts for p in cut[::2])))
        known = self.cache.__getitem__
        return [b"".join([self.special_ids[p] if i % 2 else b"".join(map(known, p)) for i, p in enumerate(cut)]) for cut in parts]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs read, joined by spaces (a vocabulary file without a decoder)."""
        return b" ".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


def encoder_of(automaton: Broadcast) -> Encoder:
    """This worker's encoder; it serves many tasks, and so does its cache."""
    return held("encoder", id(automaton.value), lambda: Encoder(automaton.value))


def in_slices(texts: Sequence[str | None], most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a batch that hold about so many characters each, one text at least."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most_chars:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
