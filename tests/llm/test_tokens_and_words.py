"""Spelling variants, byte-pair encoding and tokenizer alignment against brute-force versions, on the table and on odd rows."""

import hashlib
import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import alignment, bpe, spelling
from foliant.llm.queries import QUERIES

WORD_BPE, BYTE_BPE, PIECE_BPE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = "doc_id long, text string, ids string, decoded string, n_links string, word string, n string, `a.b` int"
TEXTS = [
    "Hello hello, don't you'LL 'S 12345 x2y", "<|endoftext|>x<|startoftext|> <|END", "İSTANBUL ΣΑΣ Σς", "é é ﬁ ﬂ", "a\x1cb\x85c\xa0d　e", "😀😀 👩‍👩‍👧 한국어 각각", "ab" * 3000, "  two  blanks\n\n\tand lines \n",
    "▁x a▁b", "<s> hi </s> <0x41> <unk>", "\x00 nul", "क्षत्रिय ཀྵ ไทย", "a" * 40_000, "line\nline \n line", "-- ?! ...", "x " * 20_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, blank and long texts, and columns of the names that operators make."""
    texts = [(None, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[0]), (2, None), (3, ""), (4, " \n\t ")] + [(10 + i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([(i, t, "p", "q", "r", "s", "u", 5) for i, t in texts], ODD)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- spelling variants


def plain_counts(docs):
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(counts):
    alike = defaultdict(set)  # by a place left out, and by itself
    for w in counts:
        for i in range(len(w)):
            alike[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            near[w] |= alike[w[:i], w[i + 1 :]]
            less = w[:i] + w[i + 1 :]
            if less in counts:
                near[w].add(less)
                near[less].add(w)
        near[w].discard(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best and counts[best] >= 10 * n:
            form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), counts[f] if f else None))
    return out


def test_variants_of_the_table(spark, sf):
    got = QUERIES["op11_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_counts(docs))
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) > 10_000 and set(got) == want
    assert sum(f is not None for _, f, *_ in got) > 100


@pytest.mark.parametrize("seed", range(12))
def test_search_schemes(seed):
    """Both directions together find every pair one edit apart, each once, over small and large alphabets."""
    rng = random.Random(seed)
    letters = "abcéüz"[: rng.choice([1, 2, 3, 6])]
    own = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 11))) for _ in range(rng.choice([1, 2, 30, 600]))})
    n = np.array([len(w) for w in own])
    found = []
    for turned, exact in ((lambda w: w, n - n // 2), (lambda w: w[::-1], n // 2)):
        index = spelling.SuffixRanks.of([turned(w) for w in own])
        q, w = index.near([turned(x) for x in own], exact)
        pairs = [(own[i], own[j]) for i, j in zip(q, w, strict=True)]
        assert len(pairs) == len(set(pairs))
        found.append(set(pairs))
    counts = dict.fromkeys(own, 1)
    want = {(w, k) for w, _, _, _, k, _ in plain_variants(counts)}
    assert {(w, len({b for a, b in found[0] | found[1] if a == w})) for w in own} == want
    assert all(b.endswith(a[len(a) // 2 :]) for a, b in found[0]) and all(b.startswith(a[: len(a) // 2]) for a, b in found[1])


def test_variants_in_slices(spark):
    """A bucket too large for one index, where very many words share a half, gives the same rows; chains of forms end at their root."""
    rng = random.Random(5)
    words = {"internati" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6))) for _ in range(1500)} | {"".join(rng.choice("ab") for _ in range(10)) for _ in range(300)}
    counts = {w: rng.choice([2, 3, 20, 300, 4000]) for w in words} | {"chainaa": 2, "chainab": 20, "chainbb": 200, "chainbbc": 2000}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain_variants(counts)
    for bucket in (40_000, 300, 40):
        assert {tuple(r) for r in spelling.variants(table, bucket=bucket).collect()} == want
    assert ("chainaa", "chainab", "chainbbc", 2, 1, 20) in want


def test_variants_of_odd_rows(spark, odd):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    counts = plain_counts(docs)
    assert {tuple(r) for r in spelling.words(odd).collect()} == set(counts.items())
    assert {tuple(r) for r in spelling.variants(spelling.words(odd)).collect()} == plain_variants(counts)
    assert spelling.variants(spelling.words(odd.limit(0))).count() == 0
    ties = {"abcdefg": 50, "abcdefh": 50, "abcdefi": 5, "abcdefij": 5, "a" * 3000: 2, "a" * 3001: 20}
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(list(ties.items()), "word string, n long")).collect()}
    assert got == plain_variants(ties) and ("abcdefi", "abcdefg", "abcdefg", 5, 3, 50) in got


# --- byte-pair encoding


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    t.no_padding()
    return t


def test_round_trip_of_the_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_bpe_round_trip"](spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_round_trip_of_odd_rows(odd, library):
    v = bpe.Vocabulary.read(WORD_BPE)
    done = bpe.decode(bpe.encode(odd, v), v)
    assert sorted(done.columns) == sorted(odd.columns)
    got = done.select("text", "ids", "decoded", "n", "`a.b`").collect()
    assert len(got) == odd.count()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False)), r.text
        assert (r.n, r["a.b"]) == ("u", 5)
    assert bpe.encode(odd.limit(0), v).count() == 0
    at_once = bpe.encode(odd, v, decoded="decoded")
    assert sorted(map(tuple, at_once.select(*(f"`{c}`" for c in done.columns)).collect()), key=str) == sorted(map(tuple, done.collect()), key=str)
    assert [r.decoded for r in bpe.decode(odd.limit(2).select(F.lit(None).cast("array<int>").alias("ids")), v).collect()] == ["", ""]


def test_every_character(library):
    """Alone, within a word and before a mark, as the library has it."""
    encoded = bpe.Remembered(bpe.Encoder(bpe.Vocabulary.read(WORD_BPE)), 10_000)
    for low in range(0, 0x30000, 2048):
        texts = [f"a{c}b {c} {c}{c}́" for c in map(chr, range(low, low + 2048)) if not "\ud800" <= c <= "\udfff"]
        ids, edges = encoded([t.encode() for t in texts])
        for t, i, j, e in zip(texts, edges, edges[1:], library.encode_batch(texts, add_special_tokens=False), strict=False):
            assert ids[i:j].tolist() == e.ids, t


def plain_merges(symbols, by_pair, size):
    """Merge the leftmost lowest-ranked pair, again and again."""
    symbols = list(symbols)
    while True:
        ranked = [(by_pair[a * size + b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a * size + b in by_pair]
        if not ranked:
            return symbols
        i = min(ranked)[1]
        symbols[i : i + 2] = [by_pair[symbols[i] * size + symbols[i + 1]][1]]


@pytest.mark.parametrize("seed", range(8))
def test_segment_tree(seed):
    """Words merged in step, and alone, over rules that overlap at every place."""
    rng = random.Random(seed)
    size, rules = 30, {}
    while len(rules) < 26:
        a, b = rng.randrange(3 + len(rules)), rng.randrange(3 + len(rules))
        rules.setdefault(a * size + b, 3 + len(rules))
    pairs = np.array(list(rules), np.int64)
    order = np.argsort(pairs)
    v = bpe.Vocabulary([str(i) for i in range(size)], np.arange(256), np.arange(256), pairs[order], order, np.array(list(rules.values()), np.int64), {}, r"\w+")
    encoder, by_pair = bpe.Encoder(v), {p: (r, m) for r, (p, m) in enumerate(rules.items())}
    words = [[rng.randrange(3) for _ in range(rng.randint(1, 32))] for _ in range(200)]
    table = np.full((len(words), 32), -1, np.int64)
    for row, w in zip(table, words, strict=True):
        row[: len(w)] = w
    merged = encoder.in_step(table)
    for row, w in zip(merged, words, strict=True):
        want = plain_merges(w, by_pair, size)
        assert row[row >= 0].tolist() == want and encoder.alone(w) == want


# --- alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    with open(BYTE_BPE, encoding="utf-8") as f:
        of = {c: b for b, c in enumerate(bpe.byte_letters())}
        a_bytes = {i: bytes(of[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items()}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in range(b.get_piece_size()) for p in [b.id_to_piece(i)]]
    return a, a_bytes, b, b_bytes


def plain_alignments(texts, both):
    """Numbers, groups and scores of each text, byte by byte."""
    a, a_bytes, b, b_bytes = both
    per = []
    for text in texts:
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if not text or not b"".join(a_bytes[i] for i in x) == b"".join(b_bytes[i] for i in y) == f" {text}".encode():
            per.append(None)
            continue
        a_at, b_at = ([k for k, i in enumerate(ids) for _ in of[i]] for ids, of in ((x, a_bytes), (y, b_bytes)))
        links = [(x[i], y[j]) for i, j in sorted(set(zip(a_at, b_at, strict=True)))]
        groups, ga, gb = [], [], []
        for k, (i, j) in enumerate(zip(a_at, b_at, strict=True)):
            last = k + 1 == len(a_at)
            a_ends, b_ends = last or a_at[k + 1] != i, last or b_at[k + 1] != j
            ga += [x[i]] * a_ends
            gb += [y[j]] * b_ends
            if a_ends and b_ends:
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        per.append((len(x), len(y), groups, links))
    n_docs = Counter(p for t in per if t for p in set(t[3]))
    n_links = Counter(p for t in per if t for p in t[3])
    top = defaultdict(int)
    for (i, _), n in n_docs.items():
        top[i] = max(top[i], n)
    rows = [(len_a, len_b, len(g), len(lk), sum(n_docs[p] == top[p[0]] for p in lk), sum(n_docs[p] for p in lk), ";".join(g)) for len_a, len_b, g, lk in (t or (0, 0, [], []) for t in per)]
    return rows, {(i, j, n, n_links[i, j], n == top[i]) for (i, j), n in n_docs.items()}


def test_alignment_of_the_table(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows, _ = plain_alignments([r.text for r in docs], both)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r.doc_id: tuple(r[c] for c in names) for r in QUERIES["op13_cross_tokenizer"](spark, sf).collect()}
    assert got == {r.doc_id: (*x[:6], digest(x[6]) if x[6] else "") for r, x in zip(docs, rows, strict=True)}


@pytest.mark.parametrize(("few", "most", "remember"), [(500_000, 4_000_000, 300_000), (0, 10, 3)])
def test_alignment_of_odd_rows(odd, both, few, most, remember):
    """Also where chunks are tiny, units are forgotten and counts are joined instead of broadcast."""
    done, pairs = alignment.align(odd.repartition(2), BYTE_BPE, PIECE_BPE, few=few, most=most, remember=remember)
    assert set(done.columns) == (set(odd.columns) - {"text"}) | {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"}
    texts = odd.collect()
    rows, counts = plain_alignments([r.text for r in texts], both)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, int(r.n_links), r.n_best, r.count_sum, r.groups) for r in done.collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, *x) for r, x in zip(texts, rows, strict=True)), key=str)
    assert {tuple(r) for r in pairs.collect()} == counts
    zero = [r for r in done.where("doc_id in (2, 3, 18)").collect()]
    assert len(zero) == 3 and all((r.n_a, r.groups) == (0, "") for r in zero)


def test_alignment_of_nothing(odd):
    done, pairs = alignment.align(odd.limit(0), BYTE_BPE, PIECE_BPE)
    assert done.count() == pairs.count() == 0
    done, pairs = alignment.align(odd.where("doc_id in (2, 3)"), BYTE_BPE, PIECE_BPE)
    assert {(r.n_a, r.count_sum, r.groups) for r in done.collect()} == {(0, 0, "")} and pairs.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bitmaps(seed):
    """Planes give back what they were made of, whether bitmaps are lists or bit sets."""
    rng = np.random.default_rng(seed)
    keys, times = [], []
    for pair in range(40):
        n = int(rng.choice([1, 2, 30, 4095, 4096, 9000]))
        slots = np.sort(rng.choice(alignment.CHUNK, n, replace=False))
        keys.append(pair * 7 << 16 | slots)
        times.append(rng.choice([1, 1, 2, 5, 300], n) if pair % 3 else np.full(n, 4))
    keys, times = np.concatenate(keys), np.concatenate(times)
    pairs, planes = alignment.planes_of(keys, times)
    row, slot, back = alignment.times_of(planes)
    assert (pairs[row] << 16 | slot).tolist() == keys.tolist() and back.tolist() == times.tolist()
    part = planes.slice(3, 20)
    row, slot, back = alignment.times_of(part)
    some = (keys >> 16 >= 21) & (keys >> 16 < 161)
    assert (pairs[row + 3] << 16 | slot).tolist() == keys[some].tolist() and back.tolist() == times[some].tolist()
