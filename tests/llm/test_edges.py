"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import ann, chat, decontam, langid, licenses, linedup, minhash, mixing, secret_scan, toxicity
from foliant.llm.components import components

#: Behind the columns of documents: names that operators make, and names that they work with.
WORKING = ("score", "n_near", "taken", "keys", "_id", "_kept", "_lines", "row", "near", "rep", "part", "_text", "size", "item")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_near long, taken long, keys string, _id string, _kept string, _lines string, row string, near string, rep string, part string, _text string, size string, item string"
LONG = "long text with many words " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Null columns, blank, long and repeated texts, a repeated row, and columns that operators make."""
    texts = [(1, "One line of text here.\nAnother line."), (1, "One line of text here.\nAnother line."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "One line of text here.\nA third line."), (6, "12345 !!!"), (7, "One line of text here.\nAnother line.")]
    rows = [(i, t, None if i in (2, None) else "en", None if i in (3, 4) else "s", None, 0.5, 7, 9, *"klmnopqrstu") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_langid(odd, empty):
    model = langid.train(odd)
    got = langid.identify(odd, model).collect()
    assert len(got) == 9
    for r in got:
        letters = r.text and any(c.isalpha() for c in r.text)
        assert r.lang_pred == ("en" if letters else "und") and r.score == (1.0 if letters else 0.0)
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.train(empty)).collect()} == {"und"}


def test_langid_letters_and_long_words(spark, odd):
    """Numerals are no letters; long words count whole, however small their likelihood gets."""
    model = langid.train(odd)
    rows = [(0, "½ ² 10"), (1, "Ⅷ"), (2, "①②"), (3, "x²"), (4, "word" * 5000), (5, "字" * 700)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und"] * 3 + ["en"] * 3 and [got[i].score for i in range(6)] == [0.0] * 3 + [1.0] * 3
    long = "mechanism" * 60
    short = langid.LanguageModel(model.table, ["a"], np.full((1, model.table.size), 1e-4))
    arcs, lengths = short.table.lattice([long])
    logs = np.full(len(long) + 1, -np.inf)
    logs[0] = 0
    for end, (_, starts, pieces) in enumerate(arcs, 1):
        logs[end] = np.logaddexp.reduce(logs[starts] + np.log(short.p[0][pieces]))
    assert short.table.log_forward(arcs, lengths, short.p[0])[0] == pytest.approx(logs[-1])


def test_langid_sums_all_segmentations():
    table = langid.PieceTable.of(["a", "b", "ab", "ba", "aba"])
    p = np.random.default_rng(0).random(table.size)
    number = {x: i for x in ("a", "b", "ab", "ba", "aba") for i in [int(np.searchsorted(table.hashes, langid._prefix_hashes(langid._codes([x])[0])[0, len(x)]))]}

    def brute(w):
        return 1.0 if not w else sum(p[number[w[:k]]] * brute(w[k:]) for k in (1, 2, 3) if w[:k] in number and k <= len(w))

    words = ["abab", "aabba", "b"]
    arcs, lengths = table.lattice(words)
    assert table.forward(arcs, lengths, p)[lengths, np.arange(3)] == pytest.approx([brute(w) for w in words])
    uses = table.expected(arcs, lengths, p, np.ones(3))
    sizes = {i: len(x) for x, i in number.items()}
    assert sum(uses[i] * n for i, n in sizes.items()) == pytest.approx(sum(map(len, words)))


def test_licenses(spark, odd, empty):
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(empty).count() == 0
    mit = dict(licenses.TEMPLATES)["MIT"]
    full = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    df = spark.createDataFrame([(1, "Some words before.\n\n" + full.upper() + "\n\nand after"), (2, "Licenced under the   apache licence, version 2.0"), (None, "Released under the MIT License."), (3, full.replace("free of charge", "for free"))], "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.scan_licenses(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0"), (None, "MIT"), (3, "MIT")} and mit
    assert got[1, "MIT"].unit == "paragraph" and got[3, "MIT"].dice < 1


def test_embedded_licenses(spark):
    """Licences of several paragraphs and wrapped lines in longer documents, and notices in running lines."""
    full = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    parts = full.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    wrapped = "\n".join(" * " + " ".join(parts.split()[i : i + 9]) for i in range(0, len(full.split()), 9))
    notice = "Released under the MIT License."
    before, after = "Some prose stands here first. ", " And more prose follows after it."
    texts = [
        "int a;\n\nMIT License\n\nCopyright (c) 2020 A B\n\n" + parts + "\n\n" + "".join(f"def f{i}(x{i}): return y{i}\n" for i in range(300)),
        "/*\n" + wrapped + "\n */\n" + "".join(f"int g{i}() {{ return z{i}; }}\n" for i in range(300)),
        before + notice + after,
        "\u0130 \u0130 " + before + notice.replace("the MIT", "the\nMIT") + after,
        before + after,
        "the software the " * 5000 + "is provided",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r.license == "MIT" and r.dice == 1 for r in got.values())
    assert [texts[i][got[i].start : got[i].end].replace("\n", " ") for i in (2, 3)] == [notice[:-1]] * 2
    assert texts[0][got[0].start : got[0].end] == parts[:-1]


def test_full_bsd_texts(spark):
    """The whole standard text is one licence, disclaimer and all; the conditions alone still are."""
    start = "Copyright (c) 2020, A B\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    kept = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
    name = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
    end = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    texts = [start + kept + end, start + kept + name + end, start + kept, start + kept + name]
    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    assert [known.sets[known.best(t)[0]][0] for t in texts] == ["BSD-2-Clause", "BSD-3-Clause"] * 2
    assert all(known.best(t)[1] > 0.9 for t in texts)
    rows = list(enumerate([*texts, start.replace("\n\n", ". All rights reserved.\n\n") + kept + name + end]))
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, "BSD-2-Clause"), (1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (3, "BSD-3-Clause"), (4, "BSD-3-Clause")}


def test_full_texts(spark):
    """Full texts are found alone, in code comments and amid other text, each under its own name; versions must agree."""
    every = dict(licenses.every_template())
    names = [*licenses.FULL_TEXTS, "AGPL-3.0"]
    code = "".join(f"def f{i}(x{i}): return y{i}\n" for i in range(200))
    rows = [(name, every[name]) for name in names]
    rows += [(name, code + "".join(f"# {line}\n" for line in every[name].split("\n")) + code) for name in ("Apache-2.0", "MPL-2.0", "GPL-2.0")]
    lesser = "This library is licensed under the GNU Lesser General Public License, version {}."
    rows += [("LGPL-3.0", lesser.format("3")), ("LGPL-2.1", lesser.format("2.1")), (None, lesser.format("4")), ("Proprietary", "We say: all rights reserved."), ("MIT", "All rights reserved. Released under the MIT License.")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {i: set() for i in range(len(rows))}
    for r in licenses.scan_licenses(df).collect():
        got[r.doc_id].add(r.license)
    assert got == {i: {name} if name else set() for i, (name, _) in enumerate(rows)}


def test_best_run():
    """The run found is as good as the best of all runs."""
    known = licenses.Templates((("X", "a b c d e f a c"),), 0.5)
    own = known.sets[0][1]
    rng = np.random.default_rng(3)
    for _ in range(60):
        text = " ".join(rng.choice(list("abcdefgh"), 25))
        words = text.split()
        every = [licenses.bigrams(words[i:j]) for i in range(25) for j in range(i + 2, 26)]
        best = max(2 * len(s & own) / (len(s) + len(own)) for s in every)
        assert [r[1] for r in known.runs(text)] == pytest.approx([best] if best >= 0.5 else [])


def test_mix(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == 9 and mixing.mix(empty).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert {r["size"] for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert sorted(r.taken for r in got if r.doc_id == 1)[0] in (0, 7, 14)


def test_mix_hits_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 91), "a" if i % 3 == 0 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg({"taken": "sum", "size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= r["max(size)"] for r in got)


def test_secrets(spark, odd, empty):
    assert secret_scan.scan(odd).count() == 9 and secret_scan.scan(empty).count() == 0
    key = "Ab3dEf6hIj9kLmNoPq2sTu"
    rows = [(i, f"é {key} x" if i < 5 else "mine Zz9yXx8wVv7uTt6sRr5q and password: 'correct-horse-battery'", f"o{i}") for i in range(6)]
    rows.append((9, " ".join(f"{i:016x}" for i in range(600)), "o9"))
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[i].added and got[i].n_live == 0 for i in range(5))  # held by five owners
    assert [(s.start, s.end) for s in got[5].added] == [(5, 25)] and got[5].n_live == 2
    assert [(s.start, s.end) for s in got[9].base] == [(17 * i, 17 * i + 16) for i in range(600)]


def test_secrets_by_repositories(spark):
    """Two owners make a value a copied example once many repositories hold it; one owner never does."""
    keys = ["Ab3dEf6hIj9kLmNoPq2sTu", "Zz9yXx8wVv7uTt6sRr5q", "Qq1wWw2eEe3rRr4tTt5y"]
    rows = [(i, keys[0], "o1" if i else "o2") for i in range(12)] + [(20 + i, keys[1], "o1" if i else "o2") for i in range(4)] + [(40 + i, keys[2], "o1") for i in range(30)]
    got = {r.doc_id: len(r.added) for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {got[i] for i in range(12)} == {0} and {got[20 + i] for i in range(4)} == {1} and {got[40 + i] for i in range(30)} == {1}


def test_lines(spark, odd, empty):
    got = linedup.drop_repeats(odd).collect()
    assert len(got) == 9 and linedup.drop_repeats(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    # The null id is the earliest; both copies of row 1 stay alike; 7 repeats 1.
    assert by[None] == ["One line of text here.\nA third line."] and by[1] == ["Another line."] * 2 and by[7] == [""]
    assert by[2] == [None] and by[3] == [""] and by[4] == [" \n\t "] and by[5] == [LONG]
    own = [c for c in odd.columns if c not in ("text", "n_near")]
    key = lambda r: str([r[c] for c in own])
    assert sorted(map(key, got)) == sorted(map(key, odd.collect()))


def test_lines_within_one_edit(spark):
    base = "the quick brown fox jumps over it"
    rows = [(1, base), (2, base.replace("quick", "quack")), (3, base + "!"), (4, base[1:]), (5, base.replace("quick", "quite")), (6, "short"), (7, "shirt"), (8, base[:10] + "é" + base[10:])]
    got = {r.doc_id: r.n_near for r in linedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1}


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, rank int, score double"
    rng = np.random.default_rng(0)
    good = [(i, [float(x) for x in rng.normal(size=8)], 1, 1.0) for i in range(60)]
    copies = [(i, good[0][1], 1, 1.0) for i in range(100, 140)]
    bad = [(200, None, 1, 1.0), (201, [0.0] * 8, 1, 1.0), (202, [None] + [1.0] * 7, 1, 1.0), (203, [float("nan")] + [1.0] * 7, 1, 1.0), (204, [float("inf")] + [1.0] * 7, 1, 1.0), (None, [1.0] * 8, 1, 1.0)]
    df = spark.createDataFrame(good + copies + bad + good[:1], schema)
    got = ann.search(df, df.where("vec_id in (0, 200, 203)")).orderBy("rank").collect()
    assert {r.query_id for r in got} == {0}
    q = np.float32(good[0][1]).astype(float)
    want = sorted((-float((np.float32(v).astype(float) * q).sum()), i) for i, v, *_ in good[1:] + copies)[:20]
    assert [r.vec_id for r in got] == [i for _, i in want] and [r.rank for r in got] == list(range(1, 21))
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == 9 and toxicity.score(empty, model).count() == 0
    none = toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect()
    assert all(r.predicted == 0 for r in none)


def test_toxicity_finds_the_sentence():
    model = toxicity.ToxicityModel({"scum": 6.0}, -1.0, -5.0)
    p, found = model.score("All is fine. You are scum! Bye.")
    assert p == pytest.approx(1 - (1 - 1 / (1 + np.exp(-5.0))) / (1 + np.exp(-5.0)))
    assert [("All is fine. You are scum! Bye."[a:b]) for a, b, _ in found] == [" You are scum"]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, window_no int"
    rows = [(1, 0, "system", "be brief <|end|>\n", 5), (1, 1, "user", "~1 [x] </s>", 5)] + [(1, 2 + i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i * 13 % 50), 5) for i in range(60)]
    rows += [(2, 0, None, None, 5), (2, 0, None, None, 5), (3, 0, "system", "only", 5), (None, 1, "assistant", "x", 5), (4, 0, "assistant", "w " * 5000, 5), (4, 1, "as\n|>\nsistant", "y", 5)]
    df = spark.createDataFrame(rows, schema)
    windows = chat.format_chats(df, budget=200, history=50)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    told, loss = {}, {}
    for c, _, role, text, _ in rows:
        told[c] = told.get(c, "") + f"{role or ''}\n{text or ''}\n"
        loss[c] = loss.get(c, "") + ((text or "") if role == "assistant" else "")
    assert {c: r.turns for c, r in back.items()} == told and {c: r.loss_text for c, r in back.items()} == loss
    many = [w for w in windows.collect() if w.conv_id == 1]
    assert len(many) > 5 and all(w.formatted.startswith("<|system|>") for w in many)
    words = lambda s: len(s.split())
    assert all(words(w.formatted) <= 200 and w.tokens <= 200 for w in many) and any(w.context_turns > 1 for w in many)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_budget(spark):
    """No window is over the budget but one with a turn that is so itself, none could take the next turn, and histories are as long as they may be."""
    rng = np.random.default_rng(2)
    sizes = {1: [200, 900], 2: [900, *[90] * 12], 3: [1500, 10, 10], 4: [1, 1200, 300, 1, 700], 5: [20], 6: rng.integers(0, 700, 200).tolist(), 7: rng.integers(0, 60, 300).tolist()}
    system = {2, 4, 5, 7}
    rows = [(c, i, "system" if c in system and not i else "assistant" if i % 2 else "user", "w " * n) for c, ns in sizes.items() for i, n in enumerate(ns)]
    windows = {}
    for w in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window_no").collect():
        windows.setdefault(w.conv_id, []).append(w)
    for c, ns in sizes.items():
        cost = [n + chat.TURN_TOKENS for n in ns]
        head = cost[0] if c in system else 0
        at = int(c in system)
        for w in windows[c]:
            told = [p.split("|>\n")[1].count("w") + chat.TURN_TOKENS for p in w.formatted.split(chat.END)[:-1]]
            assert sum(told) == w.tokens
            back = w.context_turns - (1 if head and w.window_no else 0)
            new = len(told) - w.context_turns - (1 if head and not w.window_no else 0)
            assert told == cost[: 1 if head else 0] + cost[at - back : at + new]
            fresh, past = sum(cost[at : at + new]), sum(cost[at - back : at])
            assert w.tokens <= 1024 or (new == 1 and back == 0)
            assert past <= 256
            before = at - back - 1
            if before >= int(c in system):
                assert past + cost[before] > 256 or w.tokens + cost[before] > 1024
            if at + new < len(cost):
                assert head + min(256, sum(cost[int(c in system) : at])) + fresh + cost[at + new] > 1024
            at += new
        assert at == len(cost)


def test_leaks(spark, odd, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = spark.createDataFrame([(1, item), (2, None), (3, "?!"), (None, "alone words in here")], "item_id long, text string")
    w = item.split()
    docs = spark.createDataFrame(
        [
            (1, "start " + item.upper() + " end"),
            (2, "x " + " ".join(w[:5] + ["ODD"] + w[6:]).replace(" ", ",\n") + " y"),
            (3, " ".join(w[:4] + ["new", "words"] + w[4:9] + w[10:])),
            (4, " ".join(w[::2])),
            (5, "alone words in here"),
            (6, " ".join(w[1:13])),
            (7, "filler " * 50_000 + item),
        ],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(docs, items).collect()}
    assert got == {(1, 1): 0, (2, 1): 1, (3, 1): 3, (5, None): 0, (6, 1): 3, (7, 1): 0}
    assert decontam.find_leaks(docs, items, slice_words=4).count() == len(got)
    assert decontam.find_leaks(empty, items).count() == 0 and decontam.find_leaks(docs, items.limit(0)).count() == 0 and decontam.find_leaks(odd, items).count() == 0


def test_leaks_of_items_that_open_alike(spark):
    """Copies of items of several lengths: windows of all lengths begin at the same word and are clipped to the same stretch."""
    start = ["same", "four", "opening", "words"]
    items = [(i, " ".join(start + [f"i{i}w{j}" for j in range(36 + 2 * i)])) for i in range(8)]
    docs = spark.createDataFrame([*items, (100, items[0][1] + " x y"), (101, items[7][1] + " x y")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i, 0) for i in range(8)} | {(100, 0, 0), (101, 7, 0)}


def edited(rng, words, kind, n):
    """The words with ``n`` edits of one kind, or of any."""
    v = list(words)
    for e in range(n):
        at = int(rng.integers(0, len(v)))
        how = ("delete", "replace", "insert")[int(rng.integers(0, 3))] if kind == "mixed" else kind
        v[at : at + 1] = {"delete": [], "replace": [f"n{e}x{at}"], "insert": [v[at], f"n{e}x{at}"]}[how]
    return v


@pytest.mark.parametrize("kind", ["delete", "replace", "insert", "mixed"])
def test_leak_recall(spark, kind):
    """Copies with as many edits as are allowed, in items of 15 to 250 words, against an alignment of every document with every item."""
    rng = np.random.default_rng(sum(map(ord, kind)))
    sizes = [15, 30, 60, 120, 250]
    items = [(i, [f"c{j}" for j in rng.integers(0, 4000, sizes[i % 5])]) for i in range(40)]
    docs = [(i * 10 + k, ["pad"] * 5 + edited(rng, w, kind, len(w) // 5) + [f"c{j}" for j in rng.integers(0, 4000, 30)]) for i, w in items for k in range(10)]
    got = decontam.find_leaks(*(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id"))))
    found = {(r.doc_id, r.item_id): r.edits for r in got.collect()}
    hashed = [decontam.word_hashes(" ".join(w)) for _, w in items]
    true = {}
    for d, w in docs:
        own = decontam.word_hashes(" ".join(w))
        for i, (e, _, _) in enumerate(decontam.alignments(hashed, [own] * len(items)).tolist()):
            if e <= decontam.bound(len(hashed[i]), 0.2):
                true[d, i] = e
    assert len(true) >= len(docs) and all(true.get(k) == e for k, e in found.items())
    for size in sizes:
        of = [k for k in true if len(items[k[1]][1]) == size]
        assert len([k for k in of if k in found]) >= 0.97 * len(of), size


def test_alignments():
    """The vectorised alignment against the plain recurrence."""
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64) for _ in range(60)]

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            row = _next(row, w, y, i)
        return row[-1]

    def _next(row, w, y, i):
        new = [i]
        for j, v in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (v != w)))
        return new

    for x, y, (e, s, t) in zip(a, b, decontam.alignments(a, b).tolist(), strict=True):
        every = [(edits(x, y[i:j]), j - i, i) for i in range(len(y) + 1) for j in range(i, len(y) + 1)]
        assert (e, t - s, s) == min(every)


def test_near_duplicates(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 9 and minhash.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[7].component_id == 1 and not by[7].kept and by[1].kept
    assert by[2].kept and by[3].n_shingles == 0 and by[None].component_id is None and by[None].kept


def test_near_duplicates_of_one_id(spark):
    """All texts of an id are one document: what either is near to belongs to its component, and repeats of a row change nothing."""
    w = [f"t{i}" for i in range(300)]
    one, two, three = " ".join(w[:100]), " ".join(w[100:200]), " ".join(w[200:])
    rows = [(5, one), (5, two), (5, two), (6, one + " end"), (7, two + " end"), (8, three), (9, three + " end"), (3, two), (8, one + " more")] + [(9, three + " end")] * 700
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 3) for i in (3, 5, 6, 7, 8, 9)}


def test_near_duplicate_chain(spark):
    """A chain of texts each near the next only is one group; its ends are far apart."""
    w = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 8 : i * 8 + 160])) for i in range(20)] + [(100 + i, " ".join(w[:160])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 103: 100}


def test_stages_on_odd_rows(spark, sf, odd):
    for docs in (odd.drop(*WORKING), odd):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, sf)
            if name != "mix_sources":
                assert got.columns == docs.columns, name
            if docs is odd or name == "mix_sources":
                got.count()
            assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.line_dedup(spark, odd, sf).collect()} == {None, 1, 2, 3, 4, 5, 6}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, odd, sf).collect()} == {None, 1, 2, 3, 4, 5, 6}
    assert corpus_pipeline.mix_sources(spark, odd, sf).count() == 9
