"""The registered queries against brute-force versions on a small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import decontam, licenses, linedup
from foliant.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).toPandas()


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_accuracy(spark, sf, docs):
    got = rows(spark, sf, "op1_language_id").merge(docs, on="doc_id")
    assert (got["held_out"] == [fold(i, 3) == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"] & got["text"].str.contains("[A-Za-z]") & (got["text"].str.len() > 40)]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_licenses(spark, sf, docs):
    got = rows(spark, sf, "op2_license_scan")
    found = defaultdict(set)
    for r in got.itertuples():
        found[r.license].add(r.doc_id)
    for name, line in (("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0.")):
        assert {d for d, t in zip(docs["doc_id"], docs["text"], strict=True) if line in t.split("\n")} <= found[name]
    assert (got["dice"] >= 0.8).all()
    # Every run of words of the shorter texts against every template.
    known = licenses.Templates(licenses.every_template(), 0.8)
    hits = {(r.doc_id, r.license): r for r in got.itertuples()}
    short = [(d, t) for d, t in zip(docs["doc_id"], docs["text"], strict=True) if 2 <= len(t.split()) <= 110]
    assert len(short) > 100
    for d, text in short:
        words, best = licenses._words(text), {}
        for a in range(len(words) - 1):
            seen, k = set(), defaultdict(int)
            for g in zip(words[a:], words[a + 1 :], strict=False):
                if g not in seen:
                    seen.add(g)
                    for i in known.of.get(g, ()):
                        k[i] += 1
                for i, n in k.items():
                    if known.version[i] <= seen:
                        best[i] = max(best.get(i, 0), 2 * n / (len(seen) + len(known.sets[i][1])))
        want = defaultdict(float)
        for i, dice in best.items():
            if dice >= 0.8:
                want[known.sets[i][0]] = max(want[known.sets[i][0]], dice)
        own = {name: r.dice for (e, name), r in hits.items() if e == d}
        assert bool(own) == bool(want) and all(dice >= want.get(name, 0) - 1e-9 for name, dice in own.items())
        assert all(name in own or max(own.values()) >= dice for name, dice in want.items())


def test_mix(spark, sf, docs):
    got = rows(spark, sf, "op3_mix_sources").merge(docs[["doc_id", "text", "source"]], on="doc_id")
    assert (got["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in got["text"]]).all()
    assert (got["taken"] <= 2 * got["size"]).all()
    total = got["size"].sum()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weight = dict(zip(sorted(by.index), [5, 2, 1] * len(by), strict=False))
    left, share, goal = set(by.index), 1.5 * total, {}
    while True:
        level = share / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * by["size"][s]}
        if not over:
            goal |= {s: level * weight[s] for s in left}
            break
        goal |= {s: 2.0 * by["size"][s] for s in over}
        share -= sum(2.0 * by["size"][s] for s in over)
        left -= over
    for s in by.index:
        assert by["target"][s] == pytest.approx(goal[s])
        assert abs(by["taken"][s] - goal[s]) <= got[got["source"] == s]["size"].max()
    again = rows(spark, sf, "op3_mix_sources")
    assert got[["doc_id", "taken"]].sort_values("doc_id").values.tolist() == again[["doc_id", "taken"]].sort_values("doc_id").values.tolist()


def test_secrets(spark, sf, docs):
    kinds = (
        ("assign", re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    )
    got = rows(spark, sf, "op4_secret_scan").set_index("doc_id")
    for d, text in zip(docs["doc_id"], docs["text"], strict=True):
        spans = [(m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= n]
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got["base_sha256"][d] == hashlib.sha256(told.encode()).hexdigest()
        count = Counter(k for *_, k in spans)
        assert (got["n_assign"][d], got["n_access"][d], got["n_hex"][d]) == tuple(count[k] for k, *_ in kinds)
        assert set(told.split(",")) <= set(got["spans"][d].split(","))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_lines(texts):
    """{id: text} with repeated lines dropped."""
    first, order = {}, []
    for d in sorted(texts):
        for i, line in enumerate((texts[d] or "").split("\n")):
            if line.strip() and line not in first:
                first[line] = (d, i)
                order.append(line)
    keys = defaultdict(list)
    near = set()
    for line in order:  # earliest first
        if len(line) >= 20:
            mine = {line} | {line[:i] + line[i + 1 :] for i in range(len(line))}
            if any(one_edit(o, line) for k in mine for o in keys[k]):
                near.add(line)
            for k in mine:
                keys[k].append(line)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (d, i) and x not in near)) for d, t in texts.items()}


def test_line_dedup(spark, sf, docs):
    got = dict(linedup.drop_repeats(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "text").collect())
    want = brute_lines(dict(zip(docs["doc_id"], docs["text"], strict=True)))
    assert got == want
    assert any(want[d] != t for d, t in zip(docs["doc_id"], docs["text"], strict=True))


def test_neighbours(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(v["embedding"].to_numpy()).astype(float)
    ids = v["vec_id"].to_numpy()
    got = rows(spark, sf, "op6_nearest_neighbours")
    right = total = 0
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q]).sum(1)
        s[ids == q] = -np.inf
        want = {int(ids[i]) for i in np.lexsort((ids, -s))[:20]}
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        right += len(want & set(own["vec_id"]))
        total += 20
    assert right / total >= 0.9


def test_toxicity(spark, sf, docs):
    got = rows(spark, sf, "op7_toxicity")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert len(got) == len(docs) and set(held["doc_id"]) == {i for i in labels["doc_id"] if fold(i, 4) == 2}
    toxic = held["toxic"] == 1
    assert (held["predicted"][~toxic] == 0).mean() > 0.97
    assert held["predicted"][toxic].mean() > 0.7


def test_chat(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    said = "</s>[INST] ok [/INST]"
    all_turns = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in turns.itertuples():
        all_turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    got = rows(spark, sf, "op8_chat_windows").set_index("conv_id")
    assert len(got) == len(all_turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, ts in all_turns.items():
        ts.sort()
        loss = "".join(t for _, r, t in ts if r == "assistant")
        r = got.loc[c]
        assert r["n_turns"] == len(ts)
        assert r["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in ts))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))


def test_leaks(spark, sf, docs):
    got = rows(spark, sf, "op9_decontaminate")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    word = decontam.word_hashes
    exact = set()
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        for i, x in zip(items["item_id"], items["text"], strict=True):
            if x in t:
                exact.add((d, i))
    pairs = {(r.doc_id, r.item_id) for r in got.itertuples()}
    assert exact and exact <= pairs
    by_id = dict(zip(docs["doc_id"], docs["text"], strict=True))
    item = dict(zip(items["item_id"], items["text"], strict=True))
    for r in got.itertuples():
        h = word(by_id[r.doc_id])
        cost = decontam.best_alignment(word(item[r.item_id]), h[r.start : r.end])[0]
        assert cost == r.edits <= 0.2 * r.item_words


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark, sf, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, sf, "op10_near_duplicates").itertuples()}
    assert got == brute_components(dict(zip(docs["doc_id"], docs["text"], strict=True)), 4)


def test_pipeline(spark, sf, docs):
    stages = dict(corpus_pipeline.STAGES)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    clean = stages["toxicity"](spark, d, sf)
    assert clean.columns == d.columns and 0 < clean.count() < len(docs)
    assert stages["line_dedup"](spark, d, sf).columns == d.columns
    parts = brute_components(dict(zip(docs["doc_id"], docs["text"], strict=True)), 5)
    assert {r.doc_id for r in stages["minhash_near_dedup"](spark, d, sf).collect()} == {i for i, (_, c) in parts.items() if c == i}
    assert 0 < stages["benchmark_decontamination"](spark, d, sf).count() < len(docs)
    mixed = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(mixed) < len(docs) and (mixed["taken"] > 0).any()


@pytest.mark.parametrize("name", ["op3_mix_sources", "op4_secret_scan", "op8_chat_windows"])
def test_sql(spark, sf, name):
    from oracle_compare import connect, same

    from foliant.llm.oracles import ORACLES

    assert same(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
