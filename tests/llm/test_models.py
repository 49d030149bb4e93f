"""The queries whose models are trained, against plain versions that use the same model: every segmentation, every sentence."""

import math
import re

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import langid, toxicity
from foliant.llm.common import fold
from foliant.llm.queries import QUERIES


def segmentations(word, pieces, unknown):
    """The probabilities of all ways to cut a word into pieces; a lone character may always be one."""
    if not word:
        yield 1.0
        return
    for n in range(1, min(len(word), langid.LONGEST_PIECE) + 1):
        p = pieces.get(word[:n], unknown if n == 1 else None)
        if p is not None:
            for rest in segmentations(word[n:], pieces, unknown):
                yield p * rest


def test_language_by_every_segmentation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs.where(fold(docs["doc_id"], 3) != 1))
    vocabulary = langid.vocabulary()
    codes, lengths = langid._codes(vocabulary)
    at = np.searchsorted(model.table.hashes, langid._prefix_hashes(codes)[np.arange(len(vocabulary)), lengths])
    pieces = [dict(zip(vocabulary, p[at], strict=True)) for p in model.p]
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    known: dict[str, list[float]] = {}

    def told(word):
        if word not in known:
            known[word] = [math.log(math.fsum(segmentations(langid.WORD_START + word, own, p[-1]))) for own, p in zip(pieces, model.p, strict=True)]
        return known[word]

    tried = 0
    for r in QUERIES["op1_language_id"](spark, sf).collect():
        words = langid.LETTERS.findall((texts[r.doc_id] or "").lower())
        if not words or len(words) > 40 or max(map(len, words)) > 11:
            continue
        logs = np.sum([told(w) for w in words], 0)
        assert r.lang_pred == model.languages[int(logs.argmax())]
        assert r.score == pytest.approx(1 / np.exp(logs - logs.max()).sum())
        tried += 1
    assert tried >= 10 and len(known) > 50


def plain_noisy_or(text, model):
    """The score of a text from its sentences' words and stems."""
    clean = 1 / (1 + math.exp(model.leak))
    for sentence in re.findall(r"[^.!?\n]+", text or ""):
        words = set(re.findall(r"[^\W\d_]+", sentence.lower()))
        seen = words | {w[:n] + "*" for w in words for n in toxicity.STEMS if len(w) > n}
        evidence = [model.weights[x] for x in seen if x in model.weights]
        if evidence:
            clean *= 1 - 1 / (1 + math.exp(-model.bias - math.fsum(evidence)))
    return 1 - clean


def test_toxicity_by_every_sentence(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(fold(labels["doc_id"], 4) != 2))
    assert model.weights
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = QUERIES["op7_toxicity"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        score = plain_noisy_or(texts[r.doc_id], model)
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.predicted == (score >= 0.3) or abs(score - 0.3) < 1e-9


def test_toxicity_stage_keeps_all_below_the_threshold(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in docs.select("doc_id", "text").collect() if plain_noisy_or(r.text, model) < 0.3}
    assert {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, sf).collect()} == want


def test_stages_on_odd_texts(spark, sf):
    """Null ids, null and empty texts stay in the first and the fourth stage; what is toxic or leaks goes, in all rows of its id."""
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    bad = max((r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=lambda t: plain_noisy_or(t, model))
    leak = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(None, None, "en", "s", 0), (-1, "", "en", None, 0), (-2, "A clean text of a few words.", None, "s", None), (-3, bad, "en", "s", 5), (-4, f"Before it. {leak} Behind it.", "en", "s", 5), (-4, "Another row of that id.", "en", "s", 5)]
    odd = spark.createDataFrame(rows, docs.schema)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.toxicity_filter(spark, docs.unionByName(odd), sf).where("doc_id is null or doc_id < 0").collect()]
    assert sorted(left, key=str) == sorted(((i, t) for i, t, *_ in rows if i != -3), key=str)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, odd, sf).collect()]
    assert sorted(left, key=str) == sorted(((i, t) for i, t, *_ in rows if i != -4), key=str)
