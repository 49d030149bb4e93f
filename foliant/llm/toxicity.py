"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence with learnt evidence has a
score, a logistic function of its words; the document's score is their
noisy-or, with one leak term for what no sentence explains. The sentence model
is trained through the noisy-or from document labels alone, and then points to
the sentences that offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, spare

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Inflected forms share their first letters, which are features beside the word.
STEMS = (4, 5)


def features(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


class Evidence(dict):
    """The known features of each word met so far; most words have none."""

    def __init__(self, known: dict[str, float], most: int = 500_000):
        super().__init__()
        self.known, self.most = known, most

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = tuple(x for x in features({word}) if x in self.known)
        return found


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    leak: float

    def sentences(self, text: str, evidence: Evidence) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences with evidence."""
        out = []
        for m in _SENTENCE.finditer(text):
            seen = {x for w in _WORD.findall(m[0].lower()) for x in evidence[w]}
            if seen:
                z = self.bias + sum(self.weights[x] for x in sorted(seen))
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return out

    def score(self, text: str | None, evidence: Evidence | None = None) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a text's sentences, and the sentences with evidence."""
        found, evidence = [], Evidence(self.weights) if evidence is None else evidence
        if text and any(map(evidence.__getitem__, set(_WORD.findall(text.lower())))):
            found = self.sentences(text, evidence)
        clean = np.log1p(-np.minimum([s for *_, s in found], 1 - 1e-12)).sum() - _softplus(np.float64(self.leak))
        return float(-np.expm1(clean)), found


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, most_features: int | None = 4000, least_uses: int = 5, rounds: int = 300) -> ToxicityModel:
    """Fit on about ``per_class`` labelled documents of each class.

    ``labels`` has ``doc_id`` and ``toxic``; null labels teach nothing, and a
    document without text teaches as an empty one. Sample, features and the
    bags of known features are bounded by the parameters, so what reaches the
    driver is; features of weaker evidence than the first ``most_features`` are
    left out (None: none but those without evidence). Ids are read as longs. Without labels the model scores everything 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    totals = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    if not totals:
        return ToxicityModel({}, 0.0, -50.0)
    chosen = hashed_sample(known, "doc_id", "toxic", per_class)
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted(features(set(_WORD.findall(s.lower())))) for s in b["sentence"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string())), b["toxic"]], ["features", "toxic"])

    drawn = {int(r["toxic"]): r["count"] for r in bags.groupBy("toxic").count().collect()}
    n1, n0 = max(1, drawn.get(1, 0)), max(1, sum(n for t, n in drawn.items() if t != 1))
    # Evidence is counted over distinct sentences, so copies of a document do not
    # make its words look typical; one that also stands in a clean document is clean.
    sentences = bags.select(F.col("toxic").cast("int").alias("toxic"), F.explode(F.split("text", r"[.!?\n]+", -1)).alias("sentence")).groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    counts = sentences.mapInArrow(seen, "features array<string>, toxic int").select(F.explode("features").alias("feature"), "toxic")
    counts = counts.groupBy("feature").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c"))
    # Words in toxic documents far more often than in others, by a smoothed log ratio against its error.
    lift = F.log((F.col("t") + 0.5) / n1) - F.log((F.col("c") + 0.5) / n0)
    strength = lift / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    picked = [r["feature"] for r in counts.where((F.col("t") >= least_uses) & (strength > 3.0) & (lift > 1.0)).orderBy(F.desc(strength), "feature").limit(most_features or 2**31 - 1).select("feature").collect()]
    number = {f: i for i, f in enumerate(sorted(picked))}

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(number)
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                hits = ([number[x] for x in sorted({x for w in _WORD.findall(s.lower()) for x in evidence[w]})] for s in _SENTENCE.findall(text))
                rows.append([h for h in hits if h])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(rows, pa.list_(pa.list_(pa.int32())))], ["doc_id", "toxic", "bag"])

    data = bags.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(grouped, "doc_id long, toxic int, bag array<array<int>>").orderBy("doc_id").toPandas()
    y = (data["toxic"].to_numpy() == 1).astype(float)
    doc_of, sent_of, feat = [], [], []
    for d, bag in enumerate(data["bag"]):
        for sentence in bag:
            sent_of += [len(doc_of)] * len(sentence)
            feat += list(sentence)
            doc_of.append(d)
    doc_of, sent_of, feat = (np.array(x, np.int64) for x in (doc_of, sent_of, feat))
    # Each class counts as much as it does among all labels.
    importance = np.where(y == 1, totals.get(1, 0) / n1, sum(v for t, v in totals.items() if t != 1) / n0)
    importance = importance / importance.mean() if len(y) else importance
    w, b, leak = np.zeros(len(picked)), -1.0, -3.0
    m, v = np.zeros(len(picked) + 2), np.zeros(len(picked) + 2)
    for t in range(1, rounds + 1):
        z = b + np.bincount(sent_of, w[feat], len(doc_of)) if len(doc_of) else np.zeros(0)
        s = np.bincount(doc_of, _softplus(z), len(y)) + _softplus(np.float64(leak))
        # The loss of a toxic document is -log(1 - exp(-s)), of another one s.
        ds = importance * np.where(y == 1, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0)
        dz = ds[doc_of] / (1 + np.exp(-z))
        grad = np.concatenate([np.bincount(feat, dz[sent_of], len(picked)) + 0.05 * w, [dz.sum(), ds.sum() / (1 + np.exp(-leak))]]) / max(1, len(y))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b, leak = w - move[:-2], b - move[-2], leak - move[-1]
    return ToxicityModel({f: float(w[i]) for f, i in number.items()}, float(b), float(leak))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Add ``score``, ``predicted`` and ``offending``, the sentences that reach the threshold on their own.

    ``offending`` holds code-point spans with their scores. Empty and null
    texts get the leak's score. Every text is read whole; equal texts score
    equally. Columns of those names are replaced.
    """
    made = ("score", "predicted", "offending")
    out = [c for c in (keep or docs.columns) if c not in made]
    span = "array<struct<start:int,end:int,score:double>>"
    schema = docs.select(*out).schema.add("score", "double").add("predicted", "integer").add("offending", docs.sparkSession.range(0).select(F.lit(None).cast(span)).schema[0].dataType)
    at = len(out)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.weights)
        for b in batches:
            got = [model.score(t, evidence) for t in b[b.num_columns - 1].to_pylist()]
            scores = np.array([s for s, _ in got], float)
            spans = [[{"start": i, "end": j, "score": p} for i, j, p in found if p >= threshold] for _, found in got]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)], [*out, *made])

    return docs.select(*out, F.col("text").alias(spare("_text", out))).mapInArrow(run, schema)
