"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on everything its predecessor
kept, and returns the columns of ``documents``; the last one returns the mix.

In every stage columns beyond those of ``documents`` are handed through under
their names, an empty table gives an empty one, repeated rows fare alike, and
texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontam, linedup, minhash, mixing, toxicity
from foliant.llm.common import removed, scratch, shared_dir, stored, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3.

    The model learns from the rows of ``labels`` whose documents are there. A
    null or empty text scores as one without a sentence and stays; so does a row
    with a null id, by its text. Without labels nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    row = F.struct(*docs.columns).alias("row")
    return toxicity.score(docs.select(row, "text"), model, keep=["row"]).where("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; one that was made of repeats alone goes.

    The earliest line, by id and then line number, stays; a null id is the
    earliest of all. Null, empty and blank texts stay. ``n_chars`` follows the
    text where that has changed.
    """
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    done = linedup.drop_repeats(own)
    lost = F.col("n_exact") + F.col("n_near")
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("text"), "n_chars": F.when(lost > 0, size).otherwise(F.col("row.n_chars"))}
    some = done.where((F.col("n_lines") == 0) | (lost < F.col("n_lines")))
    return some.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near duplicates: five words, similarity 0.8.

    Texts null or without words are in no group and stay, as do rows with a
    null id. Of equal texts the smallest id stays; all rows of an id that stays do.
    """
    kept = minhash.near_duplicates(docs, words=5).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``, edits of a fifth of its words allowed.

    Null texts, and null or wordless items, match nothing. If one row of an id
    holds an item, all rows of that id go.
    """
    leaks = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_id"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix, one row per row.

    A null source is a source of its own, the last; a text without words has
    size 0 and is never taken; equal draws go by id, then size, so reruns agree.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
]

#: Trained models and sketches are not SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``; what a stage needed on the way is removed once its result is written."""
    docs, results = table(spark, sf_dir, "documents"), shared_dir(spark)
    for n, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{results}/stage-{n}")
        if n:
            removed(spark, f"{results}/stage-{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
