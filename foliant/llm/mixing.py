"""Mix sources to target weights by Pareto order sampling.

A source's target is a number of words. Its documents first get certain whole
copies; the fractional copies that remain become inclusion probabilities of
Pareto order sampling: each document draws the odds of a uniform number,
divided by its inclusion odds, and the smallest ranks fill the remaining words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Cells of the rank's range; only the cell that holds the cut is ordered row by row.
CELLS = 1 << 16


def worth(bits: Column) -> Column:
    """Relative copies of a document whose size has so many binary digits: long documents repeat a little less."""
    return F.floor(F.lit(720720) / (F.lit(16) + bits)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``(source, source_size, target)``: water-filled shares of ``percent`` of all words.

    One row per source meets in one window; the rows of documents do not.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")).cast("long")
    whole = Window.partitionBy()
    ranked = (
        by_source.withColumn("_k", F.row_number().over(order) - 1)
        .withColumn("_w", weight)
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_weights", F.sum("_w").over(whole))
    )
    # Sources fill up in the order of size over weight. A source is full if, with all
    # before it full, the level of the rest would still lift it above its bound.
    filling = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_k").asc()).rowsBetween(Window.unboundedPreceding, -1)
    budget = F.col("_all") * percent / 100
    leveled = (
        ranked.withColumn("_full", F.coalesce(F.sum("source_size").over(filling), F.lit(0)))
        .withColumn("_used", F.coalesce(F.sum("_w").over(filling), F.lit(0)))
        .withColumn("_level", (budget - most * F.col("_full")) / (F.col("_weights") - F.col("_used")))
        .withColumn("_capped", F.col("_level") * F.col("_w") > most * F.col("source_size"))
        .withColumn("_final", F.max(F.when(~F.col("_capped"), F.col("_level"))).over(whole))
    )
    bound = (most * F.col("source_size")).cast("double")
    target = F.when(F.col("_capped"), bound).otherwise(F.least(F.col("_final") * F.col("_w"), bound))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)``, one row per row of ``docs``.

    A null source is a source of its own, the last. A null or blank text has
    size 0 and is never taken. Rows with equal ids draw equal numbers and are
    ordered by size, so repeats of one row are interchangeable. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    slim = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = cut(slim).withColumn("_bits", F.length(F.bin("size"))).withColumn("_worth", worth(F.col("_bits")))
    goals = targets(sizes, weights, percent, most)
    # The copies of a document are the least of the bound and a level times its worth.
    # Sizes of equal binary length share a worth, so the level comes from a few dozen rows per source.
    lengths = sizes.groupBy("source", "_bits", "_worth").agg(F.sum("size").alias("_s"))
    by_length = Window.partitionBy("source").orderBy("_bits")
    fits = (F.col("_rest") > 0) & (F.col("_level") * F.col("_worth") <= most)
    levels = (
        lengths.withColumn("_before", F.coalesce(F.sum("_s").over(by_length.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum(F.col("_s") * F.col("_worth")).over(by_length.rowsBetween(0, Window.unboundedFollowing)))
        .withColumnRenamed("source", "_source")
        .join(goals, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_level", F.try_divide(F.col("target") - most * F.col("_before"), F.col("_rest").cast("double")))
        .groupBy("source", "source_size", "target")
        .agg(F.coalesce(F.max(F.when(fits, F.col("_level"))), F.lit(float(most))).alias("_level"))
        .withColumnRenamed("source", "_source")
    )
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13)
    drawn = (
        sizes.join(levels, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_wanted", F.least(F.lit(float(most)), F.col("_level") * F.col("_worth")))
        .withColumn("_whole", F.floor("_wanted"))
        .withColumn("_p", F.col("_wanted") - F.col("_whole"))
        .withColumn("_u", (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52)))
        .withColumn("_q", F.when((F.col("_p") > 0) & (F.col("size") > 0), F.col("_u") * (1 - F.col("_p")) / ((1 - F.col("_u")) * F.col("_p"))))
        .withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS))
        .withColumn("_place", F.struct("_q", "doc_id", "size"))
    )
    cells = drawn.groupBy("source", "target", "_cell").agg(F.sum("size").alias("_words"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    in_source = Window.partitionBy("source")
    filled = (
        cells.withColumn("_left", F.col("target") - F.sum("_certain").over(in_source))
        .where(F.col("_cell").isNotNull())
        .withColumn("_start", F.sum("_words").over(in_source.orderBy("_cell")) - F.col("_words"))
        .select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), "_start", "_left", (F.col("_start") + F.col("_words") <= F.col("_left")).alias("_in"))
    )
    # Cells that end before the cut are in. In the one that holds it, a document is in if half of it lies before the cut.
    edge = filled.where(~F.col("_in") & (F.col("_start") < F.col("_left")))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    last = (
        drawn.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
        .withColumn("_run", run)
        .where(2 * (F.col("_start") + F.col("_run")) - F.col("size") <= 2 * F.col("_left"))
        .groupBy("source")
        .agg(F.max("_place").alias("_last"))
    )
    below = filled.where("_in").groupBy("_s").agg(F.max("_c").alias("_below"))
    below = below.withColumnRenamed("_s", "_s1")
    last = last.withColumnRenamed("source", "_s2")
    more = F.coalesce(F.col("_cell") <= F.col("_below"), F.lit(False)) | F.coalesce(F.col("_place") <= F.col("_last"), F.lit(False))
    copies = F.col("_whole") + (F.col("_q").isNotNull() & more).cast("long")
    return (
        drawn.join(below, F.col("source").eqNullSafe(F.col("_s1")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("_s2")), "left")
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    )
