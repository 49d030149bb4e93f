"""Numbering of rows in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import cut


def numbered_in_order(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place in the order, from 0, in column ``name``; the order has to tell all rows apart.

    Rows are dealt into partitions by ranges of the order and sorted there. A
    partition's rows are numbered among themselves, and a sum over the
    partitions' counts, of which there are as many as partitions, tells where
    each begins. The sorted rows are cut by a checkpoint, so that counts and
    rows come from the same ranges. No task holds more than a range.
    """
    part, first, n = (f"_{name}_{x}" for x in ("part", "first", "n"))
    ranged = cut(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = ranged.groupBy(part).agg(F.count("*").alias(n)).collect()
    starts, total = [], 0
    for p, size in sorted(map(tuple, counts)):
        starts.append((p, total))
        total += size
    starts = rows.sparkSession.createDataFrame(starts, f"{part} int, {first} long")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return ranged.withColumn(n, own).join(F.broadcast(starts), part).withColumn(name, F.col(first) + F.col(n)).drop(part, first, n)
