"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folders import cut, removed, shared_folder  # noqa: F401

#: Words as every size in this package counts them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to, within the one that driver and executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut or stored inside goes at the end; write the result outside that folder before."""
    parent = shared_dir(spark).rpartition("/")[0]
    spark.sparkContext.setCheckpointDir(parent)  # a new folder in it
    inner = shared_dir(spark)
    try:
        yield
    finally:
        spark.sparkContext.setCheckpointDir(parent)
        removed(spark, inner)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder, or the given one, and read again."""
    path = f"{folder or shared_dir(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spare(name: str, taken: list[str]) -> str:
    """The name, or one like it that no column has."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hashed_sample(df: DataFrame, key: str, by: str, size: int, few: int = 100_000) -> DataFrame:
    """Rows of each value of ``by``, about ``size`` of them, chosen by a hash of ``key``.

    Every group keeps all its rows while it has at most ``size``. The choice
    needs one count per group, so no group meets in one task. Up to ``few``
    counts are broadcast, so that the rows need no shuffle; more are joined.
    """
    steps = 1 << 40
    counts = cut(df.groupBy(by).agg(F.count("*").alias("_n")))
    if counts.count() <= few:
        counts = F.broadcast(counts)
    return (
        df.join(counts, by)
        .where(F.pmod(F.xxhash64(key), F.lit(steps)) < F.ceil(F.lit(float(size) * steps) / F.col("_n")))
        .drop("_n")
    )


class Numbers(dict):
    """Numbers from 0 for keys in the order in which they are first asked for."""

    def __missing__(self, key: object) -> int:
        self[key] = n = len(self)
        return n

    def of(self, lists: list[list]) -> np.ndarray:
        """The numbers of all keys of the lists in a row."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))


def numbered(columns: list[str]) -> list[Column]:
    """The columns under the names ``c0``, ``c1`` ..., since functions over Arrow batches take no names with dots."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(columns)]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges in a row, and which range each belongs to."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n), owner


def sliced(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose values of one column have about ``most`` bytes; a longer value is a part of its own."""
    if batch.num_rows <= 1 or batch[column].nbytes <= most:
        yield batch
        return
    half = batch.num_rows // 2
    yield from sliced(batch.slice(0, half), column, most)
    yield from sliced(batch.slice(half), column, most)
