"""Approximate nearest neighbours by a permutation index.

A vector is represented by its pivots ordered from near to far. The index
posts every vector in the inverted files of its ``posted`` nearest pivots; a
query reads the files of its own ``read`` nearest pivots and nothing else. In
each file the entries are ranked by Spearman's footrule distance between their
order of the ranking pivots and the query's, and only the best share of the
file is compared exactly. There is about one pivot to ``per_pivot`` vectors, so
files keep their length, and a query its work, while the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_INDEX = "ids array<long>, v binary, pivots array<int>"
_ASKED = "vec_id long, v binary, pivots array<int>, floor double"
_FOUND = "query_id long, vec_id long, score double"


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part; floats stay floats, other numbers become doubles."""
    kind = df.schema[vector].dataType.elementType.typeName()
    v = F.col(vector) if kind in ("float", "double") else F.transform(vector, lambda x: x.cast("double"))
    df = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine & F.exists("v", lambda x: x != 0))


def _lift(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors of one length: the largest inner product is then the smallest angle."""
    left = np.sqrt(np.maximum(norm**2 - (v * v).sum(1), 0))
    return (np.concatenate([v, left[:, None]], 1) / norm).astype(np.float32)


def _near(v: np.ndarray, pivots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest pivots of each vector, in order, and their similarities."""
    alike = v @ pivots.T
    some = np.argpartition(-alike, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(alike, some, 1), axis=1, kind="stable")
    some = np.take_along_axis(some, order, 1)
    return some.astype(np.int32), np.take_along_axis(alike, some, 1)


def _places(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The place of every ranking pivot in each vector's order."""
    order = np.argsort(-(v @ pivots.T), axis=1, kind="stable")
    out = np.empty(order.shape, np.int16)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int16)[None, :], 1)
    return out


def _deal(files: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of slices of each file: short files share a bucket of ``block`` entries, long ones are sliced."""
    first, slices = np.zeros(len(files), np.int64), np.maximum(1, -(-files // block))
    bucket = held = 0
    for p, n in enumerate(files):
        if slices[p] > 1:
            bucket, held = bucket + (held > 0), 0
            first[p] = bucket
            bucket += int(slices[p])
        else:
            if held + n > block:
                bucket, held = bucket + 1, 0
            first[p] = bucket
            held += int(n)
    return first, slices


def _best(query: np.ndarray, member: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` best rows; ties go to the smaller member."""
    order = np.lexsort((member, -score, query))
    q = query[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    place = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))
    return order[place < k]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    per_pivot: int = 12,
    most_pivots: int = 16384,
    most_bytes: int = 256 << 20,
    ranking: int = 128,
    posted: int = 8,
    read: int = 160,
    share: float = 0.2,
    least: int = 24,
    block: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query its ``k`` best by inner product, in double precision.

    Pivots are chosen by hash: one to ``per_pivot`` distinct vectors, 64 at
    least and ``most_pivots`` at most, fewer if their numbers would take more
    than ``most_bytes``, which bounds what the driver and a task hold of them;
    beyond that, files grow with the table. A crowd of near
    copies gets its share of the pivots, so its files are no longer than
    others. ``ranking`` of the pivots give the orders that the footrule
    compares. Of a file a query compares the best ``share``, ``least`` entries
    at least. A file of more than ``block`` entries is sliced, and a query
    reads every slice. Pivots are rows of the table, so what scores below a
    query's ``k + 1`` best pivots cannot be among its ``k`` best and is not
    passed on.

    Equal vectors are indexed once with their ``k + 1`` smallest ids, which is
    all that a list of ``k`` can use, so a crowd of copies hides nobody. Ties
    go to the smaller id; a query is not its own neighbour. Vectors that are
    null, zero, or hold null or non-finite parts take no part; neither do rows
    with a null id. Of rows with one id and one vector, one counts. All vectors
    have one length. An empty table gives an empty result. Other columns are
    not read.
    """
    spark = vectors.sparkSession
    every = _usable(vectors, key, vector)
    # dense_rank keeps repeats of one row from taking the places of other ids.
    numbered = every.withColumn("_n", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    crowds = cut(numbered.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, norm, length = crowds.agg(F.count("*"), F.max(F.sqrt(square)), F.max(F.size("v"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_pivots = int(min(total, most_pivots, max(64, total // per_pivot), max(64, most_bytes // (8 * length))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(1 << 40))
    # A little more than enough by the hash, then exactly as many.
    sample = crowds.select(draw.alias("s"), "v").where(F.col("s") < int((1 << 40) * min(1.0, (n_pivots + 8 * n_pivots**0.5) / total))).orderBy("s", "v").limit(n_pivots).select("v").toArrow()
    pivots = _lift(sample["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length), norm)
    ranking, posted, read = min(ranking, len(pivots)), min(posted, len(pivots)), min(read, len(pivots))
    kind = np.float64 if crowds.schema["v"].dataType.elementType.typeName() == "double" else np.float32
    sent = spark.sparkContext.broadcast(pivots)

    def listing(ids: str, query: bool):
        """Read vectors; write their ids, parts and nearest pivots."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    some = b.slice(i, 1024)
                    v = some["v"].flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                    lifted = np.concatenate([v, np.zeros((len(v), 1))], 1).astype(np.float32) if query else _lift(v.astype(float), norm)
                    near, alike = _near(lifted, sent.value, read if query else posted)
                    columns = [some[ids], pa.array([x.tobytes() for x in v.astype(kind)], pa.binary()), pa.array(list(near), pa.list_(pa.int32()))]
                    if query:  # the similarities are single precision, hence the margin
                        size = np.linalg.norm(v.astype(float), axis=1) * norm
                        columns.append(pa.array(alike[:, k] * norm - 1e-4 * size if near.shape[1] > k else np.full(len(v), -np.inf), pa.float64()))
                    yield pa.RecordBatch.from_arrays(columns, [ids, "v", "pivots", "floor"][: len(columns)])

        return run

    index = cut(crowds.select("ids", "v").mapInArrow(listing("ids", False), _INDEX))
    asked = cut(_usable(queries, key, vector).distinct().mapInArrow(listing("vec_id", True), _ASKED))

    def counts(df: DataFrame) -> np.ndarray:
        """How often each pivot is listed: one row per pivot."""
        out = np.zeros(len(pivots), np.int64)
        for p, n in df.select(F.explode("pivots").alias("p")).groupBy("p").count().collect():
            out[p] = n
        return out

    first, slices = _deal(counts(index), block)
    # Queries that meet in a bucket are dealt into parts as well, should they be very many.
    parts = np.ones(int((first + slices).max()), np.int64)
    np.add.at(parts, first, counts(asked) // 65536)
    for p in np.flatnonzero(slices > 1):
        parts[first[p] : first[p] + slices[p]] = parts[first[p]]

    def dealt(query: bool):
        """One row per bucket and part in which a vector stands, with its pivots there."""
        name = "vec_id" if query else "ids"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, bucket, part, listed = [], [], [], []
                for i, (own, near) in enumerate(zip(b[name].to_pylist(), b["pivots"].to_pylist(), strict=True)):
                    who = own if query else own[0]
                    where: dict[int, list[int]] = {}
                    for p in near:
                        for s in range(int(slices[p])) if query else (who * 0x9E3779B1 % int(slices[p]),):
                            where.setdefault(int(first[p]) + s, []).append(p)
                    for c, ps in where.items():
                        for t in (who * 0x85EBCA6B % int(parts[c]),) if query else range(int(parts[c])):
                            row.append(i)
                            bucket.append(c)
                            part.append(t)
                            listed.append(ps)
                at = pa.array(row, pa.int64())
                columns = [pa.array(bucket, pa.int32()), pa.array(part, pa.int32()), b[name].take(at), b["v"].take(at), pa.array(listed, pa.list_(pa.int32()))]
                more = ["floor"] if query else []
                yield pa.RecordBatch.from_arrays([*columns, *(b[c].take(at) for c in more)], ["bucket", "part", name, "v", "pivots", *more])

        return run

    entries = index.mapInArrow(dealt(False), "bucket int, part int, " + _INDEX)
    readers = asked.mapInArrow(dealt(True), "bucket int, part int, " + _ASKED)

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(x):
            qv, xv = (np.frombuffer(b"".join(t["v"]), kind).reshape(len(t), -1).astype(float) for t in (q, x))
            anchors, floor = sent.value[:ranking], q["floor"].to_numpy()
            q_place, x_place = _places(np.concatenate([qv, np.zeros((len(qv), 1))], 1).astype(np.float32), anchors), _places(_lift(xv, norm), anchors)
            readers_of: dict[int, list[int]] = {}
            file_of: dict[int, list[int]] = {}
            for into, t in ((readers_of, q), (file_of, x)):
                for i, ps in enumerate(t["pivots"]):
                    for p in ps:
                        into.setdefault(int(p), []).append(i)
            for p, rows in readers_of.items():
                if p not in file_of:
                    continue
                members = np.array(file_of[p])
                keep = min(len(members), max(least, int(np.ceil(share * len(members)))))
                step = max(1, 4_000_000 // (len(members) * ranking))
                for i in range(0, len(rows), step):
                    some = np.array(rows[i : i + step])
                    footrule = np.abs(x_place[members][None] - q_place[some][:, None]).sum(2, dtype=np.int32)
                    best = members[np.argpartition(footrule, keep - 1, axis=1)[:, :keep]]
                    scores = np.einsum("qkd,qd->qk", xv[best], qv[some])
                    fine = scores >= floor[some][:, None]
                    found.append((np.repeat(some, fine.sum(1)), best[fine], scores[fine]))
        if not sum(len(f[0]) for f in found):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        query, member, score = (np.concatenate(c) for c in zip(*found, strict=True))
        _, once = np.unique(query * len(x) + member, return_index=True)
        query, member, score = query[once], member[once], score[once]
        ids = x["ids"].to_numpy()
        n = np.array([len(i) for i in ids])[member]
        vec = np.concatenate([ids[m] for m in member])
        query, score = np.repeat(query, n), np.repeat(score, n)
        other = q["vec_id"].to_numpy()[query] != vec
        query, vec, score = query[other], vec[other], score[other]
        top = _best(query, vec, score, k)
        return pd.DataFrame({"query_id": q["vec_id"].to_numpy()[query[top]], "vec_id": vec[top], "score": score[top]})

    met = readers.groupBy("bucket", "part").cogroup(entries.groupBy("bucket", "part")).applyInPandas(meet, _FOUND)
    # One exchange by query serves both steps: a pair found in several files, and the best of all.
    merged = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
