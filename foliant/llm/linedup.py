"""Corpus-wide line deduplication by a deletion-neighbourhood join.

A line is dropped when an equal line, or one within one character edit,
stands earlier in the corpus (by document id, then line number). Two texts are
one edit apart exactly if they share a deletion variant in one of two ways:
deleting the same position gives the same rest (a substitution), or deleting a
position of one gives the other (an insertion). So every line emits its
variants as hashed keys, and the earliest line of each key is a minimum, which
aggregates before it is shuffled; no pairs of a group are formed. The edit
distance is then verified on the texts.

Lines that no other line could match never emit variants: with one edit, one
half of the shorter line survives in the other, so only lines that share a half
with another line of nearly the same length take part. This loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def deletion_hashes(text: str) -> tuple[int, np.ndarray]:
    """The hash of a text, and those of the text without each of its characters, in one pass."""
    codes = _mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(codes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE, np.uint64)]))[:n]
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
        rest = (prefix[-1] - prefix[1:]) * np.uint64(_INVERSE)
        return int(prefix[-1].astype(np.int64)), (prefix[:-1] + rest).astype(np.int64)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, at, h1, h2)``: for each line its own hash (at -1), and the hash left by each deletion that may matter.

    A line linked by its first half alone differs in the rest, and the reverse.
    """
    held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
    waiting = 0

    def flush() -> pa.RecordBatch:
        times = [len(k) for k, *_ in held]
        columns = [np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), *(np.repeat(np.array([x[i] for x in held], np.int64), times) for i in (2, 3))]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "at", "h1", "h2"])
        held.clear()
        return batch

    for b in batches:
        for h1, h2, text, first, last in zip(*(b[c].to_pylist() for c in ("h1", "h2", "line", "first", "last")), strict=True):
            own, gone = deletion_hashes(text)
            n = len(gone)
            at = np.arange(0 if last else (n - 1) // 2, n if first else (n + 1) // 2, dtype=np.int32)
            held.append((np.concatenate([np.array([own], np.int64), gone[at]]), np.concatenate([np.array([-1], np.int32), at]), h1, h2))
            waiting += len(at) + 1
            if waiting > 200_000:
                yield flush()
                waiting = 0
    if held:
        yield flush()


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with something in them, keyed by two hashes."""
    exploded = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return exploded.where(F.col("line").rlike(r"\S")).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _halves(line: Column) -> Column:
    """Keys of a line: for each length class, the half that one edit would leave alone."""
    n = F.length(line)

    def keys(m: Column) -> list[Column]:
        low = F.floor(m / 2).cast("int")
        high = (m - low).cast("int")
        return [F.xxhash64(m, F.lit(0), F.substring(line, F.lit(1), low)), F.xxhash64(m, F.lit(1), F.substring(line, n - high + 1, high))]

    return F.array(*keys(n), *keys(n - 1))


def drop_repeats(docs: DataFrame, min_chars: int = 20, near: bool = True, few: int = 1_000_000) -> DataFrame:
    """The documents with repeated lines taken out, and ``n_lines``, ``n_exact``, ``n_near``.

    Blank lines are neither counted nor dropped. Exact repeats go at any
    length; near ones only from ``min_chars`` characters, below which one edit
    makes another word. Up to ``few`` linked keys (16 bytes each) are broadcast,
    more of them are joined with the lines, where adaptive execution splits a
    key that very many lines hold. A null id is the earliest; rows that share id
    and text are one place in the corpus, so repeated rows do not erase each
    other. A null or empty text stays as it is. Texts that lose no line are
    returned unchanged. Columns of those names are replaced; any other column
    is handed through, whatever its name.
    """
    made = ("n_lines", "n_exact", "n_near")
    docs = docs.drop(*made)
    same = ["h1", "h2"]
    lines = _lines(docs.select("doc_id", "text"))
    place = F.struct("doc", "line_no", "version")
    slim = lines.select("h1", "h2", place.alias("place"), F.when(F.length("line") >= min_chars, _halves(F.col("line"))).alias("halves"))
    distinct = stored(slim.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.first("halves").alias("halves")))
    firsts = distinct.select("h1", "h2", "place")
    if near:
        halves = distinct.where("halves is not null").select(*same, F.posexplode("halves").alias("k", "half"))
        shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
        sides = [F.bool_or(F.col("k") % 2 == i).alias(name) for i, name in enumerate(("first", "last"))]
        linked = cut(halves.join(shared, "half", "left_semi").groupBy(*same).agg(*sides))
        # Few keys are sent to the lines; only when there are many do the lines travel to the keys.
        wanted = F.broadcast(linked.select(*same)) if linked.count() <= few else linked.select(*same)
        chosen = lines.join(wanted, same, "left_semi").groupBy(*same).agg(F.min(place).alias("place"), F.first("line").alias("line"))
        chosen = cut(chosen.join(linked, same))
        variants = chosen.select(*same, "line", "first", "last").mapInArrow(_variants, "key long, at int, h1 long, h2 long")
        met = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        who = chosen.select(*same, F.struct("place.doc", "place.line_no", *same).alias("who"))
        variants = cut(variants.join(met, "key", "left_semi").join(who, same))
        # The earliest line of each key: substitutions share the place of the deletion, an insertion
        # turns a deletion of one line into the other line itself.
        own, gone = F.when(F.col("at") < 0, F.col("who")), F.when(F.col("at") >= 0, F.col("who"))
        placed = variants.where("at >= 0").groupBy("key", "at").agg(F.min("who").alias("other"))
        either = variants.groupBy("key").agg(F.min(own).alias("own"), F.min(gone).alias("gone"))
        witness = variants.join(placed, ["key", "at"]).select("who", "other").union(variants.join(either, "key").select("who", F.when(F.col("at") < 0, F.col("gone")).otherwise(F.col("own"))))
        pairs = witness.where(F.col("other") < F.col("who")).select("who.h1", "who.h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).distinct()
        texts = chosen.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other_line"))
        checked = pairs.join(chosen.select(*same, "line"), same).join(texts, ["o1", "o2"]).where(F.levenshtein("line", "other_line", 1) == 1).select(*same).distinct()
        firsts = firsts.join(checked.withColumn("near", F.lit(True)), same, "left")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast("boolean"))
    firsts = firsts.withColumn("near", F.coalesce("near", F.lit(False)))
    # First places say which lines stay; how many of the rest are near repeats needs each line's key.
    stay = firsts.groupBy(F.col("place.doc").alias("doc"), F.col("place.version").alias("version")).agg(
        F.array_sort(F.collect_list(F.when(~F.col("near"), F.col("place.line_no")))).alias("kept"), F.count_if("near").alias("near")
    )
    # The row travels as one column, so that no name of its columns meets a working one.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("v"))
    joined = rows.join(stay, F.col("id").eqNullSafe(F.col("doc")) & (F.col("v") == F.col("version")), "left")
    joined = joined.withColumn("lines", F.split("row.text", "\n", -1)).withColumn("blank", F.filter(F.transform("lines", lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull()))
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    n_lines = F.coalesce(F.size("lines") - F.size("blank"), F.lit(0))
    gone = n_lines - F.size(kept)
    text = F.array_join(F.transform(F.array_sort(F.concat("blank", kept)), lambda i: F.element_at("lines", i + 1)), "\n")
    own = lambda c: F.col("row").getField(c)
    return joined.select(
        *(F.when(gone > 0, text).otherwise(own(c)).alias(c) if c == "text" else own(c).alias(c) for c in docs.columns),
        n_lines.cast("long").alias("n_lines"),
        (gone - F.coalesce("near", F.lit(0))).cast("long").alias("n_exact"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )
