"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of hash functions are drawn; entry (i, j) of the table
grid is keyed by the i-th bundle of the first and the j-th of the second. So
``bundles`` squared tables need only twice ``bundles`` bundles of minhashes.
A bundle that no other text shares cannot take part in a shared key and is
dropped before the pairs of bundles are formed. Candidates are verified on the
full shingle sets, and links become components.

A bucket does not emit all its pairs. Its members are first compared with its
smallest one. Where that leaves a bucket in more than one component, members
outside the largest one are compared with those of other components; where many
meet, this goes block by block and only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .components import components

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _blur(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Shingler:
    """Hashes of a text's word shingles; A-Z count as a-z, words end at ASCII white space."""

    def __init__(self, words: int):
        self.words = words
        self.up, self.down = _powers(int(_MIX), 1 << 12), _powers(pow(int(_MIX), -1, 1 << 64), 1 << 12)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        if not text:
            return np.zeros(0, np.uint64)
        b = np.frombuffer(text, np.uint8)
        if len(b) >= len(self.up):
            self.up, self.down = _powers(int(_MIX), 2 * len(b)), _powers(pow(int(_MIX), -1, 1 << 64), 2 * len(b))
        edge = np.flatnonzero(np.diff(_BLANK[b], prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        # A word's hash is a difference of prefix sums, moved to a common origin.
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[b] * self.up[: len(b)])])
        h = _blur((prefix[ends] - prefix[starts]) * self.down[starts])
        n = max(1, len(h) - self.words + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(self.words, len(h))):
            out = _blur(out * _MIX + h[i : i + n])
        return np.unique(out)


def sketch(docs: DataFrame, words: int, bundles: int, rows: int, seed: int = 1) -> DataFrame:
    """``(doc_id, n_shingles, content, halves)``.

    ``content`` is a 128-bit digest of the set; ``halves`` has the bundles of
    the first collection, then of the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        n, shingles = 2 * bundles * rows, Shingler(words)
        factor = np.random.default_rng(seed).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for b in batches:
            count, content, keys = [], [], []
            for text in b["text"].cast(pa.binary()).to_pylist():
                s = shingles(text)
                count.append(len(s))
                content.append(xxhash.xxh128_digest(s.tobytes()))
                if not len(s):
                    keys.append(None)
                    continue
                x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(n, np.iinfo(np.uint32).max, np.uint32)
                for k in range(0, len(x), 512):  # a long text's hashes are taken in parts
                    np.minimum(low, (x[k : k + 512, None] * factor).min(0), out=low)
                half = np.arange(2 * bundles, dtype=np.uint64)
                for r in range(rows):
                    half = _blur(half * _MIX + low[r::rows])
                keys.append(half.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(count, pa.int64()), pa.array(content, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "content", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, content binary, halves array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, n_shingles, shingles)`` with every shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            sets = [shingles(text) for text in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n_shingles", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, shingles binary")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of ``(a, b, part)`` whose full sets are similar enough; of an id with several sets any may be.

    The set of ``a`` goes to each of its parts once, ahead of the sets of the ``b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, heads = None, []
        for batch in batches:
            found = []
            for a, part, b, s in zip(*(batch[c].to_pylist() for c in ("a", "part", "b", "shingles")), strict=True):
                if (a, part) != of:
                    of, heads = (a, part), []
                own = np.frombuffer(s, np.uint64)
                if b is None:
                    heads.append(own)
                elif any(_alike(x, own, percent) for x in heads):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    pairs = cut(pairs)
    members = pairs.join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").select("a", "part", "b", "shingles")
    heads = pairs.select("a", "part").distinct().join(sets.select(F.col("doc_id").alias("a"), "shingles"), "a")
    rows = members.unionByName(heads.select("a", "part", F.lit(None).cast("long").alias("b"), "shingles"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _meet(percent: int):
    """A comparison of two blocks of texts by an inverted index of the second block's shingles."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(x) and len(y):
            sets = [np.frombuffer(s, np.uint64) for s in y["shingles"]]
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            posted, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
            ids, parts = y["doc_id"].to_numpy(), y["part"].to_numpy()
            for i, part, s in zip(x["doc_id"], x["part"], x["shingles"], strict=True):
                own = np.frombuffer(s, np.uint64)
                low, high = np.searchsorted(posted, own), np.searchsorted(posted, own, "right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sets))
                linked = ids[(100 * both >= percent * (sizes + len(own) - both)) & (parts != part)]
                a += np.minimum(linked, i).tolist()
                b += np.maximum(linked, i).tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bundles: int = 24, rows: int = 4, crowd: int = 32, block: int = 1024) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    With ``rows`` minhashes to a bundle a pair of similarity s is missed with
    probability below ``2 * (1 - s ** rows) ** bundles``: 6e-6 at 0.8 for the
    defaults. Bundles that more than ``crowd`` texts of open buckets share are
    compared in blocks of about ``block`` texts. Texts null or without words have no shingles, link with nothing and
    are kept, as are rows with a null id (``component_id`` null). Texts with
    equal sets are linked outright, whatever their number. Rows that share an id
    are one document: all its texts belong to one component. Ids are read as
    longs; other columns are not read.
    """
    slim = cut(sketch(docs, words, bundles, rows))
    full = slim.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("content").agg(F.min("doc_id").alias("rep"))
    classed = full.join(classes, "content")
    # Classes that meet in one document are linked by it.
    by_id = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("top"), F.collect_set("rep").alias("reps")).where("a < top")
    by_id = by_id.select("a", F.explode("reps").alias("b")).where("a < b").distinct()
    reps = classed.where("doc_id = rep").dropDuplicates(["doc_id", "content"]).select("doc_id", "n_shingles", "halves")
    halves = reps.select("doc_id", "n_shingles", F.posexplode("halves").alias("h", "key"))
    # Bundles are dealt with their place mixed in, so a key is enough.
    shared = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = halves.join(shared, "key", "left_semi")
    one_side = lambda lower: F.collect_set(F.when((F.col("h") < bundles) == lower, F.col("key")))
    grids = live.groupBy("doc_id").agg(one_side(True).alias("first"), one_side(False).alias("second"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    grids = cut(grids.where((F.size("first") > 0) & (F.size("second") > 0)))
    cells = grids.select("doc_id", "second", F.explode("first").alias("one")).select("doc_id", "one", F.explode("second").alias("two"))
    cells = cells.select("doc_id", F.xxhash64("one", "two").alias("cell"))
    heads = cells.groupBy("cell").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    buckets = stored(cells.join(heads, "cell"))
    # Only texts that share a table key are shingled in full.
    taking_part = buckets.select("doc_id").distinct()
    sets = cut(full_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(taking_part, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), words).where("n_shingles > 0"))
    sizes = grids.select("doc_id", "least", "most")

    def near_in_size(a: str, b: str) -> Column:
        """Sets of too different sizes cannot be similar enough."""
        return 100 * F.least(f"{a}most", f"{b}most") >= percent * F.greatest(f"{a}least", f"{b}least")

    def fits(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sizes.select(F.col("doc_id").alias(side), F.col("least").alias(f"{side}_least"), F.col("most").alias(f"{side}_most")), side)
        return pairs.where(near_in_size("a_", "b_")).select("a", "b", "part")

    # The members of a large bucket are dealt into parts of about half a block, so that its smallest one meets them in many tasks.
    met = buckets.where("doc_id <> head").groupBy(F.col("head").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n"))
    stars = fits(met.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(2 * F.col("n") / block)).cast("int").alias("part")))
    links = cut(verify(stars, sets, percent).union(by_id))
    joined = components(links)

    def unsettled() -> DataFrame:
        """Buckets in more than one component, each member with its component and the bucket's largest one."""
        label = joined.select(F.col("node").alias("doc_id"), "component")
        marked = buckets.join(label, "doc_id", "left").select("cell", "doc_id", F.coalesce("component", "doc_id").alias("part"))
        parts = marked.groupBy("cell", "part").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"))
        return marked.join(parts.where("parts > 1").select("cell", "main"), "cell")

    # Members outside a bucket's largest component are compared with all members of other components that
    # share a bundle of the first collection with them.
    open_ = cut(unsettled())
    whose = open_.select("doc_id", "part", (F.col("part") != F.col("main")).alias("few")).groupBy("doc_id", "part").agg(F.bool_or("few").alias("few"))
    keyed = whose.join(grids, "doc_id").select("doc_id", "part", "few", "least", "most", "first", F.explode("first").alias("key"))
    crowds = keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if("few").alias("n_few")).where("n > 1 and n_few > 0")
    keyed = cut(keyed.join(crowds, "key"))
    # A bundle with few texts forms its pairs as rows, each in the first bundle that both texts have.
    small = keyed.where(F.col("n") <= crowd)
    names = ("doc_id", "part", "first", "least", "most", "few")
    x = small.where("few").select("key", *(F.col(c).alias(f"x_{c}") for c in names))
    y = small.select("key", *(F.col(c).alias(f"y_{c}") for c in names))
    once = (
        (F.col("x_part") != F.col("y_part"))
        & (~F.col("y_few") | (F.col("x_doc_id") < F.col("y_doc_id")))
        & near_in_size("x_", "y_")
        & (F.col("key") == F.array_min(F.array_intersect("x_first", "y_first")))
    )
    rest = x.join(y, "key").where(once).select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"), F.lit(0).alias("part"))
    # A bundle with many is dealt into blocks; each block of the few meets each block of all, and only links come out.
    large = keyed.where(F.col("n") > crowd).select("key", "doc_id", "part", "few", F.ceil(F.col("n") / block).cast("int").alias("n"))
    large = large.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")).join(sets.select("doc_id", "shingles"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    few_side = large.where("few").select("key", F.col("own").alias("i"), F.col("other").alias("j"), "doc_id", "part", "shingles")
    all_side = large.select(*(F.col(c).alias(name) for c, name in (("key", "key"), ("other", "i"), ("own", "j"), ("doc_id", "doc_id"), ("part", "part"), ("shingles", "shingles"))))
    in_blocks = few_side.groupBy("key", "i", "j").cogroup(all_side.groupBy("key", "i", "j")).applyInPandas(_meet(percent), "a long, b long")
    more = cut(verify(rest, sets, percent).union(in_blocks.distinct()))
    final = joined if more.isEmpty() else components(links.union(more))
    of_rep = final.select(F.col("node").alias("rep"), "component")
    ids = classes.join(of_rep, "rep", "left").select("content", F.coalesce("component", "rep").alias("component_id"))
    # The component's name is its smallest document, which is its smallest class's smallest.
    out = slim.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("content")).alias("content")).join(ids, "content", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"))
