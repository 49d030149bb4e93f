"""Comparison of document versions: word diff, changes, page fingerprints and alignment.

A pair of versions is ``(pair_id, a_doc, b_doc)``; words and pages of its sides
carry ``pair_id`` and ``side`` (a or b). The words of a side are one text, as
``word_texts`` gives it. The two of a pair meet in a row, after one exchange,
and are compared there, so that only what comes out of it takes a row a word.
``match_words`` does the same with words that come as rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound

GAP = 0.25
#: Pages this little below a match are kept, since sums may round such a one up to a match.
ROUNDING = 1e-9
SNIPPET = 60
#: Pages of a side that the feature compares by pages; the aligning queries go on to the last page.
MOST_PAGES = 400
#: Rows that are put together in a batch.
BATCH = 10_000
#: Ids are taken in ranges of two to this power where a first line has very many documents.
RANGE_BITS = 16


def version_pairs(docs: DataFrame) -> DataFrame:
    """Each document with the one before it that has the same first line.

    Documents meet by first line and range of ids, and ranges by their last
    ids, so a first line that very many documents share is no single task.
    """
    first = F.element_at(F.split("text", "\n", 2), 1)
    keyed = docs.select("doc_id", F.xxhash64(first).alias("_f"), F.shiftright(F.col("doc_id").cast("long"), RANGE_BITS).alias("_r"))
    inside = keyed.withColumn("a_doc", F.lag("doc_id").over(Window.partitionBy("_f", "_r").orderBy("doc_id")))
    ranges = keyed.groupBy("_f", "_r").agg(F.max("doc_id").alias("_top"))
    earlier = ranges.select("_f", "_r", F.lag("_top").over(Window.partitionBy("_f").orderBy("_r")).alias("_before")).where("_before is not null")
    joined = inside.join(earlier, ["_f", "_r"], "left").withColumn("a_doc", F.coalesce("a_doc", "_before")).where("a_doc is not null")
    return joined.select(F.col("doc_id").alias("pair_id"), "a_doc", F.col("doc_id").alias("b_doc"))


def paired_documents(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents that are in a pair, once for each side of each pair: ``(pair_id, side, text)``."""
    sides = pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_doc").alias("doc_id")) for s in "ab"))).alias("s"))
    return sides.select("pair_id", "s.side", "s.doc_id").join(docs.select("doc_id", "text"), "doc_id").select("pair_id", "side", "text")


def increasing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of a longest run of candidate matches that cross none of each other; ``a`` ascends and no ``b`` comes twice.

    Patience: a candidate goes on the first pile whose top is behind it on side
    B. Then, from the last pile back, of each pile the last candidate before
    the one that was chosen last.
    """
    if len(b) < 2 or (np.diff(b) > 0).all():
        return np.arange(len(b))
    tops: list[int] = []
    pile: list[int] = []
    for x in b.tolist():
        k = bisect_left(tops, x)
        tops[k : k + 1] = [x]
        pile.append(k)
    chosen, sought = [], len(tops) - 1
    for i in range(len(pile) - 1, -1, -1):
        if pile[i] == sought:
            chosen.append(i)
            sought -= 1
    return np.array(chosen[::-1], np.int64)


def _matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of matching words of two texts given as numbers of words."""
    n = 1 + max(a.max(initial=0), b.max(initial=0))
    once = (np.bincount(a, minlength=n) == 1) & (np.bincount(b, minlength=n) == 1)
    of_b = np.zeros(n, np.int64)
    of_b[b] = np.arange(len(b))
    x = np.flatnonzero(once[a])
    y = of_b[a[x]]
    kept = increasing(x, y)
    x, y = x[kept], y[kept]

    def occurrences(words: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions off the anchors by the gap they are in, their word and their order; and each gap and word as one number, where it begins among them, and how often it is there."""
        free = np.ones(len(words), bool)
        free[anchors] = False
        at = np.flatnonzero(free)
        key = np.searchsorted(anchors, at) * n + words[at]
        order = np.argsort(key, kind="stable")
        return at[order], *np.unique(key[order], return_index=True, return_counts=True)

    a_at, a_key, a_first, a_count = occurrences(a, x)
    b_at, b_key, b_first, b_count = occurrences(b, y)
    _, of_a, of_b = np.intersect1d(a_key, b_key, assume_unique=True, return_indices=True)
    often = np.minimum(a_count[of_a], b_count[of_b])
    number = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
    more_x, more_y = a_at[np.repeat(a_first[of_a], often) + number], b_at[np.repeat(b_first[of_b], often) + number]
    every_x, every_y = np.concatenate([x, more_x]), np.concatenate([y, more_y])
    order = np.argsort(every_x)
    kept = order[increasing(every_x[order], every_y[order])]
    return every_x[kept], every_y[kept]


def _matched(pair: pa.Table) -> pa.Table:
    """The words of one pair with their partners and gaps."""
    pair = pair.sort_by([("side", "ascending"), ("pos", "ascending")])
    is_a = np.array([s == "a" for s in pair["side"].to_pylist()])
    word = pair["word"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pos = pair["pos"].to_numpy()
    x, y = _matches(word[is_a], word[~is_a])
    n = int(is_a.sum())
    partner, hit = np.full(len(pos), -1, np.int64), np.zeros(len(pos), np.int64)
    partner[x], partner[n + y] = pos[n + y], pos[x]
    hit[x] = hit[n + y] = 1
    gap = np.concatenate([np.cumsum(hit[:n]), np.cumsum(hit[n:])])
    return pair.select(["pair_id", "side", "pos", "word", "page_no"]).append_column("partner", pa.array(partner, pa.int32(), mask=partner < 0)).append_column("gap", pa.array(gap, pa.int64()))


def match_words(words: DataFrame) -> DataFrame:
    """Mark the words ``(pair_id, side, pos, word, page_no)`` with ``partner``, the matching position on the other side, and ``gap``, the matches up to there.

    Words that occur once on either side are anchors, of which a longest run
    that does not cross is kept. Between two anchors the k-th occurrences of a
    word match, again as far as they keep a longest run. A pair's words, whose
    number ``word_stream`` bounds, meet in one task, by one exchange.
    """
    schema = "pair_id long, side string, pos int, word string, page_no int, partner int, gap long"
    own = words.select(F.col("pair_id").cast("long").alias("pair_id"), "side", "pos", "word", "page_no")
    return own.groupBy("pair_id").applyInArrow(_matched, schema)


def word_diff(matched: DataFrame) -> DataFrame:
    """``(pair_id, a, b)``: positions of matching words, in the same order on both sides."""
    return matched.where("side = 'a' and partner is not null").select("pair_id", F.col("pos").alias("a"), F.col("partner").alias("b"))


def paired_texts(sides: DataFrame) -> DataFrame:
    """A row a pair of ``sides (pair_id, side, words, pages)``, as ``word_texts`` gives them: ``(pair_id, a_words, a_pages, b_words, b_pages)``."""
    of = [F.any_value(F.when(F.col("side") == s, F.col(c)), F.lit(True)).alias(f"{s}_{c}") for s in "ab" for c in ("words", "pages")]
    return sides.groupBy(F.col("pair_id").cast("long").alias("pair_id")).agg(*of)


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[str]], list[np.ndarray], list[np.ndarray]]]:
    """Of each pair: its id, and for both sides the words, their numbers and their pages."""
    held = []
    for s in "ab":
        pages = batch[f"{s}_pages"]
        held.append((batch[f"{s}_words"].to_pylist(), pages.offsets.to_numpy(), pages.values.to_numpy(zero_copy_only=False)))
    for i, pair in enumerate(batch["pair_id"].to_pylist()):
        known: dict[str, int] = {}
        words = [texts[i].split(" ") if texts[i] else [] for texts, _, _ in held]
        numbers = [np.array([known.setdefault(w, len(known)) for w in side], np.int64) for side in words]
        yield pair, words, numbers, [values[at[i] : at[i + 1]] for _, at, values in held]


def matching_words(pairs: DataFrame) -> DataFrame:
    """``(pair_id, a, b)``: positions of the matching words of ``paired_texts``, by the rules of ``match_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(pair, *_matches(*numbers)) for pair, _, numbers, _ in _sides(batch)]
            columns = [np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])]
            columns += [np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(np.int32) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pair_id", "a", "b"])

    return pairs.mapInArrow(run, "pair_id long, a int, b int")


def _runs(matched: np.ndarray, words: list[str], pages: np.ndarray) -> dict[int, tuple[str, int]]:
    """What stands between the matches of a side: by gap, its text, as far as a snippet shows it, and its first page."""
    ends = np.append(matched, len(words))
    begins = np.append(0, matched + 1)
    gaps = np.flatnonzero(ends > begins)
    starts = begins[gaps]
    # A word has a character at least, so that more words than a snippet's length are not seen.
    stops = np.minimum(ends[gaps], starts + SNIPPET + 1)
    return {g: (" ".join(words[i:j])[: SNIPPET + 1], p) for g, i, j, p in zip(gaps.tolist(), starts.tolist(), stops.tolist(), pages[starts].tolist(), strict=True)}


def diff_changes(pairs: DataFrame) -> DataFrame:
    """What stands between consecutive matches of ``paired_texts``: one change each, with its kind, snippets and first pages."""
    schema = pa.schema([("pair_id", pa.int64()), ("gap", pa.int64()), ("a_t", pa.string()), ("b_t", pa.string()), ("a_page", pa.int32()), ("b_page", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = ("", None)
        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            for pair, words, numbers, pages in _sides(batch):
                a, b = (_runs(m, w, p) for m, w, p in zip(_matches(*numbers), words, pages, strict=True))
                for gap in a.keys() | b.keys():
                    (a_t, a_page), (b_t, b_page) = a.get(gap, none), b.get(gap, none)
                    for column, value in zip(columns, (pair, gap, a_t, b_t, a_page, b_page), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def snippet(t: str) -> Column:
        return F.when(F.length(t) > SNIPPET, F.concat(F.substring(t, 1, SNIPPET - 1), F.lit("…"))).otherwise(F.col(t))

    both = pairs.mapInArrow(run, "pair_id long, gap long, a_t string, b_t string, a_page int, b_page int")
    kind = F.when(F.col("b_page").isNull(), "delete").when(F.col("a_page").isNull(), "insert").otherwise("replace")
    return both.select("pair_id", "gap", kind.alias("kind"), snippet("a_t").alias("a_text"), snippet("b_t").alias("b_text"), "a_page", "b_page")


def version_similarity(pairs: DataFrame) -> DataFrame:
    """Words of ``paired_texts`` kept, removed and added whatever their order, and the ratio of kept words; pairs without words are left out."""
    names = ("pair_id", "equal", "removed", "added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pair, _, (a, b), _ in _sides(batch):
                n = 1 + max(a.max(initial=0), b.max(initial=0))
                both = int(np.minimum(np.bincount(a, minlength=n), np.bincount(b, minlength=n)).sum())
                if len(a) or len(b):
                    rows.append((pair, both, len(a) - both, len(b) - both))
            columns = zip(*rows, strict=True) if rows else ([],) * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], list(names))

    n = pairs.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return n.withColumn("ratio", 2 * F.col("equal") / (2 * F.col("equal") + F.col("removed") + F.col("added")))


def compare_summary(extents: DataFrame, changes: DataFrame) -> DataFrame:
    """Per pair: pages of each side, changes, changed pages, whether the versions are identical, and ``truncated``: whether the feature's own limits would cut one of them.

    ``extents (pair_id, side, n_pages, truncated)`` has a row per side.
    """
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("n_pages"))).alias(f"{s}_page_count")
    sizes = extents.groupBy("pair_id").agg(of("a"), of("b"), F.bool_or("truncated").alias("truncated"))
    pages = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    n = changes.groupBy("pair_id").agg(F.count("*").alias("n"), pages("a_page").alias("a_pages"), pages("b_page").alias("b_pages"))
    told = [F.coalesce("n", F.lit(0)).alias("changes"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("a_pages", "b_pages")), F.col("n").isNull().alias("identical")]
    return sizes.join(n, "pair_id", "left").select("pair_id", "a_page_count", "b_page_count", *told, "truncated")


def box_refs(changes: DataFrame) -> DataFrame:
    """Number the boxes of each side and page so that every change points at its own, and order the changes.

    Changes go by their B page, else their A page, then the A page.
    """
    key = F.coalesce("b_page", "a_page", F.lit(0))
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy(key, F.coalesce("a_page", F.lit(0)), "gap")) - 1
    box = lambda p: F.when(F.col(p).isNotNull(), F.row_number().over(Window.partitionBy("pair_id", p).orderBy("gap")) - 1)
    return changes.select("pair_id", "gap", "kind", "a_page", "b_page", place.alias("change_no"), box("a_page").alias("a_box"), box("b_page").alias("b_box"))


def changes_selected(refs: DataFrame, picks: DataFrame) -> DataFrame:
    """Ticked changes that have a box on side B: ``picks (pair_id, b_page, b_box)``."""
    return refs.where(F.col("b_box").isNotNull()).join(picks, ["pair_id", "b_page", "b_box"], "left_semi")


def page_fingerprint(pages: DataFrame, bits: int = 16) -> DataFrame:
    """Gradient bits of the page's word lengths, its set of words, and its size in lines."""
    words = F.filter(F.split(F.lower("page_text"), r"\s+"), lambda w: w != "")
    keys = [c for c in ("pair_id", "side", "doc_id") if c in pages.columns]
    sized = pages.withColumn("_w", words)
    length = lambda i: F.coalesce(F.length(F.try_element_at("_w", i)), F.lit(0))
    grade = F.transform(F.sequence(F.lit(1), F.lit(bits)), lambda i: (length(i + 1) < length(i)).cast("int"))
    return sized.select(*keys, "page_no", F.array_join(F.transform(grade, lambda b: b.cast("string")), "").alias("bits"), F.array_distinct("_w").alias("words"), F.size(F.split("page_text", "\n")).alias("height"))


def first_pages(pages: DataFrame, most: int | None = MOST_PAGES) -> DataFrame:
    """The pages of each side that a comparison by pages reads: the first ``most``, by default the feature's own limit, or with None all."""
    return pages if most is None else pages.where(F.col("page_no") < most)


def page_similarity(a: DataFrame, b: DataFrame, least: float | None = None, most: int | None = MOST_PAGES) -> DataFrame:
    """Similarity of the first ``most`` pages of a pair's sides, or with None of all: ``(pair_id, a_page, b_page, similarity)``.

    Fingerprints agree by bits, less by 0.4 of that if the sizes differ; where
    either page has words, their Jaccard similarity weighs 0.3.

    With ``least``, only pairs of pages that are so much alike come out. Bits,
    sizes and the numbers of words bound the similarity, since a Jaccard
    similarity is at most the smaller number over the larger; the join drops
    what stays below by these alone, so that words are compared for the rest.
    """
    return page_candidates(a, b, least, most).where(F.lit(True) if least is None else F.col("similarity") >= least)


def page_candidates(a: DataFrame, b: DataFrame, least: float | None = None, most: int | None = MOST_PAGES) -> DataFrame:
    """The pairs of pages whose words ``page_similarity`` compares, with their similarities."""

    def side(pages: DataFrame, s: str) -> DataFrame:
        bits = F.conv("bits", 2, 10).cast("long")
        told = {"page_no": f"{s}_page", "words": f"{s}w", "height": f"{s}h"}
        return first_pages(pages, most).select("pair_id", bits.alias(f"{s}b"), F.length("bits").alias(f"{s}l"), F.size("words").alias(f"{s}n"), *(F.col(c).alias(n) for c, n in told.items()))

    alike = (1 - F.bit_count(F.col("ab").bitwiseXOR(F.col("bb"))) / F.col("al")) * F.when(F.col("ah") != F.col("bh"), 0.6).otherwise(1.0)
    some = (F.col("an") > 0) | (F.col("bn") > 0)
    told = lambda jaccard: F.when(some, 0.7 * alike + 0.3 * jaccard).otherwise(alike)
    at_most = told(F.least("an", "bn") / F.greatest("an", "bn", F.lit(1)))
    # The bound is rounded like the similarity, whose last digit may differ.
    x, y = side(a, "a"), side(b, "b")
    near = x["pair_id"] == y["pair_id"] if least is None else (x["pair_id"] == y["pair_id"]) & (at_most >= least - ROUNDING)
    # A page's words are distinct, so what both have tells how many there are.
    jaccard = bound(F.size(F.array_intersect("aw", "bw")), lambda k: k / F.greatest(F.col("an") + F.col("bn") - k, F.lit(1)))
    return x.join(y, near).select(x["pair_id"], "a_page", "b_page", told(jaccard).alias("similarity"))


def _diagonals(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the cells of a pair and anti-diagonal, which stand together but may go on in the next batch."""
    held: list[np.ndarray] = []
    for batch in batches:
        own = [c.to_numpy() for c in batch.columns]
        held = [np.concatenate(c) for c in zip(held, own, strict=True)] if held else own
        pair, _, _, a, b, _ = held
        ends = [0, *(np.flatnonzero((np.diff(pair) != 0) | (np.diff(a + b) != 0)) + 1).tolist()]
        for i, j in zip(ends, ends[1:], strict=False):
            yield [c[i:j] for c in held]
        held = [c[ends[-1] :] for c in held]
    if held and len(held[0]):
        yield held


def _alignment(n: int, m: int, diagonals: Iterator[list[np.ndarray]]) -> list[tuple[int, int, float]]:
    """The matches of the best way through a grid of ``n`` and ``m`` pages, whose cells that may match come by anti-diagonals.

    A cell needs the two diagonals before its own, whose totals are kept. For
    the way back stay a bit a cell, whether a page of A is skipped, and the
    matches that win.
    """
    before, last, here = np.zeros(n + 1), np.full(n + 1, GAP), np.zeros(n + 1)
    skips: list[np.ndarray] = []
    won: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    cells = next(diagonals, None)
    for d in range(2, n + m + 1):
        low, high = max(1, d - m), min(n, d - 1)
        up, left = last[low - 1 : high], last[low : high + 1]
        here[0] = here[min(d, n)] = d * GAP
        here[low : high + 1] = np.maximum(up, left) + GAP
        skips.append(np.packbits(up >= left))
        if cells is not None and cells[3][0] + cells[4][0] == d - 2:
            at, sim = cells[3], cells[5]
            total = before[at] + sim
            wins = total >= here[at + 1]
            here[at[wins] + 1] = total[wins]
            won[d] = at[wins], sim[wins]
            cells = next(diagonals, None)
        before, last, here = last, here, before
    found, none = [], (np.zeros(0, np.int32), np.zeros(0))
    i, j = n, m
    while i and j:
        at, sim = won.get(i + j, none)
        k, x = int(at.searchsorted(i - 1)), i - max(1, i + j - m)
        if k < len(at) and at[k] == i - 1:
            i, j = i - 1, j - 1
            found.append((i, j, float(sim[k])))
        elif skips[i + j - 2][x >> 3] >> (7 - (x & 7)) & 1:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def page_align(a: DataFrame, b: DataFrame, similarities: DataFrame, most: int | None = MOST_PAGES) -> DataFrame:
    """Monotone alignment of each pair's pages with the best total: ``(pair_id, a_page, b_page, similarity)``.

    ``a`` and ``b`` have the pages of the sides, of which the first ``most``
    take part, or with None all; ``similarities`` those pairs of pages that are
    0.5 alike at least or less than that by rounding alone, others may be left
    out. An unmatched page scores 0.25, so no others match; of equal moves a
    match wins, then skipping a page of A. Totals count as their sums are
    rounded.

    The cells of a pair come to one task in the order of the grid's
    anti-diagonals, so that they are read as they come and never stand in a row
    or a list together.
    """
    extent = lambda pages, n: first_pages(pages, most).groupBy("pair_id").agg((F.max("page_no") + 1).alias(n))
    sizes = extent(a, "_n").join(extent(b, "_m"), "pair_id")
    own = similarities.where(F.col("similarity") >= 2 * GAP - ROUNDING).join(sizes, "pair_id").where((F.col("a_page") < F.col("_n")) & (F.col("b_page") < F.col("_m")))
    cells = own.select(F.col("pair_id").cast("long").alias("pair_id"), *(F.col(c).cast("int").alias(c) for c in ("_n", "_m", "a_page", "b_page")), "similarity")
    placed = cells.repartition("pair_id").sortWithinPartitions("pair_id", F.col("a_page") + F.col("b_page"), "a_page")
    schema = pa.schema([("pair_id", pa.int64()), ("a_page", pa.int32()), ("b_page", pa.int32()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, float]] = []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        sized = lambda cells: tuple(int(c[0]) for c in cells[:3])
        for (pair, n, m), diagonals in groupby(_diagonals(batches), sized):
            rows += [(pair, *match) for match in _alignment(n, m, diagonals)]
            if len(rows) >= BATCH:
                yield told()
                rows.clear()
        if rows:
            yield told()

    return placed.mapInArrow(run, "pair_id long, a_page int, b_page int, similarity double")


def align_summary(a: DataFrame, b: DataFrame, alignment: DataFrame, most: int | None = MOST_PAGES) -> DataFrame:
    """Per pair: pages of each side, pages that match, pages of either side alone, and ``truncated``: whether a side has more than ``most`` pages.

    With None pages count to the last one; ``truncated`` then still tells which
    pairs the feature's own limit would cut.
    """
    pages = a.select("pair_id", "page_no", F.lit("a").alias("side")).unionByName(b.select("pair_id", "page_no", F.lit("b").alias("side")))
    n = lambda s: (F.coalesce(F.max(F.when(F.col("side") == s, F.col("page_no"))), F.lit(-1)) + 1).alias(f"pages_{s}")
    sizes = pages.groupBy("pair_id").agg(n("a"), n("b"))
    told = sizes.join(alignment.groupBy("pair_id").agg(F.count("*").alias("n")), "pair_id", "left").withColumn("matched", F.coalesce("n", F.lit(0)))
    read = lambda s: F.col(f"pages_{s}") if most is None else F.least(F.col(f"pages_{s}"), F.lit(most))
    alone = lambda s: (read(s) - F.col("matched")).alias(f"only_{s}")
    return told.select("pair_id", "pages_a", "pages_b", "matched", alone("a"), alone("b"), (F.greatest("pages_a", "pages_b") > (MOST_PAGES if most is None else most)).alias("truncated"))


def unmatched_pages(a: DataFrame, b: DataFrame, alignment: DataFrame, most: int | None = MOST_PAGES) -> DataFrame:
    """Pages without a partner among the first ``most``, or with None among all: removed ones of A, inserted ones of B, each as a change of the whole page."""
    a, b = first_pages(a, most), first_pages(b, most)
    gone = a.select("pair_id", F.col("page_no").alias("a_page")).join(alignment, ["pair_id", "a_page"], "left_anti").select("pair_id", F.lit("del").alias("kind"), F.col("a_page").alias("page_no"))
    new = b.select("pair_id", F.col("page_no").alias("b_page")).join(alignment, ["pair_id", "b_page"], "left_anti").select("pair_id", F.lit("ins").alias("kind"), F.col("b_page").alias("page_no"))
    return gone.unionByName(new)
