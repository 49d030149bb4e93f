"""Spelling variants by search schemes over suffix-rank indexes of the vocabulary.

A word one edit away keeps either its first or its second half as it is. So each
word is looked up twice: its second half is matched exactly, backwards from the
delimiter behind it, and extended over the first half with one error allowed;
and the same the other way round, over the index of the reversed vocabulary.
Both directions together are the bidirectional index; as every word stands
between delimiters, each search starts at one and needs a single direction.

The vocabulary is dealt into buckets by half words: a word is indexed under the
halves that its near words may have (two on either side) and looked up under its
own. A bucket has an index of its own, of bounded size; one that has more words
is dealt into slices, each of which its queries visit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

#: Letters, as runs of the text.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Queries of a bucket that are searched in step.
AT_ONCE = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, shortest: int = 7, least: int = 2, drop_one_in: int | None = 31) -> DataFrame:
    """``(word, n)``: the words of all texts, A-Z in lower case, that occur ``least`` times.

    With ``drop_one_in``, a run of a document loses a letter where the crc32 of
    ``doc_id:run`` is divisible by it; that makes the misspellings that the
    contract asks for. A null text has no words, a null id counts as empty.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if drop_one_in:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
        at = F.pmod("h", F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % drop_one_in == 0, less).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _flat(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each begins."""
    lengths = np.fromiter(map(len, some), np.int64, len(some))
    points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points.astype(np.int64), np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


@dataclass
class SuffixRanks:
    """A full-text index of ``$word$word$...$``: suffix ranks, and steps of their intervals to the left."""

    letters: np.ndarray  # sorted code points; a letter's code is its place + 1, the delimiter's is 0
    before: np.ndarray  # the code before the suffix of each rank
    keys: np.ndarray  # ranks sorted by (code before, rank): a step to the left is a place in here
    word: np.ndarray  # for the ranks of suffixes that begin with a delimiter, the word behind it

    @classmethod
    def of(cls, some: list[str]) -> SuffixRanks:
        points, starts = _flat(some)
        letters, codes = np.unique(points, return_inverse=True)
        text = np.zeros(len(points) + len(some) + 1, np.int64)
        text[np.arange(len(points)) + np.repeat(np.arange(len(some)), np.diff(starts)) + 1] = codes + 1
        # The first letters of each suffix are packed into one number, then ranks double their reach.
        bits = max(1, int(len(letters)).bit_length())
        reach = 62 // bits
        rank = np.zeros(len(text), np.int64)
        for k in range(reach):
            rank <<= bits
            rank[: max(0, len(text) - k)] |= text[k:]
        while True:
            order = np.argsort(rank, kind="stable")
            ordered = rank[order]
            fresh = np.zeros(len(text), np.int64)
            fresh[order] = np.cumsum(np.concatenate([np.zeros(1, bool), ordered[1:] != ordered[:-1]]))
            if fresh[order[-1]] == len(text) - 1 or reach >= len(text):
                break
            rank = fresh * (len(text) + 1)
            rank[: len(text) - reach] += fresh[reach:] + 1
            reach *= 2
        before = text[order - 1]
        by_code = np.argsort(before, kind="stable")
        first = order[: len(some) + 1]
        return cls(letters, before, before[by_code] * len(text) + by_code, np.searchsorted(starts + np.arange(len(starts)), first))

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Codes of letters; -1 for one that the index does not have."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, -1)

    def step(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one more letter on the left; an unknown letter's is empty."""
        base = code * len(self.before)
        low = np.searchsorted(self.keys, base + low)
        return low, np.where(code < 0, low, np.searchsorted(self.keys, base + high))

    def children(self, low: np.ndarray, high: np.ndarray, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """(interval, letter) for all letters, the delimiter left out, that stand on the left within each interval.

        A small interval is read, a large one is tried with each letter, so the work does not follow its size.
        """
        width = len(self.letters) + 1
        little = np.flatnonzero(high - low <= small)
        rows, owner = spread(low[little], high[little])
        found = np.unique(little[owner] * width + self.before[rows])
        large = np.flatnonzero(high - low > small)
        owner, code = found // width, found % width
        owner, code = np.concatenate([owner[code > 0], np.repeat(large, width - 1)]), np.concatenate([code[code > 0], np.tile(np.arange(1, width), len(large))])
        return owner, code

    def near(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one edit apart whose last ``exact`` letters, as many as each query says, agree.

        A pair comes out once. Steps go over all queries at a time.
        """
        points, starts = _flat(queries)
        codes = self.codes(points) if len(self.letters) else np.full(len(points), -1)
        n, low = len(queries), np.zeros(len(queries), np.int64)
        high = np.full(n, len(self.word), np.int64)  # the delimiter behind a word
        left = np.diff(starts)  # letters still to match
        q = np.arange(n)
        edge = left - exact

        while len(turn := np.flatnonzero((left > edge) & (low < high))):
            low[turn], high[turn] = self.step(low[turn], high[turn], codes[starts[turn] + left[turn] - 1])
            left[turn] -= 1
        alive = low < high
        clean = [x[alive] for x in (q, left, low, high)]
        erred: list[list[np.ndarray]] = []
        done: list[np.ndarray] = []
        while len(clean[0]) or erred:
            # With an error behind them, states go on without another.
            if erred:
                q, left, low, high = (np.concatenate(x) for x in zip(*erred, strict=True))
                out = left == 0
                a, b = self.step(low[out], high[out], np.zeros(out.sum(), np.int64))
                rows, owner = spread(a, b)
                done.append(q[out][owner] * (len(self.word) + 1) + self.word[rows])
                q, left, low, high = q[~out], left[~out], low[~out], high[~out]
                low, high = self.step(low, high, codes[starts[q] + left - 1])
                some = low < high
                erred = [[q[some], left[some] - 1, low[some], high[some]]] if some.any() else []
            if len(clean[0]):
                q, left, low, high = clean
                some = left > 0
                erred.append([q[some], left[some] - 1, low[some], high[some]])  # a letter less in the word
                owner, code = self.children(low, high)
                a, b = self.step(low[owner], high[owner], code)
                some = a < b
                owner, code, a, b = owner[some], code[some], a[some], b[some]
                erred.append([q[owner], left[owner], a, b])  # a letter more
                more = left[owner] > 0
                owner, code, a, b = owner[more], code[more], a[more], b[more]
                same = codes[starts[q[owner]] + left[owner] - 1] == code
                erred.append([q[owner[~same]], left[owner[~same]] - 1, a[~same], b[~same]])  # another letter
                clean = [q[owner[same]], left[owner[same]] - 1, a[same], b[same]]
                erred = [x for x in erred if len(x[0])]
        found = np.unique(np.concatenate(done)) if done else np.zeros(0, np.int64)
        return found // (len(self.word) + 1), found % (len(self.word) + 1)


def _best(table: pa.Table) -> pa.Table:
    """One bucket's part of the result: for each of its queries the near words' number and the most frequent of them.

    Buckets of side 0 hold words by first halves: these are searched reversed.
    """
    side = table["side"][0].as_py() if table.num_rows else 0
    rows = {role: table.filter(pa.array(table["query"].to_numpy(zero_copy_only=False) == role)) for role in (False, True)}
    counts = dict(zip(rows[False]["word"].to_pylist(), rows[False]["n"].to_pylist(), strict=True))
    own = sorted(counts)
    asked = sorted(rows[True]["word"].to_pylist())
    turned = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
    out: list[tuple] = []
    if own and asked:
        index = SuffixRanks.of([turned(w) for w in own])
        n = np.array([counts[w] for w in own], np.int64)
        for k in range(0, len(asked), AT_ONCE):
            some = asked[k : k + AT_ONCE]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            half = lengths // 2
            q, w = index.near([turned(x) for x in some], half if side == 0 else lengths - half)
            if side:  # what has the first half too is found on the other side
                fresh = np.fromiter((not own[j].startswith(some[i][: half[i]]) for i, j in zip(q, w, strict=True)), bool, len(q))
                q, w = q[fresh], w[fresh]
            order = np.lexsort((w, -n[w], q))
            q, w = q[order], w[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            for i, j, near in zip(q[first], w[first], np.diff(first, append=len(q)), strict=True):
                out.append((some[i], int(near), int(n[j]), own[j]))
    columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n_near", "near_n", "near"])


def near_words(vocabulary: DataFrame, bucket: int = 40_000, few: int = 100_000) -> DataFrame:
    """``(word, n_near, near, near_n)`` for each word of ``vocabulary (word, n)`` that has near words.

    ``n_near`` words differ from it by exactly one inserted, deleted or
    replaced letter; ``near`` is the most frequent of them, of equal ones the
    smallest in code-point order. Words are distinct and have three letters at
    least. About ``bucket`` words make an index. The words of each bucket are
    counted; up to ``few`` counts are broadcast, more are joined.
    """
    size = F.length("word")

    def keys(lengths: list[Column]) -> list[Column]:
        halves = [F.floor(x / 2).cast("int") for x in lengths]
        first = F.transform(F.array_distinct(F.array(*halves)), lambda m: F.struct(F.lit(0).alias("side"), F.left(F.col("word"), m).alias("half")))
        second = F.transform(F.array_distinct(F.array(*(x - m for x, m in zip(lengths, halves, strict=True)))), lambda m: F.struct(F.lit(1).alias("side"), F.right(F.col("word"), m).alias("half")))
        return F.explode(F.concat(first, second)).alias("key")

    buckets = max(1, -(-4 * vocabulary.count() // bucket))
    place = (F.col("key.side") + 2 * F.pmod(F.xxhash64("key.half"), F.lit(buckets))).alias("bucket")
    posted = vocabulary.select("word", "n", keys([size - 1, size, size + 1])).select(place, F.col("key.side").alias("side"), "word", "n")
    asked = vocabulary.select("word", "n", keys([size])).select(place, F.col("key.side").alias("side"), "word", "n")
    slices = posted.groupBy("bucket").agg(F.ceil(F.count("*") / (2 * bucket)).cast("int").alias("slices"))
    if 2 * buckets <= few:
        slices = F.broadcast(slices)
    posted = posted.join(slices, "bucket").withColumn("slice", F.pmod(F.xxhash64("word", F.lit("slice")), F.col("slices")).cast("int"))
    asked = asked.join(slices, "bucket").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = posted.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))
    found = rows.select("bucket", "slice", "side", "query", "word", "n").groupBy("bucket", "slice").applyInArrow(_best, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """``(word, root)``: where the steps ``(word, form)`` end, for every word that has one.

    Steps lead to ever more frequent words, so they end. Each round doubles
    their length and is cut by a checkpoint.
    """
    at = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        far = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = cut(at.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at
    raise RuntimeError(f"forms did not end in {2**rounds} steps")


def variants(vocabulary: DataFrame, times: int = 10, bucket: int = 40_000) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of ``vocabulary (word, n)``.

    ``form`` is the word's most frequent near word where that is at least
    ``times`` as frequent as the word, else null; ``root`` is the end of the
    steps from form to form. An empty vocabulary gives an empty result.
    """
    vocabulary = cut(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(vocabulary, bucket)
    frequent = F.col("near_n") >= times * F.col("n")
    found = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("near")).alias("form"), F.when(frequent, F.col("near_n")).alias("form_n")
    )
    found = cut(found)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
