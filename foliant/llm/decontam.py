"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are word sequences; an item leaks if some stretch of a document is
within an edit distance of ``edits`` times the item's words. The CGK random
walk copies a sequence into a longer string: at each step it writes the
current word and moves on or stays, as a random bit of step and word says. A
small edit distance becomes a small Hamming distance, and sampling a few
positions of the string gives a key that near sequences share. The sampling is
repeated until a pair at the Hamming share measured for its size is missed with
probability below ``1 - recall``. Windows that share a key with an item are
aligned with it exactly.

Only windows near a seed are embedded: with k edits, one of any k + 1 disjoint
parts of an item survives in place, so an item's window holds one of its parts
at most k words away from where the item has it. Around each such part, windows
of the item's size are embedded at every start within that bound. That loses no
leak.

The longer a text, the larger the share of the string that its edits upset, so
long items are embedded by blocks of bounded size. Of an item within its bound
of edits, one block at least is within the bound of its own size; the alignment
is with the whole item. That loses no leak either.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(64, _MIX))
#: Most words of a block.
BLOCK = 40
#: Block sizes up to the first figure are given the second as their Hamming share. Chosen by recall at the edit bound of
#: a fifth, for edits of one kind as for mixed ones: deletions alone, the worst kind, upset the largest share.
SHARES = ((9, 0.6), (20, 0.7), (BLOCK, 0.74))


def letters_and_digits() -> np.ndarray:
    """Which characters make words; those beyond the first plane all do."""
    return np.array([chr(i).isalnum() for i in range(1 << 16)] + [True])


def hashed_words(texts: list[str | None], in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's words begin."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(np.diff(in_word[np.minimum(codes, 1 << 16)], prepend=False))
    starts = edge[::2]
    first_char = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    bounds = np.searchsorted(starts, first_char)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    at = np.arange(edge[0], len(codes)) - np.repeat(edge, np.diff(edge, append=len(codes)))
    mixed = _blur(codes[edge[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[at & 63]
    return _blur(np.add.reduceat(mixed, edge - edge[0])[::2]), bounds


def word_hashes(text: str | None) -> np.ndarray:
    return hashed_words([text], letters_and_digits())[0]


def bound(n: int, edits: float) -> int:
    """Word edits that an item of n words allows."""
    return int(edits * n + 1e-9)


def parts(n: int, edits: float) -> list[tuple[int, int]]:
    """Start and length of the k + 1 disjoint parts of an item of n words."""
    k = bound(n, edits)
    edge = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def blocks(n: int) -> list[tuple[int, int]]:
    """Start and size of the blocks of an item of n words."""
    m = math.ceil(n / BLOCK)
    edge = [n * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def _blur(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cgk(windows: np.ndarray, lengths: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Embed word windows (rows, padded) into strings of ``steps`` symbols; 0 stands behind the end."""
    n = np.arange(len(windows))
    at = np.zeros(len(windows), np.int64)
    out = np.zeros((len(windows), steps), np.uint64)
    padded = np.concatenate([windows, np.zeros((len(windows), 1), np.uint64)], 1)
    for t in range(steps):
        symbol = np.where(at < lengths, padded[n, np.minimum(at, windows.shape[1])], 0)
        out[:, t] = symbol
        bit = _blur(symbol + np.uint64((seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)
        at += bit.astype(np.int64)
    return out


def repetitions(recall: float, differ: float, bits: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))


def block_keys(sequences: list[np.ndarray], sizes: np.ndarray, marks: np.ndarray, recall: float, differ: float | None, bits: int) -> list[np.ndarray]:
    """The keys of each sequence, as many as its block size needs for the recall."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
    low = 0
    for high, share in SHARES:
        own = np.flatnonzero((low < sizes) & (sizes <= high))
        low = high
        if len(own):
            repeats = repetitions(recall, share if differ is None else differ, bits)
            for i, k in zip(own, lsh_keys([sequences[i] for i in own], sizes[own], marks[own], repeats, bits), strict=True):
                out[i] = k
    return out


def lsh_keys(sequences: list[np.ndarray], sizes: np.ndarray, marks: np.ndarray, repeats: int, bits: int) -> np.ndarray:
    """One key per sequence and repetition; ``sizes`` are the block sizes whose positions are sampled, and only equal ``marks`` meet."""
    lengths = np.array([len(s) for s in sequences])
    grid = np.zeros((len(sequences), int(lengths.max(initial=1))), np.uint64)
    for i, s in enumerate(sequences):
        grid[i, : len(s)] = s
    keys = np.zeros((len(sequences), repeats), np.uint64)
    for r in range(repeats):
        rng = np.random.default_rng(1000 + r)
        spread = rng.random(bits)
        # Two walks in three move on by the end of the block at twice its length.
        string = cgk(grid, lengths, int(2 * sizes.max(initial=1)), r)
        key = _blur(np.full(len(sequences), r + 1, np.uint64))
        for x in spread:
            key = _blur(key ^ string[np.arange(len(sequences)), (x * 2 * sizes).astype(np.int64)])
        keys[:, r] = _blur(key + marks.astype(np.uint64))
    return keys.astype(np.int64)


_START = 1 << 32
_FAR = 1 << 62


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max(initial=0))), np.uint64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


def alignments(items: list[np.ndarray], stretches: list[np.ndarray]) -> np.ndarray:
    """Per pair, the least edits between the item and a part of the stretch, and that part's start and end; of equal parts the shortest, then the first."""
    a, a_len = _padded(items)
    b, b_len = _padded(stretches)
    at = np.arange(b.shape[1] + 1)
    # One number holds the cost and, below it, how early the part starts: a later start is the shorter part.
    cell = np.tile(_START - 1 - at, (len(items), 1)).astype(np.int64)
    for i in range(a.shape[1]):
        new = cell + _START  # the item's word is missing
        new[:, 1:] = np.minimum(new[:, 1:], cell[:, :-1] + _START * (b != a[:, i : i + 1]))
        new = np.minimum.accumulate(new - _START * at, axis=1) + _START * at  # words too many
        cell = np.where((i < a_len)[:, None], new, cell)
    cost, start = cell // _START, _START - 1 - cell % _START
    ranked = np.where(at <= b_len[:, None], cost * _START + (at - start), _FAR)
    end = ranked.argmin(1)
    n = np.arange(len(items))
    return np.stack([cost[n, end], start[n, end], end], 1) if len(items) else np.zeros((0, 3), np.int64)


def best_alignment(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    return tuple(int(x) for x in alignments([item], [stretch])[0])


class ItemIndex:
    """What the tasks need of one slice of the items: their parts, by length and hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], edits: float):
        self.edits = edits
        self.sizes = [len(w) for _, w in items]
        self.vocabulary = np.zeros(1 << 20, bool)
        for _, w in items:
            self.vocabulary[w >> np.uint64(44)] = True
        found: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for i, (_, w) in enumerate(items):
            for first, size in blocks(len(w)):
                for at, length in parts(size, edits):
                    own = w[first + at : first + at + length]
                    found[length].append((int(self.roll(own, length)[0]), i, at, first, size))
        self.parts = {}
        for length, rows in found.items():
            rows.sort()
            self.parts[length] = tuple(np.array([r[j] for r in rows], np.uint64 if j == 0 else np.int64) for j in range(5))

    @staticmethod
    def roll(h: np.ndarray, length: int) -> np.ndarray:
        n = len(h) - length + 1
        out = np.zeros(max(n, 0), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length if n > 0 else 0):
                out = _blur(out * _MIX + h[j : j + n])
        return out

    def seeds(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """Text, place where the block would start, item size, the block's start in the item and size, and the part's start in the block, of the parts that the texts hold."""
        out = set()
        ok = self.vocabulary[h >> np.uint64(44)]
        for length, (keys, items, ats, firsts, block_sizes) in self.parts.items():
            n = len(h) - length + 1
            if n < 1:
                continue
            all_known = ok[:n].copy()
            for j in range(1, length):
                all_known &= ok[j : j + n]
            at = np.flatnonzero(all_known)
            rolled = np.zeros(len(at), np.uint64)
            for j in range(length):
                rolled = _blur(rolled * _MIX + h[at + j])
            low = np.searchsorted(keys, rolled)
            low[low == len(keys)] = 0
            for k in np.flatnonzero(keys[low] == rolled):
                p, j = int(at[k]), low[k]
                text = int(np.searchsorted(bounds, p, "right")) - 1
                while p + length <= bounds[text + 1] and j < len(keys) and keys[j] == rolled[k]:
                    out.add((text, p - int(bounds[text]) - int(ats[j]), self.sizes[items[j]], int(firsts[j]), int(block_sizes[j]), int(ats[j])))
                    j += 1
        return sorted(out)


def find_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, recall: float = 0.99, differ: float | None = None, bits: int = 2, slice_words: int = 1_000_000) -> DataFrame:
    """``(doc_id, item_id, edits, item_words, start, end)``: the closest stretch of each leak, in words.

    A word is a run of letters and digits, in lower case; punctuation and line
    breaks do not count. Null and wordless texts and items match nothing. Items
    are taken in slices of at most about ``slice_words`` words, so what the
    driver and a task hold of them has a bound; each slice reads the documents
    once. Repeated rows give one row; a null id on either side is kept; ids are
    read as longs. Other columns are not read. ``differ`` takes the place of
    ``SHARES``, which hold for edits of a fifth.
    """
    spark = docs.sparkSession
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = listed.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / 5 / slice_words))
    found = None
    for part in range(slices):
        rows = listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).distinct().collect()
        own = [(r["item_id"], h) for r in rows if len(h := word_hashes(r["text"]))]
        got = _leaks_of(spark, docs, own, edits, recall, differ, bits)
        found = got if found is None else found.unionByName(got)
    return found


def _mark(n: int, first: int) -> int:
    """One number for an item size and a block's start."""
    return n + (first << 32)


class ItemKeys:
    """The LSH keys of all blocks of the items of a slice, in order, with the item of each."""

    def __init__(self, own: list[tuple[int, np.ndarray]], recall: float, differ: float | None, bits: int):
        self.how = (recall, differ, bits)
        cuts = [(i, h, first, size) for i, (_, h) in enumerate(own) for first, size in blocks(len(h))]
        sizes, marks = np.array([c[3] for c in cuts], np.int64), np.array([_mark(len(h), first) for _, h, first, _ in cuts], np.int64)
        keys = block_keys([h[first : first + size] for _, h, first, size in cuts], sizes, marks, *self.how)
        flat = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.keys, self.items = flat[order], np.repeat(np.array([c[0] for c in cuts], np.int32), [len(k) for k in keys])[order]

    def met(self, windows: list[np.ndarray], sizes: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
        """The items that share a key with each window."""
        keys = block_keys(windows, sizes, marks, *self.how)
        flat, owner = np.concatenate([*keys, np.zeros(0, np.int64)]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        low, high = np.searchsorted(self.keys, flat), np.searchsorted(self.keys, flat, "right")
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(windows)
        hit = np.flatnonzero(high > low)
        for k in hit:
            out[owner[k]] = np.union1d(out[owner[k]], self.items[low[k] : high[k]])
        return out


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals with those that overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _leaks_of(spark, docs: DataFrame, own: list[tuple[int, np.ndarray]], edits: float, recall: float, differ: float | None, bits: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((ItemIndex(own, edits), ItemKeys(own, recall, differ, bits), own))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches around windows that share a key with an item, and the item."""
        index, keys, _ = sent.value
        in_word = letters_and_digits()
        texts: list[tuple[int | None, np.ndarray]] = []
        tried: list[tuple[int, int, int, int, int]] = []

        def met() -> pa.RecordBatch:
            """What the windows gathered so far meet: keys of many windows at a time."""
            found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for k in range(0, len(tried), 4000):
                some = tried[k : k + 4000]
                sizes, marks = np.array([x[4] for x in some], np.int64), np.array([_mark(x[2], x[3]) for x in some], np.int64)
                got = keys.met([texts[t][1][max(0, s) : max(0, s + size)] for t, s, _, _, size in some], sizes, marks)
                for (t, s, n, first, _), items in zip(some, got, strict=True):
                    # The stretch around an item has room for all edits on either side.
                    slack = 2 * bound(n, edits)
                    for item in items:
                        found[t, int(item)].append((max(0, s - first - slack), min(len(texts[t][1]), max(0, s - first + n + slack))))
            rows = [(texts[t][0], item, o, texts[t][1][o:e].astype(np.int64)) for (t, item), spans in found.items() for o, e in _merged(spans)]
            texts.clear()
            tried.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["doc_id", "item", "origin", "words"])

        for b in batches:
            ids, written = b["doc_id"].to_pylist(), b["text"].to_pylist()
            for i in range(0, len(ids), 256):
                h, bounds = hashed_words(written[i : i + 256], in_word)
                # Words in front of a seed may have been deleted or added, so the block may start later or earlier.
                # Parts of one block mostly ask for the same windows.
                windows = sorted({(t, s + d, n, first, size) for t, s, n, first, size, at in index.seeds(h, bounds) for d in range(-bound(size, edits), min(at, bound(size, edits)) + 1)})
                last = None
                for t, *window in windows:
                    if t != last:
                        texts.append((ids[i + t], h[bounds[t] : bounds[t + 1]].copy()))
                        last = t
                    tried.append((len(texts) - 1, *window))
                if len(tried) >= 4000 or sum(len(w) for _, w in texts) > 4_000_000:
                    yield met()
        if tried:
            yield met()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value[2]
        for b in batches:
            out = []
            columns = [b[c].to_pylist() for c in ("doc_id", "item", "origin", "words")]
            rows = sorted(zip(*columns, strict=True), key=lambda r: len(own[r[1]][1]))
            for k in range(0, len(rows), 200):  # of about one length, so padding is little
                some = rows[k : k + 200]
                got = alignments([own[r[1]][1] for r in some], [np.array(r[3], np.int64).astype(np.uint64) for r in some])
                for (d, i, o, _), (e, s, t) in zip(some, got.tolist(), strict=True):
                    n = len(own[i][1])
                    if e <= bound(n, edits):
                        out.append((d, own[i][0], e, n, o + s, o + t))
            names = ["doc_id", "item_id", "edits", "item_words", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6, names)

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(candidates, "doc_id long, item int, origin long, words array<long>")
    # Dealt anew, by number and not by bytes: documents with leaks may lie together, and aligning is where their work is.
    held = held.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "item", "origin")
    leaks = held.mapInArrow(align, "doc_id long, item_id long, edits long, item_words long, start long, end long")
    best = leaks.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "end", "item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.edits", "b.item_words", "b.start", "b.end")
