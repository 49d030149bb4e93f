"""Alignment of two tokenizers over a corpus, with an inverted index of their linked ids.

Every text is cut by a byte-level tokenizer A and a sentencepiece tokenizer B.
Tokens whose bytes overlap are linked. For each pair of ids the index holds, by
chunk of documents, compressed bitmaps of the documents: plane k has those whose
number of links has bit k set. The planes merged by OR are the documents that
hold the pair; their popcounts, summed over the chunks, are its document count,
and those of the planes, each times its power of two, its link count. With the
counts joined to them, the postings go back to their chunks and give every
document its score.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import Numbers, numbered, sliced, spread, stored

#: Both tokenizers have an edge in front of a blank between two characters that are no white space, so the parts between such blanks stand for themselves.
PART = re.compile(r"\A\s+\S*(?:(?! \S)\s+\S*)*| \S+(?:(?! \S)\s+\S*)*")
#: Without these, all blanks are such blanks.
CLOSE = re.compile(r"\s | \s|\A\s|\s\Z")
#: Documents of a chunk, which a bitmap numbers by two bytes; and numbers in a plane from which a bit set is shorter.
CHUNK, DENSE = 1 << 16, 1 << 12


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        of = {c: b for b, c in enumerate(byte_letters())}
        with open(byte_path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{piece_path} has pieces across blanks")

    def __call__(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of texts with a blank in front, which B puts there itself."""
        return [e.ids for e in self.a.encode_batch_fast([f" {u}" for u in units], add_special_tokens=False)], self.b.encode(units, num_threads=1)


class Aligned:
    """The alignments of the units met so far: numbers, groups as text, and linked pairs of ids in one row."""

    def __init__(self, tokenizers: Tokenizers, units: int, links: int = 8_000_000):
        self.tokenizers, self.units, self.links = tokenizers, units, links
        self.width = len(tokenizers.b_bytes)
        self.a_text, self.b_text = ([[f"{i}{c}" for i in range(len(x))] for c in (",", end)] for x, end in ((tokenizers.a_bytes, "|"), (tokenizers.b_bytes, ";")))
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_links, whether the unit comes back whole
        self.pairs, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def numbers(self, said: list[list[str]]) -> np.ndarray:
        """The numbers of all units of the texts in a row, new ones aligned."""
        if len(self.number) > self.units or len(self.pairs) > self.links:
            self.clear()
        known = len(self.number)
        which = self.number.of(said)
        fresh = list(islice(self.number, known, None))
        for k in range(0, len(fresh), 20_000):
            self._learn(fresh[k : k + 20_000])
        return which

    def _learn(self, units: list[str]) -> None:
        t = self.tokenizers
        a_ids, b_ids = t(units)
        for side, ids in ((t.a_bytes, a_ids), (t.b_bytes, b_ids)):  # as a rule all come back
            if b"".join([side[i] for x in ids for i in x]) != "".join([f" {u}" for u in units]).encode():
                break
        else:
            side = None
        whole = np.ones(len(units), bool)
        if side is not None:
            for i, u in enumerate(units):
                whole[i] = b"".join(t.a_bytes[x] for x in a_ids[i]) == b"".join(t.b_bytes[x] for x in b_ids[i]) == f" {u}".encode()
                if not whole[i]:
                    a_ids[i], b_ids[i] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a_ids, b_ids))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, n.sum()) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
        a_unit, b_unit = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        low, high = np.searchsorted(b_end, a_end - t.a_sizes[a], "right"), np.searchsorted(b_end, a_end, "left") + 1
        other, own = spread(low, high)
        a_last, b_last = np.isin(a_end, b_end), np.isin(b_end, a_end)
        n_links = np.bincount(a_unit, high - low, len(units)).astype(np.int64)
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, np.bincount(a_unit, a_last, len(units)).astype(np.int64), n_links, whole], 1)])
        self.pairs = np.concatenate([self.pairs, a[own] * self.width + b[other]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n_links)])
        # A group's tokens of A, then those of B; groups are numbered by their ends.
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.lexsort((np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)]), np.concatenate([a_group, b_group])))
        texts = [self.a_text[e][i] for i, e in zip(a.tolist(), a_last.tolist(), strict=True)] + [self.b_text[e][i] for i, e in zip(b.tolist(), b_last.tolist(), strict=True)]
        texts = [texts[i] for i in order.tolist()]
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_a + n_b)]).tolist()
        self.groups += ["".join(texts[i:j]) for i, j in zip(edges, edges[1:], strict=False)]


def units(text: str | None) -> list[str]:
    """The parts of a text that both tokenizers cut for themselves, each without the blank in front of it."""
    if not text:
        return []
    if not CLOSE.search(text):
        return text.split(" ")
    whole = f" {text}"
    found = PART.findall(whole)
    return [u[1:] for u in found] if sum(map(len, found)) == len(whole) else [text]


def pack(rows: np.ndarray, numbers: np.ndarray, n: int) -> pa.BinaryArray:
    """``n`` bitmaps; bitmap ``rows[i]`` holds ``numbers[i]``, rows and the numbers of each ascending.

    Few numbers are written as they are, many as a bit set.
    """
    count = np.bincount(rows, minlength=n)
    size = np.where(count < DENSE, 2 * count, CHUNK // 8)
    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    if edges[-1] >= 1 << 31:
        raise ValueError("a chunk's bitmaps are too large")
    data, first = np.zeros(edges[-1], np.uint8), np.cumsum(count) - count
    few = (count < DENSE)[rows]
    at = edges[rows[few]] + 2 * (np.flatnonzero(few) - first[rows[few]])
    data[at], data[at + 1] = numbers[few] & 255, numbers[few] >> 8
    for r in np.flatnonzero(count >= DENSE):
        bits = np.zeros(CHUNK, np.uint8)
        bits[numbers[first[r] : first[r] + count[r]]] = 1
        data[edges[r] : edges[r + 1]] = np.packbits(bits, bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def unpack(bitmaps: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, number) for all numbers of all bitmaps, in order."""
    if not len(bitmaps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
    data = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)
    size = np.diff(edges)
    dense = size == CHUNK // 8
    at, _ = spread(edges[:-1][~dense] // 1, edges[:-1][~dense] + np.where(dense, 0, size)[~dense])
    pairs = data[at].reshape(-1, 2).astype(np.int64)
    rows = [np.repeat(np.flatnonzero(~dense), size[~dense] // 2)]
    numbers = [pairs[:, 0] | pairs[:, 1] << 8]
    for r in np.flatnonzero(dense):
        n = np.flatnonzero(np.unpackbits(data[edges[r] : edges[r + 1]], bitorder="little"))
        rows.append(np.full(len(n), r))
        numbers.append(n)
    row, number = np.concatenate(rows), np.concatenate(numbers)
    order = np.argsort(row, kind="stable")
    return row[order], number[order]


def planes_of(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Pairs, and the planes of each, of sorted keys (pair, number) and how often each occurs."""
    pairs, row = np.unique(keys >> 16, return_inverse=True)
    number = keys & (CHUNK - 1)
    most = np.zeros(len(pairs), np.int64)
    np.maximum.at(most, row, times)
    n_planes = np.frexp(most.astype(float))[1].astype(np.int64)
    first = np.cumsum(n_planes) - n_planes
    plane, at = [], []
    for k in range(int(n_planes.max(initial=0))):
        has = np.flatnonzero(times >> k & 1)
        plane.append(first[row[has]] + k)
        at.append(number[has])
    plane, at = np.concatenate([np.zeros(0, np.int64), *plane]), np.concatenate([np.zeros(0, np.int64), *at])
    order = np.lexsort((at, plane))
    offsets = np.concatenate([first, [n_planes.sum()]]).astype(np.int32)
    return pairs, pa.ListArray.from_arrays(pa.array(offsets), pack(plane[order], at[order], int(n_planes.sum())))


def times_of(planes: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, times) of all numbers in the planes' OR of each row: how many links each stands for."""
    edges = np.frombuffer(planes.buffers()[1], np.int32)[planes.offset : planes.offset + len(planes) + 1].astype(np.int64)
    plane, number = unpack(planes.values.slice(edges[0], edges[-1] - edges[0]))
    row = np.searchsorted(edges - edges[0], plane, "right") - 1
    power = plane - (edges - edges[0])[row]
    either, which = np.unique(row << 16 | number, return_inverse=True)
    return either >> 16, either & (CHUNK - 1), np.bincount(which, 1 << power, len(either)).astype(np.int64)


def _posted(docs: DataFrame, byte_path: str, piece_path: str, keep: list[str], digest: bool, remember: int, most: int) -> DataFrame:
    """Rows of documents ``(_chunk, _slot, c0..., n_a, n_b, n_groups, n_links, groups)`` and of postings ``(_chunk, _pair, _planes)``, in one table."""
    sizes = ["n_a", "n_b", "n_groups", "n_links"]
    some = docs.select(*numbered(keep), F.col("text").alias("x"))
    kept = [T.StructField(f.name, f.dataType) for f in some.drop("x").schema.fields]
    schema = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("_slot", T.IntegerType()), *kept, *(T.StructField(c, T.LongType()) for c in sizes), T.StructField("groups", T.StringType()), T.StructField("_pair", T.LongType()), T.StructField("_planes", T.ArrayType(T.BinaryType()))])
    planes_type, width = pa.list_(pa.binary()), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = Aligned(Tokenizers(byte_path, piece_path), remember)
        chunk, slot = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        kinds: list[pa.DataType] = []

        def postings() -> Iterator[pa.RecordBatch]:
            keys, times = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, which = np.unique(keys, return_inverse=True)
            pairs, planes = planes_of(keys, np.bincount(which, times).astype(np.int64))
            n = len(pairs)
            none = [pa.nulls(n, k) for k in (pa.int32(), *kinds, *[pa.int64()] * 4, pa.string())]
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), *none, pa.array(pairs), planes], schema.names)
            for k in range(0, n, 10_000):
                yield whole.slice(k, 10_000)

        for batch in batches:
            kinds = [batch[i].type for i in range(width)]
            for b in sliced(batch, width):
                for part in (b.slice(k, 2_000) for k in range(0, b.num_rows, 2_000)):
                    if slot + part.num_rows > CHUNK or sum(len(k) for k, _ in held) > most:
                        yield from postings()
                        chunk, slot, held = chunk + 1, 0, []
                    said = [units(t) for t in part[width].to_pylist()]
                    which = aligned.numbers(said)
                    edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in said])]).astype(np.int64)
                    of = np.repeat(np.arange(len(said)), np.diff(edges))
                    own = aligned.sizes[which]
                    broken = np.zeros(len(said), bool)
                    broken[of[own[:, 4] == 0]] = True  # a text that does not come back has no tokens
                    fine = ~broken[of]
                    totals = [pa.array(np.bincount(of[fine], own[fine, k], len(said)).astype(np.int64)) for k in range(4)]
                    told = ["" if no or i == j else "".join([aligned.groups[u] for u in which[i:j].tolist()])[:-1] for no, i, j in zip(broken, edges, edges[1:], strict=False)]
                    if digest:
                        told = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in told]
                    some, times = np.unique(which[fine] << 16 | (slot + of[fine]), return_counts=True)
                    at, owner = spread(aligned.ends[some >> 16], aligned.ends[(some >> 16) + 1])
                    keys, where = np.unique(aligned.pairs[at] << 16 | some[owner] & (CHUNK - 1), return_inverse=True)
                    held.append((keys, np.bincount(where, times[owner], len(keys)).astype(np.int64)))
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.arange(slot, slot + n, dtype=np.int32)), *part.columns[:width], *totals, pa.array(told, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, planes_type)], schema.names)
                    slot += n
        if held:
            yield from postings()

    return some.mapInArrow(run, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each posting's documents and links."""
    for b in batches:
        row, _, times = times_of(b["_planes"])
        counts = [np.bincount(row, w, b.num_rows).astype(np.int64) for w in (None, times)]
        yield pa.RecordBatch.from_arrays([b["_pair"], *(pa.array(c) for c in counts)], ["_pair", "n_docs", "n_links"])


def _scored(table: pa.Table) -> pa.Table:
    """One chunk's postings, with their pairs' counts, as the sums of its documents."""
    n_best, count_sum = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
    for b in table.to_batches():
        row, slot, times = times_of(b["_planes"])
        np.add.at(count_sum, slot, times * b["n_docs"].to_numpy()[row])
        np.add.at(n_best, slot, times * b["best"].to_numpy(zero_copy_only=False).astype(np.int64)[row])
    at = np.flatnonzero(count_sum)
    return pa.table([pa.array(np.full(len(at), table["_chunk"][0].as_py())), pa.array(at.astype(np.int32)), pa.array(n_best[at]), pa.array(count_sum[at])], names=["_chunk", "_slot", "n_best", "count_sum"])


def pair_counts(postings: DataFrame, width: int) -> DataFrame:
    """``(_pair, a, b, n_docs, n_links, best)`` over all chunks; ``best`` where no pair of the same A id is in more documents."""
    counted = postings.select("_pair", "_planes").mapInArrow(_counted, "_pair long, n_docs long, n_links long").groupBy("_pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counted = stored(counted.select("_pair", F.floor(F.col("_pair") / width).cast("int").alias("a"), (F.col("_pair") % width).cast("int").alias("b"), "n_docs", "n_links"))
    top = counted.groupBy("a").agg(F.max("n_docs").alias("top"))
    return counted.join(top, "a").select("_pair", "a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, keep: list[str] | None = None, digest: bool = False, remember: int = 300_000, most: int = 4_000_000, few: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Alignments and scores of all documents, and the pairs of ids with their counts.

    The first result has one row per row of ``docs``: the columns ``keep`` (by
    default all but the text), ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups`` (``a1,a2|b1;a3|b2``; with ``digest`` its sha256), ``n_best``
    (links whose pair is in as many documents as any of its A id) and
    ``count_sum`` (the pairs' document counts over all links). The second is
    ``(a, b, n_docs, n_links, best)``. Every row is a document of its own, also
    if ids repeat. A text that is null, empty or does not come back from its
    tokens has zeros and an empty ``groups``. Columns of these names are replaced.

    A task keeps the alignments of ``remember`` units at most. A chunk has up
    to 65,536 documents and about ``most`` postings. Up to ``few`` pairs with
    their counts are broadcast to the postings, more are joined.
    """
    made = ["n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    keep = [c for c in (keep or [c for c in docs.columns if c != "text"]) if c.lower() not in made]
    both = stored(_posted(docs, byte_path, piece_path, keep, digest, remember, most))
    postings = both.where("_pair is not null").select("_chunk", "_pair", "_planes")
    import sentencepiece

    pairs = stored(pair_counts(postings, sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()))
    scores = pairs.select("_pair", "n_docs", "best")
    if pairs.count() <= few:
        scores = F.broadcast(scores)
    sums = postings.join(scores, "_pair").select("_chunk", "_planes", "n_docs", "best").groupBy("_chunk").applyInArrow(_scored, "_chunk long, _slot int, n_best long, count_sum long")
    rows = both.where("_pair is null").drop("_pair", "_planes").join(sums, ["_chunk", "_slot"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    done = rows.select(*(f"c{i}" for i in range(len(keep))), "n_a", "n_b", "n_groups", "n_links", "groups", zero("n_best"), zero("count_sum"))
    return done.toDF(*keep, *made), pairs.drop("_pair")
