"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of a word's tree holds the rank of the pair that begins at symbol i,
with i itself behind it; every inner node holds the smaller of its two. So the
root is the leftmost of the lowest-ranked pairs. A merge changes three leaves,
and the ways from these to the root, until no pair of the word has a rank.

Words of a batch that are short are merged in step, one merge of each at a time;
a long one has a tree of its own. Between ASCII white space texts split into
units that no merge crosses; a task keeps the encodings of the units it has met.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbers, numbered, sliced, spread

_NONE = np.iinfo(np.int64).max
_PLACE = (1 << 32) - 1
#: Words of more symbols have a tree of their own.
SHORT = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: the byte's own where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the encoder needs of a tokenizer's file; symbols are token ids."""

    tokens: list[str]
    first: np.ndarray  # a byte's symbol inside a word
    last: np.ndarray  # and at its end
    pairs: np.ndarray  # sorted: left * len(tokens) + right
    rank: np.ndarray
    merged: np.ndarray  # the new symbol of each rank
    special: dict[str, int]
    words: str  # the pattern of the words of a normalised text

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a tokenizers file with word ends: NFC, white space to blanks, lower case, words by a pattern, then bytes."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, steps, cuts = told["model"], told["normalizer"]["normalizers"], told["pre_tokenizer"]["pretokenizers"]
        plain = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        plain = plain and [(c["type"], c.get("behavior"), c.get("invert"), c.get("use_regex"), c.get("add_prefix_space")) for c in cuts] == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
        plain = plain and model["type"] == "BPE" and told["decoder"] is None and told["post_processor"] is None
        plain = plain and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if not plain or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError(f"{path} is not of the kind that this operator encodes")
        ids, end = dict(model["vocab"]), model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        tokens = [""] * (1 + max([*ids.values(), *special.values()]))
        for token, i in (ids | special).items():
            tokens[i] = token
        letters = byte_letters()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([ids[a] * len(tokens) + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        return cls(
            tokens,
            np.array([ids[c] for c in letters], np.int64),
            np.array([ids[c + end] for c in letters], np.int64),
            pairs[order],
            order,
            np.array([ids[a + b] for a, b in merges], np.int64),
            special,
            cuts[0]["pattern"]["Regex"],
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; a pair that does not merge, or has a symbol below 0, has none."""
        pair = left * len(self.tokens) + right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.rank[at], _NONE >> 32)


class Encoder:
    """Encodes words, and texts by their units."""

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self.vocabulary = vocabulary
        self.word = regex.compile(vocabulary.words)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.opening = {t[0] for t in vocabulary.special}
        self.lone = self.word.findall("x" * 9) == ["x" * 9] and not any(t.isalpha() for t in vocabulary.special)  # letters make one word
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.cut = pre_tokenizers.Split(Regex(vocabulary.words), "removed", invert=True)
        self.by_pair: dict[int, tuple[int, int]] | None = None

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        rank = self.vocabulary.ranks(left, right)
        return np.where(rank == _NONE >> 32, _NONE, (rank << 32) | place)

    def in_step(self, symbols: np.ndarray) -> np.ndarray:
        """Merge rows of symbols (-1 behind a word's end) whose number of columns is a power of two; what merges into its left neighbour becomes -1."""
        rows, width = symbols.shape
        ids = np.concatenate([symbols, np.full((rows, 1), -1)], 1)
        after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (rows, width + 1)).copy()
        before = np.broadcast_to(np.maximum(np.arange(-1, width), 0), (rows, width + 1)).copy()
        tree = np.full((rows, 2 * width), _NONE)
        tree[:, width:] = self._leaf(ids[:, :-1], ids[:, 1:], np.arange(width))
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        turn = np.flatnonzero(tree[:, 1] < _NONE)
        while len(turn):
            root = tree[turn, 1]
            i = root & _PLACE
            j = after[turn, i]
            k = after[turn, j]
            p = before[turn, i]
            ids[turn, i], ids[turn, j] = self.vocabulary.merged[root >> 32], -1
            after[turn, i], before[turn, k] = k, i
            tree[turn, width + j] = _NONE
            tree[turn, width + i] = self._leaf(ids[turn, i], ids[turn, k], i)
            apart = p != i
            tree[turn[apart], width + p[apart]] = self._leaf(ids[turn, p], ids[turn, i], p)[apart]
            nodes = [width + x for x in (i, j, p)]
            while len(nodes) and nodes[0][0] > 1:
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[turn, x] = np.minimum(tree[turn, 2 * x], tree[turn, 2 * x + 1])
            turn = turn[tree[turn, 1] < _NONE]
        return ids[:, :-1]

    def alone(self, symbols: list[int]) -> list[int]:
        """Merge one word of any length."""
        v = self.vocabulary
        if self.by_pair is None:
            self.by_pair = {p: (r, m) for p, r, m in zip(v.pairs.tolist(), v.rank.tolist(), v.merged[v.rank].tolist(), strict=True)}
        by_pair, n, size = self.by_pair, len(symbols), len(v.tokens)
        width = 1 << max(0, n - 1).bit_length()
        ids, after, before = symbols[:], list(range(1, n + 1)), list(range(-1, n - 1))
        none = (1 << 62, 0)

        def leaf(i: int) -> int:
            k = after[i] if i >= 0 else n
            return by_pair.get(ids[i] * size + ids[k], none)[0] << 32 | i if k < n else _NONE

        tree = [_NONE] * (2 * width)
        tree[width : width + n] = [x if x < _NONE else _NONE for x in map(leaf, range(n))]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (root := tree[1]) < _NONE:
            i = root & _PLACE
            j = after[i]
            ids[i], ids[j] = by_pair[ids[i] * size + ids[j]][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (j, i, before[i]):
                if x < 0:
                    continue
                node = width + x
                tree[node] = _NONE if x == j else min(leaf(x), _NONE)
                while node > 1:
                    node >>= 1
                    low = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == low:
                        break
                    tree[node] = low
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and where each word's begin and the last's end; a special token's id stands for itself."""
        v, raw = self.vocabulary, [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else b"" for w in words]
        done: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        by_width: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > SHORT:
                symbols = v.first[np.frombuffer(b, np.uint8)]
                symbols[-1] = v.last[b[-1]]
                ids = self.alone(symbols.tolist())
                done.append(([i], np.array([len(ids)]), np.array(ids, np.int64)))
            elif b:
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append(i)
            else:
                done.append(([i], np.ones(1, np.int64), np.array([words[i]], np.int64)))
        for width, some in by_width.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                n = np.fromiter((len(raw[i]) for i in part), np.int64, len(part))
                flat = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8)
                symbols = np.full((len(part), width), -1, np.int64)
                symbols[np.arange(width) < n[:, None]] = v.first[flat]
                symbols[np.arange(len(part)), n - 1] = v.last[flat[np.cumsum(n) - 1]]
                merged = self.in_step(symbols)
                alive = merged >= 0
                done.append((part, alive.sum(1), merged[alive]))
        length = np.zeros(len(words), np.int64)
        for part, n, _ in done:
            length[part] = n
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
        out = np.zeros(ends[-1], np.int64)
        for part, n, ids in done:
            first = ends[part]
            out[spread(first, first + n)[0]] = ids
        return out, ends

    def words_of(self, text: str) -> list[str | int]:
        """The words of a text in order; special tokens as their ids. White space inside is left to the pattern.

        Beyond the Latin and Greek blocks, characters go by the Unicode version of the tokenizer's own library.
        """
        if text.isascii() and text.isalpha() and self.lone:
            return [text.lower()]
        out: list[str | int] = []
        for n, part in enumerate(self.special.split(text) if self.special and not self.opening.isdisjoint(text) else [text]):
            if n % 2:
                out.append(self.vocabulary.special[part])
            elif part.isascii():
                out += self.word.findall(part.lower())
            elif max(part) < "\u0400":
                part = unicodedata.normalize("NFC", part)
                part = "".join([c.lower() for c in part]) if "Σ" in part else part.lower()  # a capital sigma is lower-cased alike at every place
                out += self.word.findall(part)
            else:
                out += [w for w, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(part))]
        return out

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of texts without ASCII white space in a row, and how many each has."""
        parts, number = [self.words_of(u) for u in units], Numbers()
        which = number.of(parts)
        flat, ends = self.encode_words(list(number))
        low, high = ends[which], ends[which + 1]
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, parts), np.int64, len(parts)))
        return flat[spread(low, high)[0]], np.bincount(owner, high - low, len(units)).astype(np.int64)


class Remembered:
    """Encodings of the units met so far, in one row of ids; bounded by their number and their tokens."""

    def __init__(self, encoder: Encoder, units: int, tokens: int = 8_000_000):
        self.encoder, self.units, self.tokens = encoder, units, tokens
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin and the last's end."""
        if len(self.number) > self.units or len(self.flat) > self.tokens:
            self.clear()
        known = len(self.number)
        said = [t.split() if t else [] for t in texts]  # of bytes: at ASCII white space
        which = self.number.of(said)
        if len(self.number) > known:
            ids, n = self.encoder.encode_units([u.decode("utf-8", "surrogatepass") for u in islice(self.number, known, None)])
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
        low, high = self.ends[which], self.ends[which + 1]
        edges = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in said])]).astype(np.int64)
        tokens = np.concatenate([np.zeros(1, np.int64), np.cumsum(high - low)])
        return self.flat[spread(low, high)[0]], tokens[edges]


def _texts(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """The texts of lists of token ids: tokens with blanks between them; null for a null list."""
    parts = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), tokens.take(ids.flatten()))
    return pc.binary_join(parts, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", decoded: str | None = None, remember: int = 300_000) -> DataFrame:
    """The rows of ``docs`` with the token ids of ``text`` in column ``out`` (replaced if there).

    Special tokens inside a text are recognised as such; none is added, nothing
    is cut off or padded. A null or empty text has no ids. Other columns stay
    as they are; texts are read whole, however long. With ``decoded`` the ids
    are decoded at once into a column of that name, as ``decode`` does it. A
    task remembers the encodings of about ``remember`` units.
    """
    made = [out, *([decoded] if decoded else [])]
    kept = [c for c in docs.columns if c not in made]
    some = docs.select(*numbered(kept), F.col(text).alias("x"))
    schema = T.StructType([*some.drop("x").schema.fields, T.StructField("y", T.ArrayType(T.IntegerType(), False)), *([T.StructField("z", T.StringType())] if decoded else [])])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, tokens = Remembered(Encoder(vocabulary), remember), pa.array(vocabulary.tokens, pa.large_string())
        for batch in batches:
            for b in sliced(batch, width):
                ids, edges = encoded(b[width].cast(pa.binary()).to_pylist())
                column = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:width], column, *([_texts(column, tokens)] if decoded else [])], schema.names)

    return some.mapInArrow(run, schema).toDF(*kept, *made)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the texts of their token ids, special tokens too, in column ``out`` (replaced if there).

    The file has no decoder, so tokens, their word ends included, stand with
    blanks between them. Null or no ids give the empty text.
    """
    kept = [c for c in rows.columns if c != out]
    some = rows.select(*numbered(kept), F.col(ids).alias("x"))
    schema = T.StructType([*some.drop("x").schema.fields, T.StructField("y", T.StringType())])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(vocabulary.tokens, pa.large_string())
        for batch in batches:
            for b in sliced(batch, width):
                yield pa.RecordBatch.from_arrays([*b.columns[:width], _texts(pc.fill_null(b[width], pa.scalar([], b[width].type)), tokens)], schema.names)

    return some.mapInArrow(run, schema).toDF(*kept, out)
