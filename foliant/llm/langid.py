"""Language identification by segmentation-marginalised unigram models.

Each language has one probability per piece of a fixed public vocabulary. A
word's likelihood is the sum, over every way to cut it into pieces, of the
product of the pieces' probabilities; the forward algorithm computes that sum.
The probabilities are learnt by expectation maximisation, whose expected counts
come from the forward and backward sums of a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, spare

LETTERS = regex.compile(r"\p{L}+")
WORD_START = "▁"
#: Longer runs of letters are scored as consecutive parts of this many characters by default; training takes shorter parts.
PART, TRAINING_PART = 1024, 32
#: The vocabulary has no longer piece of letters.
LONGEST_PIECE = 16
#: Sums are scaled up by this when they get so small.
_SCALE = 1e100
UNKNOWN = 1e-7
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str | None = None) -> list[str]:
    """The letter pieces of a sentencepiece model, by default the public 32k one."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p.lower() for p in pieces if len(p) <= LONGEST_PIECE and LETTERS.fullmatch(p.lstrip(WORD_START) or "x")})


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as one row per word, and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(lengths.max(initial=0))), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return out


@dataclass
class PieceTable:
    """Vocabulary pieces by hash; piece ids are positions in ``hashes``, then one for unknown characters."""

    hashes: np.ndarray
    seen: np.ndarray
    powers: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> PieceTable:
        codes, lengths = _codes(pieces)
        hashes = np.unique(_prefix_hashes(codes)[np.arange(len(pieces)), lengths])
        seen = np.zeros(1 << 20, bool)
        seen[hashes >> np.uint64(44)] = True
        powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(LONGEST_PIECE, _BASE)]))
        return cls(hashes, seen, powers)

    @property
    def size(self) -> int:
        return len(self.hashes) + 1

    def lattice(self, words: list[str]) -> tuple[list, np.ndarray]:
        """For every end position, the arcs (word, start, piece) that reach it; and the words' lengths."""
        codes, lengths = _codes(words)
        prefix = _prefix_hashes(codes)
        arcs = []
        for end in range(1, codes.shape[1] + 1):
            alive = np.flatnonzero(lengths >= end)
            rows, starts, pieces = [], [], []
            for m in range(1, min(LONGEST_PIECE, end) + 1):
                h = prefix[alive, end] - prefix[alive, end - m] * self.powers[m]
                maybe = np.flatnonzero(self.seen[h >> np.uint64(44)])
                at = np.searchsorted(self.hashes, h[maybe])
                at[at == len(self.hashes)] = 0
                hit = self.hashes[at] == h[maybe]
                rows.append(alive[maybe[hit]])
                pieces.append(at[hit])
                if m == 1:  # a character outside the vocabulary is a piece of its own
                    lone = np.ones(len(alive), bool)
                    lone[maybe[hit]] = False
                    rows.append(alive[lone])
                    pieces.append(np.full(int(lone.sum()), len(self.hashes)))
                starts += [np.full(len(r), end - m) for r in rows[len(starts) :]]
            arcs.append(tuple(np.concatenate(x).astype(np.int64) for x in (rows, starts, pieces)))
        return arcs, lengths

    def forward(self, arcs: list, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of every prefix of every word."""
        n = len(lengths)
        alpha = np.zeros((len(arcs) + 1, n))
        alpha[0] = 1.0
        for end, (rows, starts, pieces) in enumerate(arcs, 1):
            alpha[end] = np.bincount(rows, alpha[starts, rows] * p[pieces], n)
        return alpha

    def log_forward(self, arcs: list, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Logs of the whole words' sums, which may be too small for a number."""
        n = len(lengths)
        alpha = np.zeros((len(arcs) + 1, n))
        alpha[0] = 1.0
        shift, out = np.zeros(n), np.zeros(n)
        for end, (rows, starts, pieces) in enumerate(arcs, 1):
            alpha[end] = np.bincount(rows, alpha[starts, rows] * p[pieces], n)
            small = np.flatnonzero((alpha[end] < 1 / _SCALE) & (lengths >= end))
            if len(small):  # with the sums that the next ones are made of
                alpha[max(0, end - LONGEST_PIECE) : end + 1, small] *= _SCALE
                shift[small] -= np.log(_SCALE)
            done = lengths == end
            out[done] = np.log(np.maximum(alpha[end, done], 1e-300)) + shift[done]
        return out

    def expected(self, arcs: list, lengths: np.ndarray, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations."""
        n = len(lengths)
        alpha = self.forward(arcs, lengths, p)
        total = alpha[lengths, np.arange(n)]
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(n)] = counts / total
        uses = np.zeros(self.size)
        for end in range(len(arcs), 0, -1):
            rows, starts, pieces = arcs[end - 1]
            flow = p[pieces] * beta[end, rows]
            np.add.at(beta, (starts, rows), flow)
            uses += np.bincount(pieces, flow * alpha[starts, rows], self.size)
        return uses


@dataclass
class LanguageModel:
    table: PieceTable
    languages: list[str]
    p: np.ndarray  # language x piece

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Natural logs of the words' likelihoods: word x language."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)))
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):  # words of like lengths together, so that a long one does not pad them all
            some = order[at : at + max(1, 1_000_000 // (len(words[order[min(len(order), at + 50_000) - 1]]) + 1))][:50_000]
            arcs, lengths = self.table.lattice([WORD_START + words[i] for i in some])
            out[some] = np.stack([self.table.log_forward(arcs, lengths, p) for p in self.p], 1)
            at += len(some)
        return out


def _parts(text: str, part: int | None) -> list[str]:
    words = LETTERS.findall(text.lower())
    if part and len(text) > part and max(map(len, words), default=0) > part:
        words = [w[i : i + part] for w in words for i in range(0, len(w), part)]
    return words


def train(docs: DataFrame, label: str = "lang", key: str = "doc_id", per_language: int = 300, rounds: int = 4, vocabulary_path: str | None = None) -> LanguageModel:
    """Learn the piece probabilities from about ``per_language`` texts of each label.

    Rows without text or label teach nothing. The sample is the bound on what
    reaches the driver: word counts of ``per_language`` texts per language.
    """
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"), "text")
    chosen = hashed_sample(known, "_key", "_label", per_language)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b["_label"].to_pylist(), b["text"].to_pylist(), strict=True):
                w = _parts(text, TRAINING_PART)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), pa.array(w, pa.string())], ["lang", "word"])

    counted = chosen.mapInArrow(words, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n")).toPandas()
    pieces = PieceTable.of(vocabulary(vocabulary_path))
    languages = sorted(counted["lang"].unique())
    probabilities = []
    for lang in languages:
        own = counted[counted["lang"] == lang].sort_values("word")
        arcs, lengths = pieces.lattice([WORD_START + w for w in own["word"]])
        p, counts = np.full(pieces.size, 1 / pieces.size), own["n"].to_numpy(float)
        for _ in range(rounds):
            uses = pieces.expected(arcs, lengths, p, counts)
            p = (uses + 0.01) / (uses.sum() + 0.01 * pieces.size)
        p[-1] = UNKNOWN  # the same in every language: such a character speaks for none
        probabilities.append(p)
    return LanguageModel(pieces, languages, np.array(probabilities).reshape(len(languages), pieces.size))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None, remember: int = 200_000, part: int | None = PART) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior of the best language under a flat prior.

    ``keep`` names the columns that stay (all by default). A letter is a
    character of Unicode's category L: numerals and digits are none. A null
    text, one without a letter, or a model that has seen no language gives ``und`` and 0.
    Repeated rows get the same answer; of equal languages the first by name
    wins. Every text is read whole; a run of letters longer than ``part``
    is scored as consecutive parts, with None always as a whole. Columns named ``lang_pred`` or ``score`` are replaced.
    """
    out = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    schema = docs.select(*out).schema.add("lang_pred", "string").add("score", "double")
    at = len(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model
        number: dict[str, int] = {}
        known = np.zeros((0, len(m.languages)))
        for b in batches:
            if len(number) > remember:
                number, known = {}, known[:0]
            ids, sizes = [], []
            for text in b[b.num_columns - 1].to_pylist():
                words = _parts(text, part) if text else []
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
                sizes.append(len(words))
            new = list(number)[len(known) :]
            known = np.concatenate([known, m.word_scores(new)])
            total = np.stack([known[i].sum(0) for i in ids]) if ids else np.zeros((0, len(m.languages)))
            if m.languages and len(ids):
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            else:
                best, share = np.zeros(len(ids), int), np.zeros(len(ids))
            named = [bool(s) and bool(m.languages) for s in sizes]
            pred = [m.languages[i] if ok else "und" for i, ok in zip(best, named, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(pred, pa.string()), pa.array(np.where(named, share, 0.0))], [*out, "lang_pred", "score"])

    return docs.select(*out, F.col("text").alias(spare("_text", out))).mapInArrow(score, schema)
