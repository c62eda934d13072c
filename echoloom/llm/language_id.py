"""Language identification by segmentation-marginalised unigrams (operator 5).

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, which a
forward pass finds; a text's is the product over its words.  Piece probabilities come
from expectation maximisation over all segmentations of sample words.

Words are runs of letters of the lower-cased text, each with the vocabulary's word mark
before it; words of more than ``PART`` characters are scored in parts of ``PART``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from echoloom.llm.textnum import mixed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 400  #: most training documents of a language
SAMPLE_WORDS = 100_000  #: most different words of a language's sample, the most frequent ones
MOST_LANGUAGES = 500  #: learned, the most frequent ones: their piece tables, 65 MB for so many, are broadcast
ROUNDS = 4  #: of expectation maximisation
SHARED, FLOOR = 0.05, 1e-8  #: weight of all languages' pieces in each language; least probability
MARGIN = 0.1  #: by how much a language has to be likelier than single letters, for each letter (natural logarithm)
PART = 32
MARK = "▁"
WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 16
_BASE = 0x2545F4914F6CDD1D
UP = np.array([pow(_BASE, i, 1 << 64) for i in range(PART + 2)], np.uint64)
DOWN = np.array([pow(_BASE, -i, 1 << 64) for i in range(PART + 2)], np.uint64)
BITS = 20


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def parts_of(word: str) -> list[str]:
    return [MARK + word[i : i + PART] for i in range(0, len(word), PART)]


class Pieces:
    """The vocabulary as two hash tables; piece number ``len(pieces)`` stands for any unknown character."""

    def __init__(self, pieces: list[str]) -> None:
        self.unknown = len(pieces)
        self.longest = max((len(p) for p in pieces), default=1)
        self.hash = np.zeros(len(pieces) + 1, np.uint64)
        for i, p in enumerate(pieces):
            self.hash[i] = self.keys(self.codes([p], len(p)), len(p))[0, 0]
        self.one = np.full(1 << BITS, self.unknown, np.int32)
        self.two = np.full(1 << BITS, self.unknown, np.int32)
        first = (self.hash[:-1] >> np.uint64(64 - BITS)).astype(np.int64)
        self.one[first] = np.arange(len(pieces))
        rest = np.flatnonzero(self.one[first] != np.arange(len(pieces)))
        self.two[(self.hash[rest] & np.uint64((1 << BITS) - 1)).astype(np.int64)] = rest

    @staticmethod
    def codes(words: list[str], width: int) -> np.ndarray:
        return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)

    @staticmethod
    def keys(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n characters, by word and start."""
        total = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(mixed(codes + np.uint64(1)) * UP[: codes.shape[1]], axis=1, out=total[:, 1:])
        return mixed((total[:, n:] - total[:, :-n]) * DOWN[: codes.shape[1] - n + 1] + np.uint64(n))

    def found(self, words: list[str], width: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each piece length the piece number by word and start, or -1."""
        codes = self.codes(words, width)
        total = np.zeros((len(codes), width + 1), np.uint64)
        np.cumsum(mixed(codes + np.uint64(1)) * UP[:width], axis=1, out=total[:, 1:])
        for n in range(1, min(self.longest, width) + 1):
            key = mixed((total[:, n:] - total[:, :-n]) * DOWN[: width - n + 1] + np.uint64(n))
            at = self.one[(key >> np.uint64(64 - BITS)).astype(np.int64)]
            other = self.two[(key & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            yield n, np.where(self.hash[at] == key, at, np.where(self.hash[other] == key, other, self.unknown if n == 1 else -1))


def _blocks(words: list[str], most: int) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """Words of one length at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
    for low, high in zip(cuts, [*cuts[1:], len(words)], strict=True):
        for a in range(low, high, most):
            where = order[a : min(a + most, high)]
            yield where, [words[i] for i in where.tolist()], int(size[order[low]])


def log_probabilities(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations; a row a word, a column a language.  Words of at most PART + 1 characters."""
    out = np.zeros((len(words), table.shape[1]))
    for where, own, width in _blocks(words, max(64, 2_000_000 // ((PART + 2) * table.shape[1]))):
        match = dict(pieces.found(own, width))
        forward = np.zeros((width + 1, len(own), table.shape[1]))
        forward[0] = 1
        for i in range(1, width + 1):
            for n in range(1, min(i, pieces.longest) + 1):
                at = match[n][:, i - n]
                rows = np.flatnonzero(at >= 0)
                if len(rows):
                    forward[i, rows] += forward[i - n, rows] * table[at[rows]]
        out[where] = np.log(np.maximum(forward[width], 1e-300))
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, over all segmentations under ``table`` (one language)."""
    out = np.zeros(len(table))
    for where, own, width in _blocks(words, 50_000):
        match = dict(pieces.found(own, width))
        forward, back = np.zeros((width + 1, len(own))), np.zeros((width + 1, len(own)))
        forward[0] = back[width] = 1
        for i in range(1, width + 1):
            for n in range(1, min(i, pieces.longest) + 1):
                at = match[n][:, i - n]
                forward[i] += np.where(at >= 0, forward[i - n] * table[at], 0)
        for i in range(width - 1, -1, -1):
            for n in range(1, min(width - i, pieces.longest) + 1):
                at = match[n][:, i]
                back[i] += np.where(at >= 0, back[i + n] * table[at], 0)
        scale = counts[where] / np.maximum(forward[width], 1e-300)
        for n, starts in match.items():
            for i in range(width - n + 1):
                at = starts[:, i]
                rows = np.flatnonzero(at >= 0)
                out += np.bincount(at[rows], (forward[i, rows] * table[at[rows]] * back[i + n, rows]) * scale[rows], len(out))
    return out


def public_pieces(vocabulary: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    every = range(model.get_piece_size())
    return list(dict.fromkeys(model.id_to_piece(i) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = Counter(words_of(text))
            if held:
                yield pa.record_batch([pa.array([lang] * len(held)), pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])


class LanguageModel:
    """Languages, sorted, and the piece table: a row a piece and the unknown character, a column a language.

    ``letters`` is what any text of letters may be: the shares of single letters, and of the word mark, in the sample
    of all languages.
    """

    def __init__(self, languages: list[str], pieces: list[str], table: np.ndarray, letters: dict[str, float] | None = None) -> None:
        self.languages, self.pieces, self.table, self.letters = languages, pieces, table, letters or {}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id is not held out (nor trained on)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _fitter(known, rounds: int) -> Callable:  # noqa: ANN001  a broadcast of the pieces
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        """Expected counts of all pieces under one language's words."""
        pieces = known.value
        index, held = Pieces(pieces), Counter()
        for word, n in zip(frame["word"], frame["n"], strict=True):
            for p in parts_of(word):
                held[p] += int(n)
        words = sorted(held)
        n, p = np.array([held[w] for w in words], float), np.full(len(pieces) + 1, 1.0 / len(pieces))
        for _ in range(rounds):
            found = expected_counts(words, n, index, p)
            p = np.maximum(found / found.sum(), FLOOR)
        letters = Counter()
        for word, times in held.items():
            for c in word:
                letters[c] += times
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "expected": [found.tolist()], "letters": [list(letters)], "times": [[float(x) for x in letters.values()]]})

    return fit


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on at most ``sample_docs`` whole documents of each value of ``lang``.

    The sample is taken by a hash of doc_id among documents that are not held out and have
    a text, a language and an id.  Of a column with more than MOST_LANGUAGES values the most frequent
    are learned (ties by name), and of a language's words the SAMPLE_WORDS most frequent.
    Each language is fitted in a task of its own; the driver gets one number for each piece.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    # Twice the sample by hash, in the scan, so that only such texts move; then exactly the sample.
    most = {r["lang"]: int(min(1.0, 2.0 * sample_docs / r["n"]) * (1 << 30)) for r in known}
    mark, share = F.xxhash64(F.lit(5), "doc_id"), F.lit(0)
    if most:
        share = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("lang"))
    drawn = usable.select("lang", "text", "doc_id").where(F.pmod(mark, F.lit(1 << 30)) < share)
    drawn = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(mark, "doc_id"))).where(F.col("place") <= sample_docs)
    counts = drawn.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= SAMPLE_WORDS)
    pieces = public_pieces(vocabulary)
    fit = _fitter(docs.sparkSession.sparkContext.broadcast(pieces), rounds)
    fitted = counts.select("lang", "word", "n").groupBy("lang").applyInPandas(fit, "lang string, expected array<double>, letters array<string>, times array<double>").toPandas().sort_values("lang")
    languages = list(fitted["lang"])
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces) + 1, 0)))
    shares = [np.array(e) / np.sum(e) for e in fitted["expected"]]
    all_of = sum(shares) / len(shares)
    table = np.stack([np.maximum((1 - SHARED) * e + SHARED * all_of, FLOOR) for e in shares], axis=1)
    letters: dict[str, float] = {}
    for own, times in zip(fitted["letters"], fitted["times"], strict=True):
        for c, n in zip(own, times, strict=True):
            letters[c] = letters.get(c, 0.0) + n / (np.sum(times) * len(languages))
    return LanguageModel(languages, pieces, table, letters)


def _predictor(model, names: tuple[str, ...]) -> Callable:  # noqa: ANN001  a broadcast of (languages, pieces, table)
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, table, letters = model.value
        index, cache, apart = Pieces(pieces), {}, {c: math.log(p) + MARGIN for c, p in letters.items()}
        strange = math.log(FLOOR) + MARGIN
        scores = np.zeros((0, len(languages) + 1))  # the last column: letter by letter
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                words, owner_size = [], []
                for text in part.column(part.num_columns - 1).to_pylist():
                    own = words_of(text) if text else []
                    if not any(c.isalpha() for w in own for c in w):  # such as a lone superscript
                        own = []
                    words += own
                    owner_size.append(len(own))
                if len(cache) > 400_000:
                    cache, scores = {}, scores[:0]
                new = [w for w in dict.fromkeys(words) if w not in cache] if languages else []
                if new:
                    pieces_of = [parts_of(w) for w in new]
                    flat = log_probabilities([p for x in pieces_of for p in x], index, table)
                    starts = np.cumsum([0, *map(len, pieces_of[:-1])])
                    cache.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
                    singly = [[sum(apart.get(c, strange) for p in x for c in p)] for x in pieces_of] if len(names) > 2 else np.zeros((len(new), 1))
                    scores = np.concatenate([scores, np.hstack([np.add.reduceat(flat, starts, axis=0), singly])])
                sums = np.zeros((part.num_rows, len(languages) + 1))
                if words and languages:
                    at = np.fromiter((cache[w] for w in words), np.int64, len(words))
                    some = np.flatnonzero(owner_size)
                    cuts = np.concatenate([[0], np.cumsum(owner_size)])[some]
                    sums[some] = np.add.reduceat(scores[at], cuts, axis=0)
                named, sure, odds = [], [], []
                for row, single, n in zip(sums[:, :-1], sums[:, -1].tolist(), owner_size, strict=True):
                    if not n or not languages:
                        named.append("und")
                        sure.append(0.0)
                        odds.append(0.0)
                        continue
                    best = int(row.argmax())
                    named.append(languages[best])
                    sure.append(float(1 / np.exp(row - row[best]).sum()))
                    odds.append(float(row[best] - single))
                kept = [part.column(i) for i in range(part.num_columns - 1)]
                told = [pa.array(named, pa.string()), pa.array(sure, pa.float64()), pa.array(odds, pa.float64())][: len(names)]
                yield pa.record_batch([*kept, *told], [*part.schema.names[:-1], *names])

    return predict


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """The language of every whole text: columns ``keep``, then ``lang_pred`` and ``score`` (or ``names``).

    Only ``text`` decides.  ``score`` is the posterior probability of the language among those
    learned, which are equally likely beforehand.  A null text, or one without any letter,
    is ``und`` with score 0, and so is every text if nothing was learned.  Equal
    scores go to the first language by name.  Repeated rows are each given.

    A third of ``names`` asks for the evidence that the text is of that language rather than any text of letters: by how much
    its log-likelihood exceeds that of letters drawn one by one (``LanguageModel.letters``), MARGIN more for each letter; 0 for ``und``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.pieces, model.table, model.letters))
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predictor(shared, names), f"{kinds}, `{names[0]}` string, " + ", ".join(f"`{n}` double" for n in names[1:]))
