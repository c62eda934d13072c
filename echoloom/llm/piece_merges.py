"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds (operator 11).

Encoding gives the ids that the sentencepiece library gives for a BPE model, from the model's pieces and
scores alone; the library is only asked for the vocabulary.

* A text gets its leading space, spaces become U+2581, and it falls into words: a run of U+2581 and what follows.
  No piece crosses such a border (if some piece of a model does, the whole text is one word).  Each new word of a
  worker is merged once and kept.
* The words' characters are one flat array of symbols, cut once more between neighbours that
  stand together in no piece: no merge can cross such a cut.
* Each round looks up the rank of every pair of neighbours, takes the smallest of each segment (pieces of one score
  share a rank), merges there from the left, and compacts the array; segments without a pair leave it.
* The library merges one pair at a time, the leftmost of the best.  All occurrences of a piece are merged in one
  round only if no piece of the same or a better rank begins or ends with it, so that no merge can bring
  forth a pair that should go first.  Pieces of equal score are merged together, in one pass
  from the left, if no better piece begins or ends with one of them.  Otherwise one pair a round is merged.

Memory holds one Arrow batch and a table of words of at most ``MOST_SYMBOLS`` ids.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from echoloom.llm.arrow import bounded_batches

SPACE = "▁"
UNK_SURFACE = " ⁇ "  #: what the library decodes an unknown id to, unless the model says otherwise
MOST_SYMBOLS = 3_000_000
NONE = np.int64(1 << 40)  #: the rank of a pair that is no piece
PART = 64  #: rows merged at a time

codecs.register_error("bytewise", lambda fault: ("�", fault.start + 1))


class Vocabulary:
    """The tables that merging and decoding need, from the bytes of a model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        found = proto.ModelProto.FromString(model)
        rules, kind = found.normalizer_spec, proto.ModelProto.SentencePiece
        known = {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}
        if (
            found.trainer_spec.model_type != proto.TrainerSpec.BPE
            or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces
            or found.trainer_spec.treat_whitespace_as_suffix
            or any(p.type not in known for p in found.pieces)
        ):
            raise ValueError("only BPE models without text rules, suffix spaces and user-defined or unused pieces")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        names, kinds = [p.piece for p in found.pieces], [p.type for p in found.pieces]
        self.size = len(names)
        self.unknown = kinds.index(kind.UNKNOWN)
        self.begin, self.end = (names.index(x) for x in ("<s>", "</s>"))
        normal = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == kind.NORMAL}
        self.splits_at_spaces = not any(SPACE in n.lstrip(SPACE) for n in normal)
        self._decoding(names, kinds, kind, found.trainer_spec.unk_surface or UNK_SURFACE)
        self._merging(normal, {n: found.pieces[i].score for n, i in normal.items()})
        self.byte_ids = np.full(256, self.unknown, np.int64)
        for i, (n, k) in enumerate(zip(names, kinds, strict=True)):
            if k == kind.BYTE:
                self.byte_ids[int(n[1:-1], 16)] = i
        self.by_bytes = found.trainer_spec.byte_fallback

    def _decoding(self, names: list[str], kinds: list[int], kind, unk: str) -> None:  # noqa: ANN001
        said = [b"" if k == kind.CONTROL else unk.encode() if k == kind.UNKNOWN else bytes([int(n[1:-1], 16)]) if k == kind.BYTE else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.lengths = np.fromiter(map(len, said), np.int64, self.size)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(said), np.uint8)
        self.control = np.array([k == kind.CONTROL for k in kinds])
        self.spaced = np.array([k == kind.NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds, strict=True)])

    def _merging(self, normal: dict[str, int], scores: dict[str, float]) -> None:
        """Symbols are ids of pieces, and beyond them characters that occur in pieces without being one."""
        chars = sorted({c for n in normal for c in n})
        symbol = dict(normal)
        for c in chars:
            symbol.setdefault(c, self.size + len(symbol) - len(normal))
        self.points = np.array([ord(c) for c in chars], np.uint32)
        self.char_symbols = np.array([symbol[c] for c in chars], np.int64)
        place = {c: i for i, c in enumerate(chars)}
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)  # the last row and column: a character of no piece
        order = {s: i for i, s in enumerate(sorted({scores[n] for n in normal if len(n) > 1}, reverse=True))}
        pairs, rank, alike = {}, {n: order[scores[n]] for n in normal if len(n) > 1}, {}
        best_with: dict[str, int] = {}  # the best rank of longer pieces that begin or end with a symbol
        for n, r in rank.items():
            alike[r] = alike.get(r, 0) + 1
            for i in range(1, len(n)):
                self.together[place[n[i - 1]], place[n[i]]] = True
                if n[:i] in symbol and n[i:] in symbol:
                    pairs[symbol[n[:i]] << 32 | symbol[n[i:]]] = (r, normal[n])
                    for x in (n[:i], n[i:]):
                        best_with[x] = min(best_with.get(x, len(order)), r)
        self._file(pairs)
        safe = {r: True for r in alike}
        for n, r in rank.items():
            best = best_with.get(n, len(order))
            safe[r] &= best >= r if alike[r] > 1 else best > r
        #: By rank: 0 one pair a round, 1 all occurrences, 2 all pieces of the rank in one pass.
        self.mode = np.array([(2 if alike[r] > 1 else 1) * safe[r] for r in range(len(order))], np.int64)

    def _file(self, pairs: dict[int, tuple[int, int]]) -> None:
        """An open-addressed table of pairs, at most an eighth full."""
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks, self.merged = (np.array([pairs[k][i] for k in self.keys.tolist()], np.int64) for i in (0, 1))
        self.shift = np.uint64(61 - max(len(pairs), 1).bit_length())
        self.slot_key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.slot_rank, self.slot_piece = np.full(len(self.slot_key), NONE), np.zeros(len(self.slot_key), np.int64)
        waiting, slot = np.arange(len(self.keys)), self._slot(self.keys)
        while len(waiting):
            free = np.flatnonzero(self.slot_key[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.slot_key[slot[put]] = self.keys[waiting[put]]
            self.slot_rank[slot[put]], self.slot_piece[slot[put]] = self.ranks[waiting[put]], self.merged[waiting[put]]
            left = np.ones(len(waiting), bool)
            left[put] = False
            waiting, slot = waiting[left], (slot[left] + 1) % len(self.slot_key)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbours; NONE where they are no piece."""
        key = left << 32 | right
        slot = self._slot(key)
        found = self.slot_key[slot]
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) % len(self.slot_key)
            found = self.slot_key[slot[on]]
            on = on[(found != key[on]) & (found >= 0)]
        hit = self.slot_key[slot] == key
        return np.where(hit, self.slot_rank[slot], NONE), self.slot_piece[slot]

    def in_one_pass(self, symbols: list[int], rank: int) -> list[int]:
        """Merge all pieces of one rank, the leftmost pair first."""
        pairs = self._ties(rank)
        out: list[int] = []
        for x in symbols:
            out.append(x)
            while len(out) > 1 and (m := pairs.get((out[-2], out[-1]))) is not None:
                out[-2:] = [m]
        return out

    @lru_cache(16)  # noqa: B019
    def _ties(self, rank: int) -> dict[tuple[int, int], int]:
        own = self.ranks == rank
        return {(k >> 32, k & 0xFFFFFFFF): m for k, m in zip(self.keys[own].tolist(), self.merged[own].tolist(), strict=True)}


def merge_rounds(vocabulary: Vocabulary, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their segments (ascending numbers) after all merges."""
    done: list[tuple[np.ndarray, ...]] = []
    place = np.arange(len(symbols))  # where a symbol began, to put the finished back in order
    rank, piece = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)  # of a symbol and the next of its segment
    stale = np.arange(len(symbols))
    while len(symbols):
        stale = stale[stale + 1 < len(symbols)]
        inner = segment[stale] == segment[stale + 1]
        rank[stale] = NONE
        stale = stale[inner]
        rank[stale], piece[stale] = vocabulary.pair(symbols[stale], symbols[stale + 1])
        rank[-1] = NONE
        heads = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        best = np.minimum.reduceat(rank, heads)
        size = np.diff(np.append(heads, len(symbols)))
        mode = np.where(best < NONE, vocabulary.mode[np.minimum(best, len(vocabulary.mode) - 1)], -1) if len(vocabulary.mode) else np.full(len(best), -1)
        going = np.repeat(mode >= 0, size)
        first = np.flatnonzero((rank == np.repeat(best, size)) & going)
        # Of a run of overlapping pairs every second is merged; of a segment that takes one pair a round, the first.
        opens = np.concatenate([[True], segment[first[1:]] != segment[first[:-1]]])
        fresh = opens.copy()
        fresh[1:] |= np.diff(first) > 1
        within = np.arange(len(first)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(first) else first
        how = np.repeat(mode, size)[first]
        take = first[((how == 1) & (within % 2 == 0)) | ((how == 0) & opens[: len(first)])]
        symbols[take] = piece[take]
        keep, changed = going.copy(), np.zeros(len(symbols), bool)
        keep[take + 1] = False
        changed[take] = True
        ends = np.cumsum(size)
        for i in np.flatnonzero(mode == 2).tolist():
            low, high = int(ends[i] - size[i]), int(ends[i])
            out = vocabulary.in_one_pass(symbols[low:high].tolist(), int(best[i]))
            symbols[low : low + len(out)] = out
            keep[low + len(out) : high] = False
            changed[low:high] = True
        if not going.all():
            done.append((place[~going], symbols[~going], segment[~going]))
        kept = np.flatnonzero(keep)
        symbols, segment, place, rank, piece = (x[kept] for x in (symbols, segment, place, rank, piece))
        changed = changed[kept]
        changed[:-1] |= changed[1:]
        stale = np.flatnonzero(changed)
    if not done:
        return symbols, segment
    places, symbols, segment = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(places, kind="stable")
    return symbols[order], segment[order]


class _Numbers(dict):
    """Numbers words as they are first looked up, and lists the new ones."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


class Encoder:
    """Ids of texts, with the words seen so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.find = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if vocabulary.splits_at_spaces else "(?s:.+)").findall
        self._forget()

    def _forget(self) -> None:
        self.seen, self.n_ids = _Numbers(), 0
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            more = np.zeros(2 * (at + len(values)), held.dtype)
            more[:at] = held[:at]
            setattr(self, name, more)
        getattr(self, name)[at : at + len(values)] = values

    def _learn(self, words: list[str]) -> None:
        v = self.vocabulary
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), size)
        place = np.minimum(np.searchsorted(v.points, points), len(v.points) - 1)
        known = v.points[place] == points
        origin = v.size + len(v.char_symbols)
        symbols = np.where(known, v.char_symbols[place], origin + points.astype(np.int64))
        place = np.where(known, place, len(v.points))
        segment = np.concatenate([[0], np.cumsum((word[1:] != word[:-1]) | ~v.together[place[:-1], place[1:]])])
        first = np.concatenate([[True], segment[1:] != segment[:-1]])
        of_segment = word[first]
        out, owner = merge_rounds(v, symbols, segment)
        owner = of_segment[owner]
        # What is no piece in the end is one character: its bytes, or one unknown id.
        odd = np.flatnonzero(out >= v.size)
        if len(odd):
            beyond = np.zeros(len(odd), np.int64)
            far = out[odd] >= origin
            beyond[far] = out[odd][far] - origin
            inner = {int(s): int(p) for s, p in zip(v.char_symbols, v.points, strict=True) if s >= v.size}
            beyond[~far] = [inner[int(s)] for s in out[odd][~far]]
            given = [v.byte_ids[np.frombuffer(chr(p).encode(), np.uint8)] if v.by_bytes else np.array([v.unknown]) for p in beyond.tolist()]
            repeat = np.ones(len(out), np.int64)
            repeat[odd] = [len(x) for x in given]
            held = np.repeat(out, repeat)
            held[np.repeat(out >= v.size, repeat)] = np.concatenate(given)
            out, owner = held, np.repeat(owner, repeat)
            if not v.by_bytes:  # a run of unknown characters is one id
                same = np.concatenate([[False], (out[1:] == v.unknown) & (out[:-1] == v.unknown) & (owner[1:] == owner[:-1])])
                out, owner = out[~same], owner[~same]
        sizes, n = np.bincount(owner, minlength=len(words)), len(self.seen) - len(words)
        self._put("starts", n, self.n_ids + np.cumsum(sizes) - sizes)
        self._put("sizes", n, sizes)
        self._put("ids", self.n_ids, out)
        self.n_ids += len(out)

    def encode(self, texts: list[str | None], begin: bool, end: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start among them."""
        v = self.vocabulary
        words = [self.find(v.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if self.n_ids > MOST_SYMBOLS:
            self._forget()
        upto = np.concatenate([[0], np.cumsum([len(x) for x in words])])
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(words)), np.int64, int(upto[-1]))
        if self.seen.new:
            self._learn(self.seen.new)
            self.seen.new = []
        sizes = self.sizes[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        own = self.ids[np.repeat(self.starts[at] - before[:-1], sizes) + np.arange(before[-1])]
        body = before[upto]
        offsets = body + (int(begin) + int(end)) * np.arange(len(texts) + 1)
        ids = np.empty(offsets[-1], np.int32)
        inside = np.ones(len(ids), bool)
        if begin:
            inside[offsets[:-1]] = False
            ids[offsets[:-1]] = v.begin
        if end:
            inside[offsets[1:] - 1] = False
            ids[offsets[1:] - 1] = v.end
        ids[inside] = own
        return ids, offsets


def decode(v: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Texts of id sequences: sequence i has ids[offsets[i]:offsets[i + 1]]."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < v.size:
        raise IndexError("piece id is out of range")
    lengths, starts = v.lengths[ids], v.starts[ids]
    upto = np.concatenate([[0], np.cumsum(lengths)])
    raw = v.bytes[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])].tobytes()
    spoken = np.flatnonzero(~v.control[ids])  # the first of a sequence loses the leading space
    first = np.searchsorted(spoken, offsets)
    out = []
    control = v.control[ids]
    between = np.concatenate([[0], np.cumsum(control)])
    for i in range(len(offsets) - 1):
        if first[i] == first[i + 1]:
            out.append("")
            continue
        low, high = int(spoken[first[i]]), int(spoken[first[i + 1] - 1]) + 1
        drop = int(bool(v.prefix) and v.spaced[ids[low]])
        if between[high] == between[low]:
            text = raw[upto[low] : upto[high]].decode("utf-8", "bytewise")
        else:  # bytes on the two sides of a control id are not one character
            cuts = [low, *(np.flatnonzero(control[low:high]) + low).tolist(), high]
            text = "".join(raw[upto[a] : upto[b]].decode("utf-8", "bytewise") for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        out.append(text[drop:])
    return out


@lru_cache(2)
def _vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


@lru_cache(1)
def _encoding(model: bytes) -> Encoder:
    """One for each worker, whatever the number of its tasks."""
    return Encoder(_vocabulary(model))


def _encoder(shared, begin: bool, end: bool, name: str) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoding(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                part = batch.slice(low, PART)
                ids, offsets = encoder.encode(part.column(part.num_columns - 1).to_pylist(), begin, end)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.record_batch([*part.columns[:-1], lists], [*part.schema.names[:-1], name])

    return run


def _decoder(shared, name: str, digest: str | None) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, PART):
                part = batch.slice(low, PART)
                lists = part.column(part.num_columns - 1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                there = lists.is_valid().to_pylist()
                said = [x if t else None for x, t in zip(decode(vocabulary, ids, offsets), there, strict=True)]
                out = [*part.columns[:-1], pa.array(said, pa.string())]
                names = [*part.schema.names[:-1], name]
                if digest:
                    raw = ids.astype("<u4")
                    out.append(pa.array([hashlib.sha256(raw[a:b].tobytes()).hexdigest() if t else None for a, b, t in zip(offsets[:-1], offsets[1:], there, strict=True)], pa.string()))
                    names.append(digest)
                yield pa.record_batch(out, names)

    return run


def _kept(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])


def _shared(docs: DataFrame, model: str):  # noqa: ANN202
    with open(model, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: some 500 KB for 32,000 pieces


def encode_texts(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", begin: bool = True, end: bool = True, name: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``name``: the ids of each whole text, an array of ints.

    ``model`` is the path of a BPE model file on the driver, which sends it to the executors.  A null or
    empty text has no ids but those of begin and end.  Strings that look like control pieces are plain text.  Other
    columns are not read, rows are kept as they are, repeated ones and null ids too; an empty frame
    gives an empty frame.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(_encoder(_shared(docs, model), begin, end, name), f"{_kept(rows)}, `{name}` array<int>")


def decode_ids(rows: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", name: str = "decoded", digest: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``name``: the text of each id sequence; with ``digest``, a column of that name too: the
    lowercase hex SHA-256 of the ids as little-endian unsigned 32-bit integers.

    Control ids are silent, byte ids that form no character are U+FFFD each, and the space before the first
    word goes if the model adds one.  Null sequences give null, empty ones the empty text; an id
    outside the vocabulary ends the job.
    """
    bounded_batches(rows.sparkSession)
    columns = rows.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))
    extra = f", `{digest}` string" if digest else ""
    return columns.mapInArrow(_decoder(_shared(rows, model), name, digest), f"{_kept(columns)}, `{name}` string{extra}")
