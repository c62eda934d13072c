"""Token counts by offset-mapped attribution (operator 4).

A document is encoded once, whole.  The byte offsets of its tokens follow from the
lengths of their byte strings; sections are joined to them as intervals by two binary searches
each.  A token that crosses the end of a section is allocated by a stated rule:

* ``first``: to the section in which its first character begins,
* ``last``: to the section in which its last byte lies,
* ``split``: in proportion to its bytes in each section.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F

from echoloom.llm.textnum import string_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in the sense of the pattern; long runs of it are too deep for the pattern's engine.
LONG_GAP = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
OUT = "doc_id long, section string, section_no long, char_start long, char_end long, n_tokens double, doc_tokens long"


@lru_cache(2)
def tokenizer(vocabulary: str) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """A function from a text to its token ids, and the number of bytes of each token id."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)

    def encode(text: str) -> np.ndarray:
        ids, at = [], 0
        for gap in LONG_GAP.finditer(text):
            # The pattern takes such a run in one piece, but for its last character if text follows.
            end = gap.end() - (gap.end() < len(text))
            ids += encoding.encode_ordinary(text[at : gap.start()])
            ids += encoding._core_bpe.encode_single_piece(text[gap.start() : end].encode())
            at = end
        ids += encoding.encode_ordinary(text[at:] if at else text)
        return np.array(ids, np.int64)

    return encode, sizes


def allocated(ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each byte interval [low, high), for tokens that end at ``ends`` (ascending) and follow one another from 0."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if rule == "first":
        return (np.searchsorted(starts, high) - np.searchsorted(starts, low)).astype(float)
    if rule == "last":
        return (np.searchsorted(ends, high, "right") - np.searchsorted(ends, low, "right")).astype(float)
    marks, count = np.concatenate([[0], ends]), np.arange(len(ends) + 1)
    return np.interp(high, marks, count) - np.interp(low, marks, count)


def _counter(name: str, rule: str, given: bool) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = tokenizer(SparkFiles.get(name))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                data, at = string_bytes(part.column(1))
                spans = part.column(2).to_pylist() if given else None
                out: list[list] = [[], [], [], [], [], [], []]
                for i, doc in enumerate(part.column(0).to_pylist()):
                    raw = data[at[i] : at[i + 1]]
                    ends = np.cumsum(sizes[encode(raw.tobytes().decode())]) if len(raw) else np.zeros(0, np.int64)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters before each byte
                    if given:
                        own = [s for s in spans[i] or [] if s is not None and s["start"] is not None and s["end"] is not None]
                        names = [s["name"] for s in own]
                        c_low = np.clip(np.array([s["start"] for s in own], np.int64), 0, chars[-1])
                        c_high = np.maximum(np.clip(np.array([s["end"] for s in own], np.int64), 0, chars[-1]), c_low)
                        low, high = np.searchsorted(chars, c_low), np.searchsorted(chars, c_high)
                        low, high = (np.where(x == 0, 0, y) for x, y in ((c_low, low), (c_high, high)))
                        high = np.where(c_high == chars[-1], len(raw), high)
                        low = np.where(c_low == chars[-1], len(raw), low)
                    else:
                        cut = np.flatnonzero(raw == 10) + 1
                        high = np.append(cut, len(raw)) if not len(cut) or cut[-1] < len(raw) else cut
                        low = np.concatenate([[0], high[:-1]])
                        names, c_low, c_high = ["line"] * len(low), chars[low], chars[high]
                    tokens = allocated(ends, low, high, rule)
                    n = len(names)
                    for held, new in zip(out, ([doc] * n, names, range(n), c_low, c_high, tokens, [len(ends)] * n), strict=True):
                        held.extend(new)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "section", "section_no", "char_start", "char_end", "n_tokens", "doc_tokens"])

    return count


def joined_fields(*fields: str, gap: str = "\n") -> tuple[Column, Column]:
    """Fields of a row as one document, and a span for each; null fields are empty."""
    text, spans, start = [], [], F.lit(0)
    for i, name in enumerate(fields):
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        text += [F.lit(gap), value] if i else [value]
        start = start + len(gap) if i else start
        spans.append(F.struct(F.lit(name).alias("name"), start.cast("long").alias("start"), (start + F.length(value)).cast("long").alias("end")))
        start = start + F.length(value)
    return F.concat(*text), F.array(*spans)


def section_tokens(docs: DataFrame, spans: Column | None = None, rule: str = "first", vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of each section of each document.

    ``docs`` has ``doc_id`` and ``text``; other columns are only read by ``spans``: an array of
    structs (name, start, end) of character offsets, end exclusive.  Spans may overlap or
    leave gaps and are cut to the text; null spans are left out.  Without ``spans`` the
    sections are the lines, each with its line feed, and every token belongs to
    exactly one.  ``vocabulary`` is a file of the driver, which sends it to the executors.  Returns a row for each section: ``doc_id``, ``section`` (its name),
    ``section_no`` (from 0), ``char_start``, ``char_end``, ``n_tokens`` (whole unless the rule is ``split``) and
    ``doc_tokens``, the tokens of the whole document.

    A null or empty text has one empty line with no tokens.  Repeated rows are each
    given; a null doc_id is kept.  Strings that look like special tokens are plain text.
    """
    if rule not in ("first", "last", "split"):
        raise ValueError(f"no such rule: {rule}")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    rows = docs.select(*columns, *([spans.alias("spans")] if spans is not None else []))
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return rows.mapInArrow(_counter(vocabulary.rsplit("/", 1)[-1], rule, spans is not None), OUT)
