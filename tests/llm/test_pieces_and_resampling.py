"""SentencePiece merges against the library, and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import entries
from echoloom.llm.importance import resample
from echoloom.llm.piece_merges import Encoder, Vocabulary, decode, decode_ids, encode_texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def vocabulary(model):
    with open(model, "rb") as f:
        return Vocabulary(f.read())


PARTS = ["a", "b", " ", "  ", "the", "▁", "\n", "é", "日", "本", "\u0000", "\t", "😀", "ing", " t", "</s>", "<s>", "<0x0A>", "=", "====", "0", "﻿", "é", "x" * 5, "ß", " " * 7, "-" * 13]


def agree(library, vocabulary, encoder, texts):
    ids, at = encoder.encode(texts, True, True)
    said = decode(vocabulary, ids, at)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert ids[at[i] : at[i + 1]].tolist() == want, text
        assert said[i] == library.decode(want), text


def test_ids_of_the_library(library, vocabulary):
    draw, encoder = random.Random(5), Encoder(vocabulary)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    agree(library, vocabulary, encoder, ["", None, " ", "  ", "\n", "a", "▁a", " ▁ a", "</s>[INST] ok"])
    agree(library, vocabulary, encoder, ["".join(draw.choices(PARTS, k=draw.randint(0, 40))) for _ in range(2000)])
    agree(library, vocabulary, encoder, ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(2000)])
    agree(library, vocabulary, encoder, ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(0, 200))) for _ in range(500)])
    agree(library, vocabulary, encoder, [" " * 50_001, "a" * 50_000, "ab" * 30_000 + " " * 999 + "c", "".join(draw.choices("aeinrst", k=20_000))])


def test_words_are_forgotten(library, vocabulary, monkeypatch):
    monkeypatch.setattr("echoloom.llm.piece_merges.MOST_SYMBOLS", 40)
    encoder = Encoder(vocabulary)
    for i in range(20):
        agree(library, vocabulary, encoder, [f"some words {i} and {j} more" for j in range(5)])
    assert encoder.n_ids < 300


def test_any_ids_decode_as_in_the_library(library, vocabulary):
    draw = random.Random(6)
    for _ in range(3000):
        ids = [draw.choice([0, 1, 2, draw.randint(3, 258), draw.randint(3, 258), draw.randint(259, 31999)]) for _ in range(draw.randint(0, 10))]
        assert decode(vocabulary, np.array(ids, np.int64), np.array([0, len(ids)])) == [library.decode(ids)], ids
    with pytest.raises(IndexError):
        decode(vocabulary, np.array([32000]), np.array([0, 1]))


def test_frames_with_odd_rows(spark, model, library):
    rows = [(1, "one two"), (1, "one two"), (None, "x  y"), (3, None), (4, ""), (5, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = encode_texts(docs, model, begin=False)
    want = sorted((str(i), library.encode(t or "", add_eos=True)) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in coded.collect()) == want
    said = decode_ids(coded.unionByName(spark.createDataFrame([(9, None), (8, [])], coded.schema)), model, digest="sha")
    found = {(r.doc_id, r.decoded) for r in said.collect()}
    assert found == {(i, t or "") for i, t in rows} | {(9, None), (8, "")}
    assert {r.sha for r in said.where("doc_id = 4").collect()} == {hashlib.sha256((2).to_bytes(4, "little")).hexdigest()}
    assert encode_texts(docs.limit(0), model).count() == 0


def test_registered_encoding(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entries.op11_piece_merges(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, most):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, num, den, least, most, buckets):
    own = [(i, *plain_features(t, most)) for i, t in docs]
    s, t = Counter(x % buckets for _, _, f in own for x in f), Counter(x % buckets for _, u in target for x in plain_features(u, most)[1])
    n_s, n_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, words, f in own:
        weight = sum(math.floor(1000 * math.log((t[x % buckets] + 1) * n_s / ((s[x % buckets] + 1) * n_t))) for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    some = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(some[: num * len(some) // den])}
    return sorted((str(x[0]), *x[2:], rank.get(id(x))) for x in out)


@pytest.mark.parametrize("most", [1, 2])
def test_resampling_against_plain(spark, most):
    draw, words = random.Random(7), ["Alpha", "beta", "É9", "x-y", "日本", "it's", "12", "_", "gamma\x7fdelta"]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12)))) for i in range(200)] + [(i, "beta 12 beta Alpha") for i in range(200, 260)]
    docs += [(300, None), (301, ""), (302, " \n"), (None, "beta 12 É9 gamma beta 日本"), (5, docs[5][1])]
    target = [(0, "beta beta 12"), (1, None), (2, "日本 Alpha")]
    clash = {"weight": F.lit("w"), "rank": F.lit(0), "key": F.lit(1), "buckets": F.lit(2)}
    frame, other = (spark.createDataFrame(x, "doc_id long, text string").withColumns(clash) for x in (docs, target))
    got = resample(frame, other, share=(30, 100), least_words=4, most_words=most, buckets=64)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = plain(docs, target, 30, 100, 4, most, 64)
    # Two rows with one id, text and score: either has the better rank.
    assert sorted(map(str, ((str(r.doc_id), *r[1:]) for r in got.collect()))) == sorted(map(str, want))


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert resample(docs.limit(0), docs).count() == 0
    got = {r.doc_id: r for r in resample(docs, docs.limit(0), share=(1, 2)).collect()}
    assert sorted(r.rank for r in got.values() if r.rank) == [1] and got[1].n_features == 30
