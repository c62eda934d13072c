"""Token attribution, language id, URL filter, one-bit neighbours and WARC bundles."""

import binascii
import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import entries, language_id as lid, onebit_ann as ann, token_spans as spans, url_filter, warc_bundle as warc

SF = "/root/testdata/sf0.01"


# Token attribution.


def token_bytes():
    import base64

    with open(spans.VOCABULARY, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}


TEXTS = ["", "a", "Hello wörld\n\nsecond line\r\n  third", "é😀\n😀é" * 3, "x\n" * 5, "\n", "no line end", "</s><|endoftext|>\n<|endoftext|>", " " * 5000 + "x\n" + "\t" * 3000, "a" * 20_000 + "\nb", "日本語のテキスト\nです"]


def test_line_tokens_against_plain(spark):
    encode, _ = spans.tokenizer(spans.VOCABULARY)
    of = token_bytes()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (None, "x y"), (1, "a")], "doc_id long, text string").withColumn("section", F.lit("clash"))
    got = {}
    for r in spans.section_tokens(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[90]) == 1 and got[90][0].n_tokens == 0 and len(got[1]) == 2 and got[None][0].doc_tokens == 2
    for i, text in enumerate(TEXTS):
        ids = encode(text).tolist()
        assert b"".join(of[x] for x in ids).decode() == text
        lines = text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]] + [text.split("\n")[-1]]
        lines = [x for x in lines if x] or [""]
        starts, at = [], 0
        for x in ids:
            starts.append(at)
            at += len(of[x])
        want, low = [], 0
        for x in lines:
            high = low + len(x.encode())
            want.append(sum(low <= s < high for s in starts))
            low = high
        rows = sorted({r.section_no: r for r in got[i]}.values(), key=lambda r: r.section_no)
        assert [r.n_tokens for r in rows] == want and rows[0].doc_tokens == len(ids) == sum(want)
        assert "".join(text[r.char_start : r.char_end] for r in rows) == text
    assert spans.section_tokens(docs.limit(0)).count() == 0


def test_whole_texts_agree_with_another_encoder(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    got = {r.doc_id: r.n for r in spans.section_tokens(docs).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {r.doc_id: len(other.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


def test_rules_and_spans(spark):
    ends = np.array([3, 5, 10])
    low, high = np.array([0, 4, 6]), np.array([4, 6, 10])
    assert spans.allocated(ends, low, high, "first").tolist() == [2, 1, 0]
    assert spans.allocated(ends, low, high, "last").tolist() == [1, 1, 1]
    assert spans.allocated(ends, low, high, "split").tolist() == pytest.approx([1.5, 0.7, 0.8])
    text, fields = spans.joined_fields("title", "body")
    rows = spark.createDataFrame([(1, "tïtle é", "the body text"), (2, None, "only")], "doc_id long, title string, body string")
    docs = rows.withColumn("text", text).withColumn("s", fields)
    encode, _ = spans.tokenizer(spans.VOCABULARY)
    for rule in ("first", "last", "split"):
        out = {(r.doc_id, r.section): r for r in spans.section_tokens(docs, F.col("s"), rule).collect()}
        assert out[1, "title"].char_end == 7 and out[1, "body"].char_start == 8
        assert out[2, "title"].n_tokens == 0 and out[2, "body"].n_tokens == pytest.approx(len(encode("\nonly")) - (1 if rule != "split" else 1), abs=1)
        assert out[1, "title"].n_tokens + out[1, "body"].n_tokens <= out[1, "title"].doc_tokens
    odd = F.expr("array(named_struct('name', 'a', 'start', -5, 'end', 900), named_struct('name', 'b', 'start', 6, 'end', 2), null)")
    out = {(r.doc_id, r.section): r.n_tokens for r in spans.section_tokens(docs, odd).collect()}
    assert out[1, "a"] == len(encode("tïtle é\nthe body text")) and out[1, "b"] == 0
    with pytest.raises(ValueError):
        spans.section_tokens(docs, rule="none")


# Language identification.


def plain_probability(word, table):
    """Sum over all segmentations by recursion."""
    best = [1.0] + [0.0] * len(word)
    for i in range(1, len(word) + 1):
        for n in range(1, i + 1):
            best[i] += best[i - n] * table.get(word[i - n : i], table[None] if n == 1 else 0.0)
    return best[-1]


def test_forward_sums_all_segmentations():
    rnd = random.Random(1)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "é", "aé"]
    table = np.array([[rnd.random(), rnd.random()] for _ in range(len(pieces) + 1)])
    words = ["▁" + "".join(rnd.choice("abéz") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    got = lid.log_probabilities(words, lid.Pieces(pieces), table)
    for j in range(2):
        plain = dict(zip([*pieces, None], table[:, j]))
        for w, g in zip(words, got[:, j]):
            assert math.isclose(g, math.log(plain_probability(w, plain)), rel_tol=1e-9)


def test_expected_counts_fill_the_words():
    pieces = ["▁", "a", "b", "ab", "▁a"]
    counts = lid.expected_counts(["▁ab", "▁b"], np.array([2.0, 3.0]), lid.Pieces(pieces), np.full(6, 0.2))
    lengths = np.array([len(p) for p in pieces] + [1])
    assert math.isclose((counts * lengths).sum(), 2 * 3 + 3 * 2)


def test_vocabulary_lookup_is_exact():
    pieces = lid.public_pieces(lid.VOCABULARY)
    index = lid.Pieces(pieces)
    some = random.Random(2).sample(range(len(pieces)), 3000)
    for n in range(1, 17):
        own = [i for i in some if len(pieces[i]) == n]
        if own:
            found = dict(index.found([pieces[i] for i in own], n))[n][:, 0]
            assert found.tolist() == own


def test_language_of_held_out_documents(spark):
    out = entries.op5_language_id(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_odd_texts_and_nothing_learned(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "le chat et le chien", "fr"), (4, None, "en"), (5, "123 $$ ² ½ \n", "fr"), (None, "the the", "en"), (7, "", None), (8, "le" * 5000, None), (9, "the " * 50_000, None), (1, "the cat and the dog", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = lid.train(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in lid.identify(docs, model).collect()]
    assert [g[1] for g in got[:4]] == ["en", "fr", "und", "und"] and got[2][2] == 0.0
    assert [g[1] for g in got[4:]] == ["en", "und", "fr", "en", "en"]
    none = lid.train(docs.limit(0))
    assert {r.lang_pred for r in lid.identify(docs, none).collect()} == {"und"} and lid.identify(docs.limit(0), model).count() == 0


def test_many_languages_and_words(spark, monkeypatch):
    """A dirty column of languages and a text of many words stop nothing: the most frequent are learned."""
    monkeypatch.setattr(lid, "MOST_LANGUAGES", 3)
    monkeypatch.setattr(lid, "SAMPLE_WORDS", 50)
    rows = [(i, f"alpha beta gamma {'delta ' * (i % 4)}", f"l{i % 3}") for i in range(0, 60)] + [(100 + i, "word", f"junk{i}") for i in range(40)]
    rows.append((300, " ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)), "l0"))
    model = lid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["l0", "l1", "l2"] and np.allclose(model.table.sum(0), 1, atol=1e-2)


# URL filter.


def plain_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = url_filter.lower_ascii("".join(rest[: min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])]))
        path = rest[len(host) :]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0] + [len(path)])]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, "allow")))


def test_urls_against_plain(spark):
    rules = [*entries.RULES, ("bad.org", "", "block"), ("bücher.de", "/é", "block"), ("", "/empty", "block")]
    rnd = random.Random(3)
    urls = [None, "", "://", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/EN/", "x.net/es/", "a://b.net/es", "a://net/es/?", "http://a..net/fr/", "http://bad.org?q=://x", "http://xbad.org", "s://bücher.de/é/1", "http://u@example.com:80/en/", "http:///empty"]
    urls += [f"http://{rnd.choice(['', 'www.', 'a.b.'])}{rnd.choice(['example.com', 'x.net', 'net', 'bad.org', 'com'])}{rnd.choice(['', '/', '/en/', '/en', '/es/p', '/fr/#a', '?x'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, "http://net/es/"), (0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = url_filter.url_verdicts(pages, rules).collect()
    assert len(got) == len(urls) + 2
    for r in got[: len(urls)]:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id], rules), urls[r.page_id]
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


def test_very_long_urls(spark):
    """A megabyte of host or path costs no more than the rules ask for."""
    dots, path = "a." * 500_000, "/en/" * 250_000
    pages = spark.createDataFrame([(1, f"http://{dots}example.com/en/"), (2, f"http://{dots}"), (3, f"http://www.example.com{path}"), (4, "http://" + "." * 1_000_000 + "net/fr/x")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_verdicts(pages, entries.RULES).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: ("www.example.com/en/", "allow"), 4: ("net/fr/", "block")}


def test_collisions_decide_nothing(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: len(x))  # all strings of a length collide
    (tmp_path / "i").write_bytes(url_filter.packed([("aa", "/", "block"), ("bb", "/", "allow"), ("ccc", "/", "block")]))
    index = url_filter.DigestArray(str(tmp_path / "i"))
    found = index.find([b"aa/", b"bb/", b"zz/", b"ccc/", b"d/"])
    assert [i >= 0 for i in found] == [True, True, False, True, False]
    assert [bool(index.allow[i]) for i in found if i >= 0] == [False, True, False]
    (tmp_path / "none").write_bytes(url_filter.packed([]))
    assert url_filter.DigestArray(str(tmp_path / "none")).find([b"x"]).tolist() == [-1]
    with pytest.raises(ValueError):
        url_filter.packed([("a", "/", "maybe")])


# Nearest neighbours.


def plain_nearest(rows, k):
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i % 3 == 0:
            d = sorted((math.dist(v, w), j) for m, (j, w) in enumerate(good) if m != n)[:k]
            out += [(i, r, j, round(s, 9)) for r, (s, j) in enumerate(d, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [5, 400])
def test_neighbours_against_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(1000 + i, rows[0][1]) for i in range(15)] + [(3, rows[1][1]), (2000, None), (2001, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [1.0] * 7), (2007, [float("inf")] + [0.0] * 7), (2010, [None] + [1.0] * 7), (None, [1.0] * 8), (2013, [1e6] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "row": F.lit(1)}).repartition(5)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(frame, F.col("vec_id") % 3 == 0).collect())
    want = plain_nearest(rows, 10)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    same = len({(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want})
    assert same / len({(w[0], w[2]) for w in want}) >= 0.9
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want)) or same / len(want) >= 0.9
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 3 == 0).count() == 0
    assert ann.nearest(frame, F.lit(False)).count() == 0


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 7)
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in frame.collect()}
    hits = 0
    for q in (i for i in x if i % 20 == 0):
        want = sorted((float(np.linalg.norm(x[q] - x[i])), i) for i in x if i != q)[:10]
        hits += len({i for _, i in want} & {got[q, r] for r in range(1, 11)})
    assert hits / (10 * sum(i % 20 == 0 for i in x)) > 0.99


def test_bounds_hold():
    rng = np.random.default_rng(4)
    vectors, queries = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    frame = ann.Frame(0, vectors.mean(0), ann.rotation(64))
    assert np.allclose(frame.turn @ frame.turn.T, np.eye(64))
    bits, norm, match = frame.codes(vectors)
    low = ann.Queries(np.arange(20), np.arange(20), queries, np.full(20, np.inf), frame).lower_bounds(ann.signs_of(bits, 64), norm, match)
    true = ((queries[:, None, :] - vectors[None]) ** 2).sum(2)
    assert (low <= true + 1e-4).mean() > 0.9999 and (low > 0.3 * true).mean() > 0.9


@pytest.mark.parametrize("size", [(1e60,), (1e-60,), (1e200,), (1e-200,), (1.0, 1e60, 1e-60, 1e155, 3e307)])
def test_vectors_of_any_magnitude(spark, size):
    """Against distances in 300 binary digits, of finite vectors that are far from usual, alone and mixed."""
    from decimal import Decimal, getcontext

    getcontext().prec = 50
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16)) / 4 * np.array([size[i % len(size)] for i in range(300)])[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(frame, F.col("vec_id") % 25 == 0).collect()}
    exact = [[Decimal(c) for c in v] for v in x.tolist()]
    assert len(got) == 120
    for q in range(0, 300, 25):
        want = sorted((float(sum((a - b) ** 2 for a, b in zip(exact[q], v, strict=True)).sqrt()), i) for i, v in enumerate(exact) if i != q)[:10]
        for r, (d, _) in enumerate(want, 1):
            assert got[q, r][1] == pytest.approx(d, rel=1e-12)
        assert {got[q, r][0] for r in range(1, 11)} == {i for _, i in want}


def test_queries_are_read_by_chunk(spark, monkeypatch):
    """Many files of queries, rows in many chunks, and nothing kept between them."""
    monkeypatch.setattr(ann, "HELD", 0)
    monkeypatch.setattr(ann, "BLOCK", 10)
    monkeypatch.setattr(ann, "SAMPLE", 50)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(frame, F.col("vec_id") % 5 == 0).collect()}
    assert len(got) == 6000
    hits = 0
    for q in range(0, 3000, 5):
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len({got[q, r] for r in range(1, 11)} & set(np.argsort(d)[:10].tolist()))
    assert hits / 6000 > 0.999


# WARC bundles.


def test_archives_are_read_back(spark, tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(warc, "BUNDLE", 20_000)
    rnd = random.Random(5)
    big = "".join(rnd.choice("abcdé<>\r\n") for _ in range(90_000))
    rows = [(5, "u://5", "y" * 100), (3, "u://3", "y" * 100), (3, "u://3", "y" * 100), (8, None, "y" * 99), (9, "u", "y" * 99), (10, "a\r\nb", None), (11, "u", ""), (12, "u", big), (14, "u", big), (13, "u", "WARC/1.1\r\n\r\n" * 20), (None, "u", "y" * 100), (None, "n", "z" * 200), (15, "u", "é" * 50), (16, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_archive(pages, f"file://{tmp_path}/w")
    got = warc.read_archive(manifest).collect()
    assert len(got) == len(rows) == manifest.count()
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(i, first.get(raw, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        target = first.get(raw) if len(raw) >= 100 else None
        target = None if target == i else target
        want.append((warc.name_of(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if target is not None else "response", None if target is None else warc.name_of(target)))
        for r in got:
            if r.record_id == warc.name_of(i) and r.payload is not None and r.payload_bytes == len(raw):
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    # One record from its frame alone, and the file as a plain Zstandard stream.
    place = manifest.where("record_id = 'urn:page:12'").first()
    fields, payload = warc.read_record(place.bundle, place.frame, place.offset, place.length)
    assert fields["WARC-Type"] == "response" and payload == big.encode()
    raw = open(place.bundle.removeprefix("file://"), "rb").read()
    frames, _, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == warc.SEEKABLE and frames >= 1
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and big.encode() in plain
    assert warc.write_archive(pages.limit(0), f"file://{tmp_path}/e").count() == 0
    assert warc.read_archive(warc.write_archive(pages.limit(0), f"file://{tmp_path}/e2")).count() == 0
