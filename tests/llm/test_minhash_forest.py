import random
import re

from pyspark.sql import functions as F

from echoloom.llm import minhash_forest as forest
from echoloom.llm.minhash_forest import minhash_components


def brute(rows, k, num, den):
    """Every pair of whole sets, then union-find."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = sorted((top(i), top(j)))
                up[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rnd.choice(vocabulary) for _ in range(rnd.choice([6, 40, 120]))] for _ in range(25)]
    for i in range(260):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i * 3, rnd.choice([" ", "\n", "\t"]).join(words).title() if i % 7 == 0 else " ".join(words)))
    rows += [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "one"), (1005, "ONE"), (1006, "é É"), (1007, "é é"), (1008, "a\x0bb\x0cc d"), (1009, "a b c D")]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    for k, num in ((3, 85), (5, 80)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit(1), "a": F.lit("x"), "sig": F.lit(None)})
        out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_components(docs, k, num, 100).collect()}
        assert out == brute(rows, k, num, 100)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_components(empty).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, "x " * 200_000)]
    out = sorted(map(tuple, minhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(None, 2, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (9, 1, 9, True)], key=str)


def test_dense_regions_are_cut_deeper(spark, monkeypatch):
    from echoloom.llm import minhash_forest

    rnd = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3])):
            words[rnd.randrange(200)] = f"x{rnd.randrange(9999)}"
        rows.append((i, " ".join(words)))
    rows += [(500 + i, " ".join(base) + f" tail{i}") for i in range(40)]
    monkeypatch.setattr(minhash_forest, "REGION", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_components(docs, 3, 85, 100).collect()}
    assert out == brute(rows, 3, 85, 100)


def test_links_between_groups_of_one_region(spark):
    """Groups that only their inner members tie together, and near misses among many."""
    rnd = random.Random(10)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.choice([1, 3, 5, 6, 7])):
            words[rnd.randrange(120)] = f"x{rnd.randrange(9999)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_components(docs, 3, 85, 100).collect()}
    assert out == brute(rows, 3, 85, 100)


def test_links_that_only_a_dense_region_holds(spark, monkeypatch):
    """Sets that part from a crowd at every deeper cut still meet it in the whole region."""
    from echoloom.llm import minhash_forest

    rnd = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base) + f" tail{i}") for i in range(40)]
    for i in range(40):
        words = list(base)
        for p in rnd.sample(range(200), 5):
            words[p] = f"x{rnd.randrange(10**6)}"
        rows.append((100 + i, " ".join(words)))
    monkeypatch.setattr(minhash_forest, "REGION", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_components(docs, 3, 85, 100).collect()}
    assert out == brute(rows, 3, 85, 100)


def test_sparse_links_of_boilerplate(spark, monkeypatch):
    """Pages of one boilerplate, dense in every order, with planted pairs just above the threshold and unlike all others: none is lost."""
    monkeypatch.setattr(forest, "REGION", 16)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(20_000)}" for _ in range(400)]

    def edited(x, n):
        x = list(x)
        for at in rnd.sample(range(len(x)), n):
            x[at] = f"w{rnd.randrange(20_000)}"
        return x

    def similarity(a, b):
        a, b = ({tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (a, b))
        return len(a & b) / len(a | b)

    docs, pairs = [edited(base, 8) for _ in range(500)], []
    for i in range(500):
        other = next((y for n in (10, 9, 8) if 0.856 <= similarity(docs[i], y := edited(docs[i], n)) <= 0.872), None)
        if other:
            docs.append(other)
            pairs.append((i, len(docs) - 1))
        if len(pairs) == 40:
            break
    frame = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in forest.minhash_components(frame, 3, 85, 100).collect()}
    assert len(pairs) == 40 and [got[b] for _, b in pairs] == [a for a, _ in pairs]
