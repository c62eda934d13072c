"""Every stage of the pipeline against a plain version, on a small table of documents."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Letters at random, a permuted alphabet, a language and a script that no label names.
STRANGE = [
    " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2 + i % 8)) for i in range(60)),
    "xlmw mw er sphivh tevekvetl amxl epp mxw pixxivw qsziz fc e jigmih ryqfiv sj tpegiw",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "人人生而自由在尊严和权利上一律平等" * 20,
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(w, k=5):
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents, with rows of every odd kind among them."""
    path = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    text = docs.where("doc_id = 7").first().text
    odd = [(9001, None, "en", "src0"), (9002, "", "en", "src0"), (9003, "123 !!!", "en", "src0"), (9004, text, "en", None), (9004, text, "en", None), (None, "before the " + item + " after the end", "en", "src1"), (None, "a lone text of its own that the others lack entirely", "en", "src1"), (9005, text + " and the end", None, "src2"), (9006, f"so {item} it is", "en", "src9")]
    odd += [(9007, " ".join(f"{w} no such text was ever" for w in text.split()[:30]), "en", "src1"), (9007, "another text under the same number, which has to stay as well", "en", "src2")]
    odd += [(9010 + i, t, None, "src0") for i, t in enumerate(STRANGE)]
    more = spark.createDataFrame([(*r, len(r[1] or "")) for r in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return f"{path}"


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The documents before and after every stage, stored in between."""
    out, now = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, now, folder).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((now.collect(), after.collect(), after.columns))
        now = after
    return out


def test_columns(stages):
    assert [columns for _, _, columns in stages[:-1]] == [COLUMNS] * 3
    assert stages[-1][2] == [*COLUMNS, "copy", "words", "position"]


def test_language_stage(stages):
    before, after, _ = stages[0]
    want = [r for r in before if re.search(r"[^\W\d_]", r.text or "") and r.text not in STRANGE]
    assert not {r.text for r in after} & set(STRANGE)
    assert Counter(after) <= Counter(want)
    assert len(after) >= 0.99 * len(want)  # all of these texts are of one of the languages


def test_near_duplicate_stage(stages):
    before, after, _ = stages[1]
    # No id, or one of different texts: a document of its own.  Equal ids and texts: one document.
    texts = defaultdict(set)
    for r in before:
        texts[r.doc_id].add(r.text)
    docs = {(r.doc_id if r.doc_id is not None and len(texts[r.doc_id]) == 1 else r.text): r for r in before}
    assert len(texts[9007]) == 2 and sum(r.doc_id == 9007 for r in after) == 2
    sets = {i: shingles(words(r.text)) for i, r in docs.items()}
    ids = sorted(sets, key=lambda i: (isinstance(i, str), i))
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                p, q = sorted((top(i), top(j)), key=ids.index)
                up[q] = p
    assert Counter(after) == Counter(docs[i] for i in ids if top(i) == i)


def test_decontamination_stage(stages, spark, folder):
    before, after, _ = stages[2]
    items = [shingles(words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    held = [r for r in before if any(i <= shingles(words(r.text)) for i in items)]
    kept = Counter(after)
    assert len(held) >= 2 and not any(kept[r] for r in held)
    clean = [r for r in before if not any(len(i & shingles(words(r.text))) > 0.5 * len(i) for i in items)]
    assert all(kept[r] for r in clean) and sum(kept.values()) <= len(before)


def test_mix_stage(stages):
    before, after, _ = stages[3]
    sizes, taken, per = Counter(), Counter(), defaultdict(int)
    for r in before:
        sizes[r.source] += len(words(r.text))
    for r in after:
        taken[r.source] += r.words
        per[r.doc_id] += r.words
        assert len(words(r.text)) == r.words and r.n_chars == len(r.text)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: sum(a + b for a, b in zip(w, w[1:])) / 4 for s, w in ((s, pipeline.SCHEDULES[i % 3]) for i, s in enumerate(order))}
    free, goal = set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (goal - sum(2 * sizes[s] for s in sizes if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        free -= over
    want = {s: level * weight[s] if s in free else 2 * sizes[s] for s in sizes}
    assert all(math.isclose(taken[s], want[s], abs_tol=1) for s in sizes)
    assert all(0 <= r.position <= 1 for r in after)
    originals = {(r.doc_id, r.source): r.text for r in before}
    assert all(originals[r.doc_id, r.source].startswith(r.text) for r in after if r.doc_id is not None)


def test_run_gives_what_the_stages_give(spark, folder, stages):
    out = pipeline.run(spark, folder)
    got = sorted(((r.doc_id, r.copy, r.words) for r in out.collect()), key=str)
    assert got == sorted(((r.doc_id, r.copy, r.words) for r in stages[-1][1]), key=str)
    assert [r.position for r in out.collect()] == sorted(r.position for r in stages[-1][1])


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit(1)).limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0 and "score" in docs.columns
