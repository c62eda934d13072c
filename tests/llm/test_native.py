"""Chat formatting, curriculum, licence scan and decontamination: the operators in built-in functions only."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from echoloom.llm import chat_format as chat, entries
from echoloom.llm.curriculum import curriculum, cyclic_schedules, integral, inverse_integral, targets, word_count
from echoloom.llm.decontaminate import contamination, simhash
from echoloom.llm.license_scan import BSD_HEAD, MIT, known_digests, license_scan

NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\/INST]", "<s>a\n</s>\\", "\\\\[INST]", "", "x\ny", "<", "[/INST", "é😀</s>"]


def test_escapes_are_reversible(spark):
    rnd = random.Random(1)
    texts = NASTY + ["".join(rnd.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "a", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(300)]
    rows = [(i, [(rnd.choice(["user", "assistant", "system", "a\nb</s>", "", "é"]), t) for t in rnd.sample(texts, rnd.randrange(1, 5))]) for i in range(200)]
    frame = spark.createDataFrame(rows, "id int, turns array<struct<role:string,text:string>>").withColumn("f", chat.formatted(F.col("turns")))
    for r in frame.withColumn("back", chat.read_back(F.col("f"))).withColumn("bare", F.transform("turns", lambda t: chat.escaped(t["text"]))).collect():
        assert [(b.role, b.text, b.loss) for b in r.back] == [(t.role, t.text, t.role == "assistant") for t in r.turns]
        assert not any(c in b for b in r.bare for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_layouts_are_told_by_their_fingerprints(spark):
    raw = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null}],"extra":{"a":1}}',
        '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"},{"from":"other","value":"o"}]}',
        '{"prompt":"q","response":"a"}',
        '{"prompt":"q","completion":"a","system":"s"}',
        '{"instruction":"do","input":"this","output":"a"}',
        '{"instruction":"do","input":"","output":"a"}',
        '{"question":"q","answer":"a"}',
        '{"question":"q"}',
        '{"unknown":1}',
        '{"messages":[]}',
        '{"prompt":"q"}',
        '{"response":"a"}',
        '{"prompt":"q","system":"s"}',
        '{"messages":[{"content":"c"}]}',
    ]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "id int, raw string")
    schema = (
        "messages array<struct<role:string,content:string>>, extra struct<a:int>, conversations array<struct<`from`:string,value:string>>, prompt string, response string, "
        "completion string, system string, instruction string, input string, output string, question string, answer string, unknown int"
    )
    rows = frame.select("id", F.from_json("raw", schema).alias("payload"), F.lit("clash").alias("turns"))
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns], r.formatted) for r in chat.format_chats(rows).collect()}
    assert got[0][:2] == ("messages", [("user", "q"), ("assistant", "")])
    assert got[1][:2] == ("share", [("user", "q"), ("assistant", "a"), ("other", "o")])
    assert got[2] == ("prompt_response", [("user", "q"), ("assistant", "a")], "[INST]user\nq[/INST]<s>assistant\na</s>")
    assert got[3][:2] == ("prompt_completion", [("system", "s"), ("user", "q"), ("assistant", "a")])
    assert got[4][:2] == ("instruction", [("user", "do\n\nthis"), ("assistant", "a")])
    assert got[5][1] == [("user", "do"), ("assistant", "a")]
    assert got[6][0] == "question_answer"
    assert got[7][:2] == ("question_answer", [("user", "q"), ("assistant", "")])
    assert [got[i] for i in (8, 9)] == [(None, None, None)] * 2
    assert got[10][:2] == ("prompt_response", [("user", "q"), ("assistant", "")])
    assert got[11][:2] == ("prompt_response", [("user", ""), ("assistant", "a")])
    assert got[12][:2] == ("prompt_response", [("system", "s"), ("user", "q"), ("assistant", "")])
    assert got[13][:2] == ("messages", [("", "c")])
    lone = spark.createDataFrame([(1, ("q", "a"))], "id int, payload struct<prompt:string,response:string>")
    assert chat.format_chats(lone).first().layout == "prompt_response"
    assert chat.format_chats(lone.limit(0)).count() == 0


def test_digests_of_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "user", "n"), (3, 0, "assistant", "p"), (3, 0, "assistant", "p"), (4, 0, "assistant", "z" * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("messages", F.lit(1))
    listed = chat.gathered(frame).select("conv_id", F.struct("messages").alias("payload"))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(listed)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((-1 if t is None else t), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(listed.limit(0))).count() == 0


def plain_targets(sizes, weights, share, most):
    goal, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        rest = goal - sum(most * sizes[s] for s in capped)
        got = {s: most * sizes[s] if s in capped else rest * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = [s for s in free if got[s] > most * sizes[s] + 1e-9]
        if not over:
            return got
        capped.update(over)


def test_targets_against_resharing(spark):
    rnd = random.Random(2)
    for _ in range(4):
        sizes = {f"s{i}": rnd.choice([0, 1, 5, 100, 3000]) for i in range(rnd.randrange(1, 12))}
        weights = {s: float(rnd.choice([1, 2, 5])) for s in sizes}
        frame = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
        got = {r.source: r.target for r in targets(frame).collect()}
        want = plain_targets(sizes, weights, 1.5, 2.0)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_schedules_are_inverted(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        w = [rnd.choice([0.0, 1.0, 2.5, rnd.random()]) for _ in range(rnd.randrange(2, 6))]
        if sum(w) > 0:
            rows.append((w, rnd.random()))
    frame = spark.createDataFrame(rows, "w array<double>, share double")
    got = frame.withColumn("a", integral(F.col("w"))).withColumn("t", inverse_integral(F.col("w"), F.col("a") * F.col("share"))).collect()
    for r in got:
        n = len(r.w) - 1
        area, fine = 0.0, 4000
        for i in range(int(r.t * fine)):
            x = (i + 0.5) / fine * n
            k = min(int(x), n - 1)
            area += (r.w[k] + (r.w[k + 1] - r.w[k]) * (x - k)) / fine
        assert abs(area - r.a * r.share) < 2e-3, r


def test_curriculum(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)), rnd.choice(["big"] * 6 + ["é", "b", None])) for i in range(400)]
    rows += [(7, "a b c", "big"), (None, "x y", "b"), (900, None, "b"), (901, "", "lone"), (902, "w " * 50_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"target": F.lit("clash"), "size": word_count(F.col("text"))})
    mixed = curriculum(docs, cyclic_schedules(docs, entries.SCHEDULES))
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = plain_targets(sizes, {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.position <= 1 for c in r.copies)
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    firsts = [r.copies[0].position for r in got if r.copies]
    assert firsts == sorted(firsts)
    again = curriculum(docs.repartition(7), cyclic_schedules(docs, entries.SCHEDULES)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    assert curriculum(docs.limit(0), cyclic_schedules(docs.limit(0), entries.SCHEDULES)).count() == 0


def test_rows_without_ids_come_first(spark):
    """Half of a source without ids: ordered by size, in buckets by size, before all others."""
    rows = [(None, f"{'w ' * (i % 7)}", "s") for i in range(300)] + [(i, "a b c", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", word_count(F.col("text")))
    plan = spark.createDataFrame([("s", [1.0, 1.0])], "source string, schedule array<double>")
    got = [(r.doc_id, r.size, r.copies[0].position) for r in curriculum(docs, plan, share=1.0).collect() if r.copies]
    lone = [x for x in got if x[0] is None]
    assert [s for _, s, _ in lone] == sorted(s for _, s, _ in lone) and got[: len(lone)] == lone
    at = 0
    for _, size, position in got:
        assert abs(position - at / sum(s for _, s, _ in got)) < 1e-9
        at += size


def test_curriculum_with_sizes_apart(spark):
    """Sums from a narrow table give what the rows themselves give; ids that are null or repeated included."""
    rows = [(i % 90 if i % 11 else None, f"s{i % 4}" if i % 4 else None, i % 13, f"row {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, text string")
    plan = cyclic_schedules(docs, entries.SCHEDULES)
    sizes = docs.select("size", "source", "doc_id").repartition(5)

    def told(mixed):
        return Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken, tuple(r.copies)) for r in mixed.collect())

    assert told(curriculum(docs, plan, sizes=sizes)) == told(curriculum(docs, plan))
    assert curriculum(docs.limit(0), plan, sizes=sizes.limit(0)).count() == 0


def test_curriculum_follows_time(spark):
    docs = spark.createDataFrame([(i, s, 10) for i in range(200) for s in ("early", "late")], "doc_id long, source string, size long")
    plan = spark.createDataFrame([("early", [3.0, 0.0]), ("late", [0.0, 3.0])], "source string, schedule array<double>")
    spots = defaultdict(list)
    for r in curriculum(docs, plan, share=1.0).collect():
        spots[r.source] += [c.position for c in r.copies]
    # Demand falls or rises linearly, so the median lies where half of the area is.
    assert abs(sorted(spots["early"])[100] - (1 - math.sqrt(0.5))) < 0.02 and abs(sorted(spots["late"])[100] - math.sqrt(0.5)) < 0.02


def test_license_scan(spark):
    def docs(*rows):
        return spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))

    odd = "Copyright (c) 2020 A. Nother\n\n" + MIT.replace("License", "LICENCE").replace("\n\n", "\r\n \r\n").replace(", ", " ,  ")
    rows = [
        (1, MIT),
        (2, odd),
        (3, "prose\nLicensed under CC BY-NC 4.0.\nmore\n* licenced under the apache LICENSE, version 2.0 *\n"),
        (4, "Released under the MIT License."),
        (5, "we are licensed under the MIT License today"),
        (6, None),
        (7, ""),
        (8, " \n "),
        (9, MIT + "\nmore"),
        (None, "SPDX-License-Identifier: GPL-3.0"),
        (4, "Released under the MIT License."),
        (10, "x " * 100_000),
        (11, BSD_HEAD),
    ]
    got = sorted(((r.doc_id, r.scope, r.line_no, r.license_id) for r in license_scan(docs(*rows)).collect()), key=str)
    want = [(1, "text", 0, "MIT"), (2, "text", 0, "MIT"), (3, "line", 2, "CC-BY-NC-4.0"), (3, "line", 4, "Apache-2.0")]
    want += [(4, "text", 0, "MIT"), (4, "text", 0, "MIT"), (None, "text", 0, "GPL-3.0")]
    assert got == sorted(want, key=str)
    assert license_scan(docs(*rows).limit(0)).count() == 0
    folder = Path("/usr/share/common-licenses")  # where the machine has them
    whole = [(i, (folder / n).read_text()) for i, n in enumerate(("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0")) if (folder / n).is_file()]
    if len(whole) == 4:
        again = [(i + 4, " ".join(t.upper().split()) if "opyright" not in t else t.replace("\n", "\r\n")) for i, t in whole]
        found = {r.doc_id: r.license_id for r in license_scan(docs(*whole, *again)).where("scope = 'text'").collect()}
        assert found == {i + d: n for d in (0, 4) for i, n in enumerate(("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"))}
    own = known_digests(spark, [("Own", "Be  KIND, always")])
    assert [r.license_id for r in license_scan(docs((1, "be kind always!")), own).collect()] == ["Own"]


def brute(docs, items, k=5, num=80, den=100):
    """Every item-sized window of every document that a shared shingle aligns with the item."""

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    best = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            kk = min(k, len(x))
            if not x:
                continue
            b = Counter(tuple(x[j : j + kk]) for j in range(len(x) - kk + 1))
            spots = defaultdict(list)
            for q in range(len(x) - kk + 1):
                spots[tuple(x[q : q + kk])].append(q)
            for s in {p - q for p in range(len(w) - kk + 1) for q in spots.get(tuple(w[p : p + kk]), [])}:
                v = w[max(s, 0) : s + len(x)]
                a = Counter(tuple(v[j : j + kk]) for j in range(len(v) - kk + 1))
                common = sum((a & b).values())
                union = sum((a | b).values())
                if common and common * den >= num * union:
                    key = (-common / union, max(s, 0), len(v))
                    best[d, i] = min(best.get((d, i), key), key)
    return {x: (-a, s, n) for x, (a, s, n) in best.items()}


def test_decontamination_against_every_window(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 8, 20, 40, 59])))) for i in range(25)] + [(90, None), (91, ""), (92, "one"), (93, "a b c d e " * 6), (94, "a b c d e " * 6)]
    docs = []
    for d in range(120):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 150))]
        if d % 2:
            x = (rnd.choice(items)[1] or "").split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if x:
                    x[rnd.randrange(len(x))] = "other"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = x
            if d % 10 == 1:
                w = x[2:] + w
        docs.append((d, rnd.choice([" ", "\n", "  "]).join(w).upper() if d % 3 == 0 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "ONE"), (503, "a b c d e " * 20), (504, " ".join(vocabulary) * 2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"words": F.lit(1), "item_id": F.lit(2)})
    marks = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in contamination(frame, marks).collect()}
    assert got == brute(docs, items)
    assert contamination(frame.limit(0), marks).count() == contamination(frame, marks.limit(0)).count() == 0
    assert contamination(spark.createDataFrame([(None, items[0][1]), (None, "x")], "doc_id long, text string"), marks).first().doc_id is None


def test_benchmark_in_several_blocks(spark, monkeypatch):
    from echoloom.llm import decontaminate

    items = spark.createDataFrame([(i, " ".join(f"v{i}x{j}" for j in range(12))) for i in range(30)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("before "), "text", F.lit(" after")).alias("text"))
    monkeypatch.setattr(decontaminate, "MOST_SHINGLES", 100)
    got = {(r.doc_id, r.item_id, r.start) for r in contamination(docs, items).collect()}
    assert got == {(i, i, 1) for i in range(30)}


@pytest.mark.parametrize("words", [["a"], ["a", "b", "a"], [f"x{i}" for i in range(300)]])
def test_simhash_is_a_majority(spark, words):
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    want = sum(1 << b for b in range(24) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))
    got = spark.createDataFrame([(words,)], "w array<string>").select(simhash(F.transform("w", lambda w: F.xxhash64(w)))).first()[0]
    assert got == want


def test_many_items_of_one_length(spark, monkeypatch):
    """12,000 items of 30 words that share openings: windows meet few of them, and every edited copy that is similar enough is found."""
    from echoloom.llm import decontaminate

    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    head = [["which", "of", "these", "is", "true", "about"], ["the", "answer", "to", "this", "question", "is"], []]
    items = []
    for i in range(12_000):
        first = rnd.choice(head)
        items.append((i, " ".join(first + rnd.choices(vocabulary, k=30 - len(first)))))
    docs = []
    for d in range(600):
        x = items[rnd.randrange(len(items))][1].split()
        for at in rnd.choice([[], [0], [29], [0, 29], [1], [28], [0, 1], [14]]):
            x[at] = "other"
        x = x[2:] if d % 7 == 0 else x[:-1] if d % 11 == 0 else x
        before = [] if d % 7 == 0 else rnd.choices(vocabulary, k=rnd.randrange(5))
        docs.append((d, " ".join(before + x + ([] if d % 11 == 0 else rnd.choices(vocabulary, k=5)))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    kept, real = {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: kept.setdefault(label, real(df, label)))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in contamination(frame, marks).collect()}
    of_shingle = defaultdict(set)
    for i, t in items:
        w = t.split()
        for q in range(26):
            of_shingle[tuple(w[q : q + 5])].add(i)
    want = {}
    for d, t in docs:
        w = t.split()
        shared = Counter(i for p in range(len(w) - 4) for i in of_shingle.get(tuple(w[p : p + 5]), ()))
        some = [i for i, n in shared.items() if n >= 15]  # 24 of 26 are needed, of which a cut window may lack some
        want |= brute([(d, t)], [items[i] for i in some])
    assert len(want) > 400 and got == want
    assert kept["bench-near"].count() < 10 * kept["bench-windows"].count()  # of 12,000 items
