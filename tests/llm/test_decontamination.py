"""Decontamination at the ends of documents and with openings that many items share, against every window and its SQL."""

import random

import duckdb
import pandas as pd
import pytest

from echoloom.llm import decontaminate
from echoloom.llm.decontaminate import contamination
from echoloom.llm.entries import OP9_SQL
from test_native import brute


def compared(spark, items, docs, plain=True):
    """What the operator finds, and what every window tried gives, or (on larger tables) the SQL."""
    tables = pd.DataFrame(items, columns=["item_id", "text"]), pd.DataFrame(docs, columns=["doc_id", "text"])
    got = {(r.doc_id, r.item_id, round(r.similarity, 9), r.start, r.n_words) for r in contamination(*map(spark.createDataFrame, reversed(tables))).collect()}
    if plain:
        return got, {(*pair, round(s, 9), *rest) for pair, (s, *rest) in brute(docs, items).items()}
    con = duckdb.connect()
    for name, table in zip(("benchmark", "documents"), tables, strict=True):
        con.register(name, table)
    return got, {(a, b, round(s, 9), *rest) for a, b, s, *rest in con.sql(OP9_SQL).fetchall()}


def words(draw, n):
    return ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]


@pytest.mark.parametrize("hot", [32, 0])
def test_cut_and_changed_items_of_all_lengths(spark, monkeypatch, hot):
    """With HOT = 0 every item takes the way by rarest shingles."""
    monkeypatch.setattr(decontaminate, "HOT", hot)
    draw, items, docs = random.Random(4), [], []
    for i in range(80):
        item = words(draw, draw.choice([draw.randint(1, 26), draw.randint(5, 45), draw.randint(60, 200)]))
        items.append((i, " ".join(item)))
        most = int(max(len(item) - 4, 1) * 0.2)
        for k in range(6):
            left = draw.randint(0, most)
            right = draw.randint(0, most - left)
            body = item[left : len(item) - right]
            for _ in range(draw.randint(0, 1 + len(item) // 45)):
                at = draw.randrange(len(body))
                if k % 3 == 1:
                    body[at] = words(draw, 1)[0]
                elif k % 3 == 2:
                    body.insert(at, words(draw, 1)[0])
            before, after = (words(draw, draw.randint(1, 30)) if not cut and draw.random() < 0.7 else [] for cut in (left, right))
            docs.append((len(docs), " ".join(before + body + after)))
    got, want = compared(spark, items, docs)
    assert len(want) > 250 and got == want


def test_every_pair_of_short_items_cut_at_either_end(spark):
    draw, items, docs = random.Random(5), [], []
    for n in range(5, 26):
        for _ in range(4):
            item = words(draw, n)
            items.append((len(items), " ".join(item)))
            for a, z in ((1, 0), (0, 1), (1, 1)):
                cut = item[a : n - z]
                docs.append((len(docs), " ".join((words(draw, 20) if not a else []) + cut + (words(draw, 20) if not z else []))))
    got, want = compared(spark, items, docs)
    assert got == want and len(want) >= 180


def test_shared_openings_do_not_bring_all_pairs_together(spark, monkeypatch):
    draw, kept, real = random.Random(6), {}, decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: kept.setdefault(label, real(df, label)))
    opening = words(draw, 13)
    items = [(i, " ".join(opening + words(draw, 27))) for i in range(300)]
    docs = [(i, f"{items[i][1]} {' '.join(words(draw, 30))}" if i < 50 else " ".join(opening + words(draw, 60))) for i in range(400)]
    got, want = compared(spark, items, docs, plain=False)
    assert got == want and len(want) == 50
    assert kept["bench-hot"].count() > 0 and kept["bench-near"].count() < 100


def test_equal_items_are_each_reported(spark):
    draw = random.Random(7)
    item = " ".join(words(draw, 30))
    got, want = compared(spark, [(i, item) for i in range(60)], [(0, f"x {item}"), (1, item), (2, "else " * 40)])
    assert got == want and len(want) == 120


def test_sql_agrees_with_every_window(spark):
    """A change near the start of a cut item gives two windows of one start."""
    draw = random.Random(8)
    item = words(draw, 45)
    docs = [(0, " ".join(item[1:6] + ["more"] + item[6:] + words(draw, 20))), (1, " ".join(item[1:])), (2, " ".join(item[2:9] + ["more"] + item[9:]))]
    got, want = compared(spark, [(0, " ".join(item))], docs)
    assert got == want == compared(spark, [(0, " ".join(item))], docs, plain=False)[1]
