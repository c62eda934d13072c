"""Benchmark decontamination by SimHash windows (operator 9), in built-in functions only.

Windows of a document that are as long as a benchmark item are fingerprinted and
compared with the items' fingerprints through a multi-index over Hamming blocks;
what the index brings together is verified on weighted five-word shingles.

* A window can only reach the similarity if it shares a shingle with an item of its
  size.  Windows are therefore laid where a shared shingle aligns them with the item: one at
  word p of the document and word q of the item gives the window that begins at p - q.  All
  shingles of all documents are tried, and every alignment of each.
* The fingerprint of a window has a block of ``BITS`` bits for each of :func:`parts` parts of the item's length: the
  SimHash of the words there, each bit the majority of that bit among the words' hashes.  A window that the
  document's start or end cuts has blocks for the parts that it holds whole.
* The multi-index: an item is filed, part by part, under all values within ``RADIUS`` bits of its block, so it
  meets every window with one block that near.  Of n blocks, fingerprints that differ in less than n * (RADIUS + 1)
  bits in all always meet.  Parts are so small that a run of equal words which a window of the similarity must
  share with its item holds a whole one (see :func:`parts`), and each run is aligned by a window of its own.
* A value that more than ``HOT`` items of a length are filed under, as of an opening that many share, is taken out of
  the index.  Its items meet windows through their rarest shingles instead: of the item's b shingles a window must share
  num / den * b, hence one of any b - that + 1 (a prefix filter), and it has it where some window is aligned by it.
* Verification: weighted Jaccard similarity of the two multisets of shingles, for every window of the document
  that overlaps the one that was met.

The index holds values and row numbers; words join them once a pair is found.  Item shingles are broadcast
in blocks of at most ``MOST_SHINGLES``; a larger benchmark takes more passes over the documents, one for each block.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from echoloom.scratch import stored

K, BITS, RADIUS, HOT = 5, 24, 1, 32
MOST_SHINGLES = 500_000  #: rows of at most some 40 bytes, so 20 MB a broadcast
#: All masks of at most RADIUS bits.
NEAR_MASKS = [sum(1 << b for b in bits) for n in range(RADIUS + 1) for bits in combinations(range(BITS), n)]
GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; empty for null, empty and blank ones."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), GAP), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """64-bit hashes of all runs of k words, in order."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column, bits: int = BITS) -> Column:
    """The majority of each of the lowest bits among 64-bit hashes."""

    def add(done: Column, b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda x: F.call_function("getbit", x, b) == 1))
        return F.when(ones * 2 > F.size(hashes), done.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(done)

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), add)


def lost_shingles(n_words: Column, k: Column, num: int, den: int) -> Column:
    """The most shingles of an item that a window of the similarity may lack; a window may be the item cut by so many words."""
    return F.floor((n_words - k + 1) * F.lit(den - num) / F.lit(den))


def parts(n_words: Column, k: Column, num: int, den: int) -> Column:
    """Into how many parts an item is cut, so that any window of the similarity shares a whole part.

    Of the b shingles ``lost`` may be missing.  A change inside a window costs both sides, so at most
    b * (den - num) / (den + num) are missing there, k - 1 or more for each change.  The longest run
    of equal words between changes has then at least ``run`` words, and holds any part of half as many.
    """
    b, lost = n_words - k + 1, lost_shingles(n_words, k, num, den)
    changes = F.floor(F.floor(b * F.lit(den - num) / F.lit(den + num)) / F.greatest(k - 1, F.lit(1)))
    run = F.ceil((b - lost) / (changes + 1)) + k - 1
    return F.when(lost < 1, 1).otherwise(F.ceil(n_words / F.greatest(F.floor((run + 1) / 2), F.lit(1)))).cast("int")


def _blocks(words: Column, n_words: Column, lead: Column, n_parts: Column) -> Column:
    """(part, value) of each part that is held whole; ``words`` begin at place ``lead`` of an item of ``n_words``."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def one(i: Column) -> Column:
        low, high = (F.floor((i + d) * n_words / n_parts).cast("int") - lead for d in (0, 1))
        whole = (low >= 0) & (high > low) & (high <= F.size(words))
        return F.struct(i.alias("part"), F.when(whole, simhash(F.slice(hashes, F.greatest(low, F.lit(0)) + 1, F.greatest(high - low, F.lit(0))))).alias("value"))

    return F.filter(F.transform(F.sequence(F.lit(0), n_parts - 1), one), lambda b: b["value"].isNotNull())


def _text_shingles(words: Column, k: Column) -> Column:
    """Shingles as strings, each with its number among equal ones, so that sets of them count repeats."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, k), " "))
    ordered = F.array_sort(runs)
    return F.when(F.size(F.array_distinct(runs)) == F.size(runs), runs).otherwise(F.transform(ordered, lambda x, i: F.concat(x, F.lit(" "), (i - F.array_position(ordered, x)).cast("string"))))


def _windows(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, k, n_words, start, lead, words): windows laid by shingles shared with items, for one block of items.

    ``lead`` counts the words of the item that would lie before the document.
    """

    def sized(words: Column, k: int) -> Column:
        return F.transform(shingles(words, k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("p"), h.alias("h")))

    def every(words: Column) -> Column:
        return F.concat(*[sized(words, k) for k in sizes])

    spots = F.collect_set(F.struct("n_words", "q")).alias("spots")
    filed = items.select("k", "n_words", F.explode(every(F.col("words"))).alias("s")).where("s.k = k").select("k", "n_words", F.col("s.p").alias("q"), F.col("s.h").alias("h")).groupBy("k", "h").agg(spots)
    # The shingles are a column of their own: exploding them is then generated code, which copies words only for rows that
    # meet an item.  The outer form keeps Catalyst from inferring a filter that would compute them once more.
    split = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    if len(sizes) == 1:
        spread = split.withColumn("hs", shingles(F.col("words"), sizes[0])).select("doc_id", "words", F.posexplode_outer("hs").alias("p", "h"))
        met = spread.join(F.broadcast(filed), "h")
    else:
        spread = split.withColumn("hs", every(F.col("words"))).select("doc_id", "words", F.explode_outer("hs").alias("s")).select("doc_id", "words", "s.k", "s.p", "s.h")
        met = spread.join(F.broadcast(filed), ["h", "k"])
    laid = met.select("doc_id", "words", "k", "p", F.explode("spots").alias("s"))
    begin = F.col("p") - F.col("s.q")
    start, lead = F.greatest(begin, F.lit(0)), F.greatest(-begin, F.lit(0))
    return laid.select("doc_id", "k", F.col("s.n_words").alias("n_words"), start.alias("start"), lead.alias("lead"), F.slice("words", start + 1, F.col("s.n_words") - lead).alias("words"))


def _met_by_rarest(windows: DataFrame, items: DataFrame, some: DataFrame, num: int, den: int) -> DataFrame:
    """(window, item): windows that hold, in its place, one of the rarest shingles of one of ``some`` items."""

    def spread(rows: DataFrame, lead: Column, *keep: str) -> DataFrame:
        hashes = F.when(F.size("words") >= F.col("k"), F.transform(F.sequence(F.lit(0), F.size("words") - F.col("k")), lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, F.col("k")), " "))))
        return rows.withColumns({"hs": hashes, "_lead": lead}).select(*keep, "k", "n_words", "_lead", F.posexplode("hs").alias("i", "h")).withColumn("q", F.col("i") + F.col("_lead")).drop("i", "_lead")

    rarity = spread(items, F.lit(0), "item").groupBy("k", "h").agg(F.count("*").alias("held"))
    order = Window.partitionBy("item").orderBy("held", "h", "q")  # one item's shingles
    ranked = spread(some, F.lit(0), "item").join(rarity, ["k", "h"]).withColumn("place", F.row_number().over(order))
    rarest = ranked.where(F.col("place") <= lost_shingles(F.col("n_words"), F.col("k"), num, den) + 1)
    sizes = some.select("k", "n_words").distinct()
    return spread(windows.join(sizes, ["k", "n_words"], "left_semi"), F.col("lead"), "window").join(rarest, ["k", "n_words", "q", "h"]).select("window", "item")


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, num: int = 80, den: int = 100) -> DataFrame:
    """Where documents hold items of a benchmark.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``; other columns
    are ignored.  Returns a row for each document and item that meet: ``doc_id``, ``item_id``,
    ``similarity`` (of the best window), ``start`` (its first word, from 0; the first of equals, of those the shortest) and ``n_words``.
    A window counts if ``den * common >= num * union`` for the multisets of its and the
    item's k-word shingles.  Items of fewer than k words are compared as one shingle of all their
    words.  A window that would begin before its document or end behind it is cut there.

    Null, empty and blank texts hold nothing and, as items, are held by nothing; equal items
    are each reported; rows that repeat a doc_id, or have none, are reported as one document.
    """
    spark = docs.sparkSession
    split = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n_words", F.size("words")).where("n_words > 0")
    items = stored(split.withColumns({"k": F.least(F.lit(k), F.col("n_words")), "item": F.monotonically_increasing_id()}), "bench-items")
    held = {row["k"]: row["n"] for row in items.groupBy("k").agg(F.sum("n_words").alias("n")).collect()}  # at most k rows
    if not held:
        return spark.createDataFrame([], "doc_id long, item_id long, similarity double, start long, n_words long")
    passes = sum(held.values()) // MOST_SHINGLES + 1
    laid = [_windows(docs, items.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == b), sorted(held)) for b in range(passes)]
    windows = stored(reduce(DataFrame.unionByName, laid).distinct().withColumn("window", F.monotonically_increasing_id()), "bench-windows")

    key = ["k", "n_words", "part", "value"]
    n_parts = parts(F.col("n_words"), F.col("k"), num, den)
    own = _blocks(F.col("words"), F.col("n_words"), F.lit(0), n_parts)
    near_values = F.transform(F.array(*map(F.lit, NEAR_MASKS)), lambda m: F.col("b.value").bitwiseXOR(m.cast("long")))
    index = stored(items.select("item", "k", "n_words", F.explode(own).alias("b")).select("item", "k", "n_words", "b.part", F.explode(near_values).alias("value")), "bench-index")
    hot = stored(index.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*key), "bench-hot")
    asked = windows.select("window", "k", "n_words", F.explode(_blocks(F.col("words"), F.col("n_words"), F.col("lead"), n_parts)).alias("b")).select("window", "k", "n_words", "b.part", "b.value")
    met = asked.join(index.join(hot, key, "left_anti"), key).select("window", "item")
    by_rarest = _met_by_rarest(windows, items, items.join(index.join(hot, key, "left_semi").select("item").distinct(), "item"), num, den)
    near = stored(met.unionByName(by_rarest).distinct(), "bench-near")

    # Every window of the document that overlaps one that was met: another alignment may be the best.
    begin = (F.col("start") - F.col("lead")).alias("begin")
    places = windows.select("window", "doc_id", "k", "n_words", begin)
    found = near.join(places, "window").select("item", F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.col("n_words").alias("_n"), F.col("begin").alias("_b")).distinct()
    beside = found.join(places, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("k")) & (F.col("_n") == F.col("n_words")) & (F.abs(F.col("_b") - F.col("begin")) < F.col("n_words")))
    pairs = beside.select("window", "item").distinct()

    both = pairs.join(windows.select("window", "doc_id", "k", "start", "words"), "window").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item").where("size(words) >= k")
    cut = both.withColumns({"a": _text_shingles(F.col("words"), F.col("k")), "b": _text_shingles(F.col("item_words"), F.col("k"))})
    scored = cut.select("doc_id", "item_id", "start", F.size("words").alias("n_words"), F.size(F.array_intersect("a", "b")).alias("common"), (F.size("a") + F.size("b")).alias("both"))
    scored = scored.withColumn("union", F.col("both") - F.col("common"))
    good = scored.where(F.col("common") * den >= F.col("union") * num).withColumn("similarity", F.col("common") / F.col("union"))
    best = F.min_by(F.struct("similarity", "start", "n_words"), F.struct(-F.col("similarity"), F.col("start"), F.col("n_words")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.similarity", F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"))
