"""Mixing sources along a time-varying curriculum (operator 3), in built-in functions only.

A source's weight schedule is piecewise linear over training time 0 to 1.  Its
integral weighs the source when the word budget is shared out; its running integral,
scaled to the source's target, is the cumulative demand.  A document that begins after q
words of its source is due when demand reaches q, so its position is the inverse of the
demand at q.  Documents are range-sorted by position.

Running word counts of a source never meet in one task: documents are dealt to
4096 buckets of each source by the md5 of their id (those without an id by their size), buckets are summed
before the shuffle, and a document adds its place in its bucket to what earlier buckets hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DIGITS = 3  #: hex digits of md5, so 4096 buckets of each source
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_schedules(sources: DataFrame, schedules: tuple[tuple[float, ...], ...]) -> DataFrame:
    """(source, schedule): sources by code point, null last, take the schedules in turn.

    A schedule gives weights at evenly spaced times from 0 to 1, at least two.
    """
    n = len(schedules)
    known = sources.select("source").distinct()
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row for each source
    turns = F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules])
    return known.withColumn("_place", place).select("source", F.element_at(turns, (F.col("_place") % n + 1).cast("int")).alias("schedule"))


def integral(schedule: Column) -> Column:
    """Area below a schedule given at evenly spaced times from 0 to 1 (at least two)."""
    inner = F.aggregate(schedule, F.lit(0.0), lambda a, w: a + w) - (F.element_at(schedule, 1) + F.element_at(schedule, -1)) / 2
    return inner / (F.size(schedule) - 1)


def inverse_integral(schedule: Column, area: Column) -> Column:
    """The time at which the running integral of a schedule reaches ``area``."""
    step = F.lit(1.0) / (F.size(schedule) - 1)
    start = F.struct(F.lit(0.0).alias("t"), area.cast("double").alias("left"), F.lit(False).alias("done"))

    def walk(a: Column, i: Column) -> Column:
        u, v = F.get(schedule, i), F.get(schedule, i + 1)
        whole = (u + v) / 2 * step
        slope, c = (v - u), a["left"] / step
        root = u + F.sqrt(F.greatest(u * u + slope * c * 2, F.lit(0.0)))
        x = F.when(root > 0, F.least(c * 2 / root, F.lit(1.0))).otherwise(0.0)
        over = a["done"] | (a["left"] < whole)
        t = F.when(a["done"], a["t"]).when(a["left"] < whole, a["t"] + x * step).otherwise(a["t"] + step)
        return F.struct(t.alias("t"), F.when(over, a["left"]).otherwise(a["left"] - whole).alias("left"), over.alias("done"))

    return F.aggregate(F.sequence(F.lit(0), F.size(schedule) - 2), start, walk)["t"]


def _bucket(key: Column, size: Column) -> Column:
    """In the order of keys, then sizes: the first digits of a key, or for an empty one the size, which a space puts first."""
    return F.when(key == "", F.concat(F.lit(" "), F.lpad(size.cast("string"), 19, "0"))).otherwise(F.substring(key, 1, BUCKET_DIGITS))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Share ``share`` times all words by weight; no source above ``most`` times its size.

    ``sizes`` has ``source``, ``source_size`` and ``weight`` (above 0), one row a source.
    What a capped source leaves is shared by weight until none is above its cap: the
    sources in order of cap over weight are capped as long as the level that
    the rest would get exceeds their own.
    """
    if share > most:
        raise ValueError("the caps cannot hold that share")
    cap = F.lit(most) * F.col("source_size")
    order = Window.orderBy((cap / F.col("weight")), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = sizes.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"),
        F.row_number().over(order).alias("place"),
    )
    free = level.withColumn("free", F.col("weight") * F.col("left") <= cap * F.col("weights"))
    first = F.min_by(F.struct("place", "left", "weights"), F.when(F.col("free"), F.col("place"))).over(everything)
    out = free.withColumn("first", first)
    return out.select("source", "source_size", "weight", F.when(F.col("place") < F.col("first.place"), cap).otherwise(F.col("weight") * F.col("first.left") / F.col("first.weights")).alias("target"))


def curriculum(docs: DataFrame, schedules: DataFrame, share: float = 1.5, most: float = 2.0, ordered: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """Assign every document of a mix its words and positions.

    ``docs`` has ``doc_id``, ``source`` and ``size`` (words, not null) besides any other columns,
    which are kept; ``schedules`` has a row (source, schedule) for each source.  Adds
    ``source_size``, ``target``, ``taken`` (words that the mix takes, repeats counted)
    and ``copies``: an array of (copy, words, position).  Copies follow one another in
    whole passes over the source, in the order of the md5 of the id; the pass that
    reaches the target stops inside a document, which gives its leading words.  With ``ordered`` rows are
    range-sorted by their first position, those not taken last.  ``sizes``, if given, holds
    ``doc_id``, ``source`` and ``size`` of the same rows: sums are taken from it, so that wide
    rows are read once.

    Defined cases: a null source is a source of its own; a document without words takes
    nothing and has no copies; a null doc_id is ordered first in its source; rows that
    repeat an id are taken each; equal rows may stand for one another.  An empty table
    gives an empty result.
    """
    def name(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("s"), F.col(column)), F.lit("n"))

    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken", "copies")]
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))

    def deal(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.select(*columns, name("source").alias("_source"), key.alias("_key")).withColumn("_bucket", _bucket(F.col("_key"), F.col("size")))

    dealt = deal(docs, kept)
    counted = dealt if sizes is None else deal(sizes, ["doc_id", "source", "size"])
    buckets = counted.groupBy("_source", "_bucket").agg(F.sum("size").alias("_held"), F.first("source").alias("source"))
    weighed = schedules.select(name("source").alias("_source"), F.col("schedule").alias("_schedule"), integral(F.col("schedule")).alias("_weight"))
    sums = buckets.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_held").alias("_size")).join(weighed, "_source")
    goals = targets(sums.select("source", F.col("_size").alias("source_size"), F.col("_weight").alias("weight")), share, most).select(name("source").alias("_source"), F.col("target").alias("_target"))
    plan = sums.drop("source").join(goals, "_source")
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("_source", "_bucket", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before")).join(plan, "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_upto", F.sum("size").over(inside)).join(starts, ["_source", "_bucket"])
    begin = F.col("_before") + F.col("_upto") - F.col("size")
    goal, some = F.floor("_target"), F.col("_size") > 0
    passes, rest = F.when(some, F.floor(goal / F.col("_size"))).otherwise(0), F.when(some, goal % F.col("_size")).otherwise(0)
    part = F.greatest(F.lit(0), F.least(rest - begin, F.col("size")))
    out = placed.withColumns({"_begin": begin, "_passes": passes, "_part": part, "_taken": (passes * F.col("size") + part).cast("long")})

    def copy(i: Column) -> Column:
        words = F.when(i < F.col("_passes"), F.col("size")).otherwise(F.col("_part"))
        asked = i * F.col("_size") + F.col("_begin")
        return F.struct(i.cast("int").alias("copy"), words.cast("long").alias("words"), inverse_integral(F.col("_schedule"), asked * F.col("_weight") / F.col("_target")).alias("position"))

    numbers = F.sequence(F.lit(0), F.col("_passes").cast("int"))
    copies = F.when(F.col("_taken") > 0, F.filter(F.transform(numbers, copy), lambda c: c["words"] > 0)).otherwise(F.array().cast("array<struct<copy:int,words:bigint,position:double>>"))
    mixed = out.select(*kept, F.col("_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), copies.alias("copies"))
    return mixed.orderBy(F.asc_nulls_last(F.get("copies", F.lit(0))["position"]), "doc_id") if ordered else mixed
