"""Target-distribution importance resampling over hashed word features (operator 12).

Documents are drawn with probabilities in proportion to how much likelier their words are under a target text
collection than under the corpus itself (DSIR, with Gumbel noise for drawing without replacement).

* Equal texts are grouped by their full text first, so that words are split, hashed and weighed once
  for each distinct text, whatever the number of its copies; counts of the corpus take a text's
  features times its copies.
* Weights go back to documents by the SHA-256 of the text; only then comes the noise, which is each document's own.
* The drawn are numbered in range-partitioned order, without a task that sees all.

Everything is built-in functions.  The table of gains, one number a bucket, passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from echoloom.operators.ranking import numbered
from echoloom.scratch import stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LEAST_WORDS, SEED = 10_000, 20, "2024"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, with A-Z in lower case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, GAP), lambda w: w != "")


def feature_buckets(words: Column, most_words: int = 1, buckets: int = BUCKETS) -> Column:
    """Bucket of every run of 1 to ``most_words`` consecutive words, joined by a space; repeats included."""

    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(F.encode(feature, "UTF-8")), F.lit(buckets)).cast("int")

    def runs(n: int) -> Column:
        last = F.size(words) - n
        none = F.array().cast("array<int>")
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: bucket(F.array_join(F.slice(words, i + 1, n), " ")))).otherwise(none)

    return F.concat(F.transform(words, bucket), *[runs(n) for n in range(2, most_words + 1)])


def distinct_texts(docs: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, copies, n_words, buckets): one row for each different text; a null text is the empty one."""
    grouped = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    keyed = grouped.select(text_key(F.col("text")).alias("key"), "copies", words_of(F.col("text")).alias("words"))
    return keyed.select("key", "copies", F.size("words").cast("long").alias("n_words"), feature_buckets(F.col("words"), most_words, buckets).alias("buckets"))


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def bucket_counts(texts: DataFrame) -> dict[int, int]:
    """Features by bucket, copies counted; as many rows as there are buckets at most."""
    spread = texts.select("copies", F.explode("buckets").alias("bucket"))
    return {r["bucket"]: r["n"] for r in spread.groupBy("bucket").agg(F.sum("copies").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """For each bucket a thousand times the logarithm of its smoothed share in the target over that in the source."""
    n_source, n_target = sum(source.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * float(n_source) / (float(source.get(b, 0) + 1) * float(n_target)))) for b in range(buckets)]


def weighed(texts: DataFrame, table: list[int]) -> DataFrame:
    """(key, n_words, n_features, weight) of each distinct text: the sum of its features' gains."""
    # One literal that Catalyst folds to an array.
    listed = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda done, b: done + F.get(listed, b))
    return texts.select("key", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = LEAST_WORDS, most_words: int = 1, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every document with its weight, its noisy score, and its rank if it is drawn.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``; other columns are not read.  Of the N documents
    of at least ``least_words`` words, floor(share * N) with the highest scores are drawn, ties to
    the smaller doc_id (null first), then by text.  Returns ``doc_id``, ``n_features``, ``weight``, ``score`` and
    ``rank`` (from 1; null if not drawn), all long.

    Null and empty texts have no features and weight 0; rows that repeat an id are documents of their own, with
    the same noise.  An empty corpus gives no rows, an empty target weighs against the corpus' common words.
    """
    texts = stored(distinct_texts(docs, most_words, buckets), "resample-texts")
    table = gains(bucket_counts(texts), bucket_counts(distinct_texts(target, most_words, buckets)), buckets)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    scored = stored(own.join(weighed(texts, table), "key").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = share[0] * eligible.count() // share[1]
    ranked = numbered(eligible.withColumn("_down", -F.col("score")), "_down", "doc_id", "key", name="rank")
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest)
