"""A training corpus from raw documents: language, near-duplicates, benchmark leaks, mix.

Every stage takes (spark, docs, sf_dir) and works on all documents it is given.  The
first three return the columns of ``documents``; the last adds the training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from echoloom.llm.curriculum import curriculum, cyclic_schedules, word_count
from echoloom.llm.decontaminate import contamination
from echoloom.llm.language_id import identify, train
from echoloom.llm.minhash_forest import minhash_components
from echoloom.scratch import stored

LEAST_SCORE = 0.5  #: of the predicted language
LEAST_EVIDENCE = -20.0  #: that a text is of its language rather than any letters; less goes (natural logarithm)
MOST_TORN = 100_000  #: ids that are broadcast at most
#: Weights over training time that sources, by code point and null last, take in turn.
SCHEDULES = ((5.0, 5.0, 5.0), (3.0, 2.0, 1.0), (0.5, 1.0, 1.5))
ENDS_OF_WORDS = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id``: the id, or a hash of the text beyond the usual ids for rows without an id or with one that different texts share."""
    own = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).where("doc_id IS NOT NULL")
    torn = stored(texts.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select(F.col("doc_id").alias("_torn")), "torn-ids")
    few = torn.count() <= MOST_TORN
    joined = docs.join(F.broadcast(torn) if few else torn, F.col("doc_id").cast("long") == F.col("_torn"), "left")
    usable = F.when(F.col("_torn").isNull(), F.col("doc_id").cast("long"))
    return joined.withColumn("_id", F.coalesce(usable, own)).drop("_torn")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is undetermined (no letters), whose score is below LEAST_SCORE, or whose letters are as good as any (LEAST_EVIDENCE)."""
    columns = docs.columns
    judged = identify(docs, train(docs), keep=tuple(columns), names=("_lang", "_sure", "_evidence"))
    return judged.where((F.col("_lang") != "und") & (F.col("_sure") >= LEAST_SCORE) & (F.col("_evidence") >= LEAST_EVIDENCE)).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id.

    Rows that repeat an id and a text count as one document, of which one row stays; rows without an id, and rows
    of one id with different texts, are told apart by their texts and yield to rows that have an id of their own.
    """
    columns = docs.columns
    keyed = _keyed(docs)
    kept = minhash_components(keyed.select(F.col("_id").alias("doc_id"), "text"), k=5, num=80, den=100).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    one = F.row_number().over(Window.partitionBy("_id").orderBy("text", "source", "lang"))
    return keyed.join(kept.hint("merge"), "_id", "left_semi").withColumn("_place", one).where("_place = 1").select(*columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold an item of the benchmark."""
    columns = docs.columns
    keyed = _keyed(docs)
    hits = contamination(keyed.select(F.col("_id").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(hits.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_anti").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order: columns of documents, ``copy``, ``words`` and ``position``.

    A copy that the mix takes in part has its leading words as text.
    """
    columns = [c for c in docs.columns if c not in ("copy", "words", "position")]
    sized = docs.select(F.struct(*columns).alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = stored(sized.select("doc_id", "source", "size"), "mix-sizes")
    schedules = stored(cyclic_schedules(sizes, SCHEDULES), "mix-schedules")
    mixed = curriculum(sized, schedules, share=1.5, most=2.0, ordered=False, sizes=sizes)
    # The outer form: else Catalyst infers a filter on the number of copies and computes them once more for it.
    copies = mixed.select("_row", "size", F.explode_outer("copies").alias("_c")).where("_c IS NOT NULL")
    words = F.col("_c.words")
    part = F.array_join(F.slice(F.split("_row.text", ENDS_OF_WORDS), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("size"), part).otherwise(F.col("_row.text"))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    kept = [own.get(c, F.col(f"_row.{c}")).alias(c) for c in columns]
    return copies.select(*kept, "_c.copy", "_c.words", "_c.position").orderBy("position", "doc_id", "copy")


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]

#: Language models and fingerprints are not SQL; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
