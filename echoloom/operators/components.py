"""Connected components of an edge frame.

Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014).  Every
round keeps at most as many edges as the last, ends with stars whose centre is the
smallest id of the component, and takes a logarithmic number of rounds on chains
too.  The rounds only aggregate ``min`` per node (combined before the
shuffle) and join the minima back, so the hub of a huge star never gathers its
neighbours in one task.  The lineage is cut by writing each round to the shared
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from echoloom.scratch import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return (
        down.join(least, "a")
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .where("a <> b")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Size and order-free sums that stand for an edge set."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["x"], row["s"]


def connected_components(edges: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Label every node of ``edges`` with the smallest node id it can reach.

    Returns ``(node, component)``, one row per node that has an edge to another
    node.  Self-loops, repeated edges and either direction are allowed; rows
    with a null end are no edges.  An empty frame gives an empty frame.
    """
    spark = edges.sparkSession
    now = stored(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(),
        "cc-edges",
    )
    before = _state(now)
    while before[0]:
        after = stored(_small_star(_large_star(now)), "cc-round")
        dropped(now)
        state = _state(after)
        now = after
        if state == before:
            break
        before = state
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(centres) if before[0] else spark.createDataFrame([], members.schema)
