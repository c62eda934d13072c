"""Row numbers over a whole table without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from echoloom.scratch import stored


def running_sums(rows: DataFrame, order: str, *sums: str) -> DataFrame:
    """``rows`` with each column of ``sums`` replaced by its sum up to the row, in the order of a column without ties.

    As for :func:`numbered`, sums are taken inside parts and moved by the sums of earlier parts.
    """
    parts = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    upto = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = stored(parts.withColumns({c: F.sum(c).over(upto) for c in sums}), "running")
    last = held.groupBy("_part").agg(*[F.max_by(c, order).alias(c) for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = last.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    return held.join(F.broadcast(offsets), "_part").withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_part", *[f"_{c}" for c in sums])


def numbered(rows: DataFrame, *order: str, name: str = "number", start: int = 1) -> DataFrame:
    """Add ``name``: the place of each row in the order of the columns ``order``.

    Rows are range-partitioned by the order, numbered inside their part, and moved
    by the count of earlier parts.  Equal rows get different numbers, in no fixed order.
    """
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    held = stored(parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranked")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + F.col("_place") + (start - 1)).cast("long")).drop("_part", "_place", "_before")
