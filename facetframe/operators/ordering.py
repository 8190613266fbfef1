"""Row numbers and running totals over a whole table, without a one-task window.

Rows are range-partitioned on the order key, sorted inside each partition and
materialised reliably. The partition sizes (one row per partition) then shift
each partition's own numbering. Rows that share an order key keep their order
of reading, by an extra key that also lets a frequent key span many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from facetframe.operators.frames import cell, order_columns
from facetframe.session import checkpointed

LOW_BITS = 33


def _ranged(df: DataFrame, order_by, partitions: int | None) -> DataFrame:
    keys = [*order_columns(order_by), F.col("_tie")]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie")
    return checkpointed(ranged.withColumn("_id", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_id", LOW_BITS)
    )


def numbered(df: DataFrame, order_by, name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in the given order."""
    rows = _ranged(df, order_by, partitions)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    position = F.col("_id").bitwiseAND((1 << LOW_BITS) - 1)
    return rows.join(F.broadcast(starts), "_range").select(
        *[cell(c) for c in df.columns], (F.col("_start") + position + 1).alias(name)
    )


def running_total(
    df: DataFrame, value: str, order_by, name: str = "cumulative", partitions: int | None = None
) -> DataFrame:
    """Add the sum of `value` over all rows up to and including this one."""
    rows = _ranged(df, order_by, partitions)
    totals = rows.groupBy("_range").agg(F.coalesce(F.sum(cell(value)), F.lit(0)).alias("_total"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("_range").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    return (
        rows.withColumn("_part", F.coalesce(F.sum(cell(value)).over(inside), F.lit(0)))
        .join(F.broadcast(starts), "_range")
        .select(*[cell(c) for c in df.columns], (F.col("_start") + F.col("_part")).alias(name))
    )
