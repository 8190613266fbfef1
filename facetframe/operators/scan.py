"""Running folds over long ordered groups: sums, extremes and last values so far.

All groups form one line sorted by group and order. The line is cut into ranges of
about equal size (range partitions, materialised reliably), so a group that holds a
third of all rows is spread over its ranges. Each range folds its own rows; of every
group that goes on from an earlier range, the folds of the earlier ranges are carried
over. At most one group per range goes on, so what is carried has a row per range at
most, whatever the number of groups and rows.

As-of joins and sliding frames are made of these folds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.operators.frames import cell
from facetframe.session import checkpointed

_LOW_BITS = 33
_FOLDS = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _merged(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried + local, local, carried)
    if kind == "min":
        return F.least(carried, local)
    if kind == "max":
        return F.greatest(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    folds: Mapping[str, tuple[str, str]],
    strictly_before: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Add a column per fold: name -> (`sum`, `min`, `max` or `last`, column).

    A fold covers the rows of its group up to and including the row, or only those
    before it. Nulls take no part; `last` is the last value that is not null. Rows
    equal in the whole order are taken in an order of reading, so give an order that
    tells apart what matters. A null group is a group; an empty frame stays empty.
    """
    group = list(group)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*map(cell, group), *order, F.col("_tie")]
    line = tied.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    placed = checkpointed(line.withColumn("_id", F.monotonically_increasing_id())).withColumn(
        "_range", F.shiftright("_id", _LOW_BITS)
    )
    inside = W.partitionBy("_range", *map(cell, group)).orderBy("_id").rowsBetween(
        W.unboundedPreceding, -1 if strictly_before else 0
    )
    local = placed
    for i, (kind, column) in enumerate(folds.values()):
        local = local.withColumn(f"_f{i}", _FOLDS[kind](cell(column)).over(inside))

    # One row per range and group, in the order of the line for `last`.
    def whole(kind: str, column: str) -> Column:
        return F.max_by(cell(column), F.when(cell(column).isNotNull(), F.col("_id"))) if kind == "last" else _FOLDS[kind](cell(column))

    spans = placed.groupBy("_range", *map(cell, group)).agg(
        *[whole(kind, column).alias(f"_w{i}") for i, (kind, column) in enumerate(folds.values())]
    )
    by_group = W.partitionBy(*map(cell, group)).orderBy("_range")
    earlier = by_group.rowsBetween(W.unboundedPreceding, -1)
    goes_on = spans.select(
        F.col("_range").alias("_r"),
        *[cell(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.lag("_range").over(by_group).alias("_before"),
        *[_FOLDS[kind](F.col(f"_w{i}")).over(earlier).alias(f"_c{i}") for i, (kind, _) in enumerate(folds.values())],
    ).where("_before IS NOT NULL")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & cell(g).eqNullSafe(F.col(f"_g{i}"))
    # At most one row per range.
    joined = local.join(F.broadcast(goes_on), same, "left")
    return joined.select(
        *[cell(c) for c in df.columns if c not in folds],
        *[_merged(kind, F.col(f"_c{i}"), F.col(f"_f{i}")).alias(name) for i, (name, (kind, _)) in enumerate(folds.items())],
    )
