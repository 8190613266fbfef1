"""As-of joins and sliding frames along time, over running folds.

Both work on time lines per key whose hot keys are spread over many tasks (see
`scan`). No range join and no window gathers a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from facetframe.operators.frames import cell, stacked
from facetframe.operators.scan import running


def _micros(df: DataFrame, name: str) -> Column:
    """Time as a whole number: microseconds of a timestamp, else the number itself."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(cell(name).cast("timestamp"))
    return cell(name).cast("long")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_time: str,
    right_time: str,
    take: Sequence[str],
    prefix: str = "",
    forward: bool = False,
    exact: bool = True,
    within: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Every left row with columns of the last right row of its key at or before its time.

    `on` pairs a left key with a right key. `forward` takes the first right row at or
    after the time instead; without `exact` rows of the very time do not count.
    `within` is the largest distance, in microseconds for timestamps. Of right rows
    equal in key and time the greatest by the taken columns counts (they must be
    sortable). A left row without a match, with a null key or a null time has nulls;
    right rows with nulls in key or time match nothing. Repeated left rows stay.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    direction = -1 if forward else 1
    taken = F.struct(_micros(right, right_time).alias("_at"), *[cell(c).alias(c) for c in take])
    # Right rows of one key and time are one row, combined before the shuffle.
    known = (
        right.select(*[cell(r).alias(k) for k, (_, r) in zip(keys, on)], (direction * _micros(right, right_time)).alias("_t"), taken.alias("_taken"))
        .dropna(subset=[*keys, "_t"])
        .groupBy(*keys, "_t")
        .agg(F.max("_taken").alias("_taken"))
        .select(*keys, "_t", F.lit(0 if exact else 2).alias("_side"), "_taken", F.lit(None).cast(_row_type(left)).alias("_row"))
    )
    asked = left.select(
        *[cell(a).alias(k) for k, (a, _) in zip(keys, on)],
        (direction * _micros(left, left_time)).alias("_t"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(known.schema["_taken"].dataType).alias("_taken"),
        F.struct(*[cell(c).alias(c) for c in left.columns]).alias("_row"),
    )
    lacking = F.col("_t").isNull()
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    line = known.unionByName(asked.where(~lacking))
    matched = running(line, keys, [F.col("_t"), F.col("_side")], {"_taken": ("last", "_taken")}, partitions=partitions)
    rows = matched.where("_side = 1").select("_row", "_t", "_taken").unionByName(asked.where(lacking).select("_row", "_t", "_taken"))
    near = F.lit(True) if within is None else F.abs(F.col("_t") - direction * F.col("_taken._at")) <= within
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in left.columns],
        *[F.when(near, F.col("_taken")[c]).alias(f"{prefix}{c}") for c in take],
    )


def _row_type(df: DataFrame) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    span: int,
    distinct: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """(keys..., time, n, total, least, most[, n_distinct]) over the last `span` up to each time.

    One row per key and time that occurs; the frame holds all rows of the key from
    time - span to time, both included. `span` is in microseconds for timestamps.
    `n` counts rows, `total`, `least` and `most` read the values that are not null,
    `n_distinct` counts the values of another column. Rows with a null time are left
    out; a null key is a key.

    Time is cut into cells one frame wide. A frame is the start of its own cell up to
    the time, and the end of the cell before from time - span on: two running folds,
    one forwards, one backwards with the frames' starts put among the rows. Nothing
    is subtracted, so sums do not lose digits. Distinct values are counted by what
    changes: a value counts from where it occurs until a span after its last
    occurrence.
    """
    keys = list(keys)
    width = span + 1
    made = df.where(cell(time).isNotNull()).select(
        *[cell(k).alias(k) for k in keys],
        _micros(df, time).alias("_t"),
        cell(value).alias("_v"),
        (cell(distinct) if distinct else F.lit(None)).alias("_x"),
    )
    points = (
        made.groupBy(*keys, "_t")
        .agg(F.count("*").alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        .withColumn("_cell", F.col("_t") - F.pmod(F.col("_t"), F.lit(width)))
    )
    folds = {"n": ("sum", "n"), "total": ("sum", "total"), "least": ("min", "least"), "most": ("max", "most")}
    cells = [*keys, "_cell"]
    own = running(points, cells, [F.col("_t")], folds, partitions=partitions).select(*keys, "_t", *folds)
    # A frame's start, in the cell before: rows of the very start come before it in the way back.
    starts = points.select(
        *keys,
        (F.col("_t") - span).alias("_t"),
        *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in folds],
        (F.col("_cell") - width).alias("_cell"),
        F.lit(1).alias("_start"),
    ).where(F.col("_t") < F.col("_cell") + width)
    back = running(
        points.withColumn("_start", F.lit(0)).unionByName(starts),
        cells,
        [F.col("_t").desc(), F.col("_start")],
        folds,
        partitions=partitions,
    )
    before = back.where("_start = 1").select(*keys, (F.col("_t") + span).alias("_t"), *folds)
    parts = [own.withColumn("_d", F.lit(None).cast("long")), before.withColumn("_d", F.lit(None).cast("long"))]
    if distinct:
        counted = _distinct_so_far(made, keys, span, partitions)
        parts.append(
            counted.select(*keys, "_t", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in folds], "_d")
        )
    whole = stacked(parts).groupBy(*keys, "_t").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("_d").alias("_d")
    )
    kind = df.schema[time].dataType
    at = F.timestamp_micros("_t").cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col("_t").cast(kind)
    out = whole.select(*keys, at.alias(time), "n", "total", "least", "most", F.coalesce("_d", F.lit(0)).alias("n_distinct"))
    return out if distinct else out.drop("n_distinct")


def _distinct_so_far(made: DataFrame, keys: list[str], span: int, partitions: int | None) -> DataFrame:
    """(keys..., _t, _d): distinct values in the frame that ends at each time.

    An occurrence adds one if the value's last one is out of the frame (or there is
    none); the last one then has gone a span after it, and so has the very last.
    """
    seen = made.where("_x IS NOT NULL").select(*keys, "_x", "_t").distinct()
    known = running(
        seen.withColumn("_p", F.col("_t")), [*keys, "_x"], [F.col("_t")], {"_p": ("last", "_p")}, strictly_before=True, partitions=partitions
    )
    fresh = known.where(F.col("_p").isNull() | (F.col("_t") - F.col("_p") > span))
    change = lambda rows, t, by: rows.select(*keys, t.alias("_t"), F.lit(by).cast("long").alias("_by"))
    last = seen.groupBy(*keys, "_x").agg(F.max("_t").alias("_t"))
    times = change(made.select(*keys, "_t").distinct(), F.col("_t"), 0).withColumn("_is", F.lit(1))
    changes = stacked(
        [
            change(fresh, F.col("_t"), 1),
            change(fresh.where("_p IS NOT NULL"), F.col("_p") + span + 1, -1),
            change(last, F.col("_t") + span + 1, -1),
        ]
    ).withColumn("_is", F.lit(0))
    line = changes.unionByName(times).groupBy(*keys, "_t").agg(F.sum("_by").alias("_by"), F.max("_is").alias("_is"))
    total = running(line, keys, [F.col("_t")], {"_by": ("sum", "_by")}, partitions=partitions)
    return total.where("_is = 1").select(*keys, "_t", F.col("_by").alias("_d"))
