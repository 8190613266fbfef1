"""Joins of spans with points and of spans with spans, over cells of fitting width.

A span has a level of its own: the least power of four at least as long as it is the
width of the level's cells, so a span lies in two of them at most. Each row goes to
the cells of its own level and of those coarser levels that the other side has. Two
rows can only overlap in a cell of the coarser of their two levels; the first cell
that both lie in gives the pair, so it comes once. Long spans thus take a coarse cell
or two instead of many fine ones, and cells are about as narrow as the spans in them,
so pairs that meet in a cell without touching stay in proportion to those that do.
The cells join by equality with the keys; skewed cells are split by adaptive
execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.operators.frames import cell
from facetframe.operators.timeline import _micros

#: Bits by which cells widen from level to level, and levels that 64-bit times can have.
STEP_BITS = 2
MOST_LEVELS = 32


def _level(start: Column, end: Column) -> Column:
    """Least level whose cells are at least as long as the span (inclusive bounds)."""
    return F.when(end <= start, 0).otherwise(F.ceil(F.length(F.bin(end - start)) / STEP_BITS)).cast("int")


def _at(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level * STEP_BITS)


def _levels(rows: DataFrame) -> list[int]:
    """The levels a side has: at most MOST_LEVELS numbers."""
    return [r[0] for r in rows.select("_level").distinct().collect()]


def _side(df: DataFrame, keys: Sequence[str], start: str, end: str, name: str) -> DataFrame:
    from_, to = _micros(df, start), _micros(df, end)
    rows = df.select(
        *[cell(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*[cell(c).alias(c) for c in df.columns]).alias(name),
        from_.alias("_from"),
        to.alias("_to"),
    ).where("_from <= _to")
    return rows.withColumn("_level", _level(F.col("_from"), F.col("_to")))


def _in_cells(rows: DataFrame, others: Sequence[int], n_keys: int, name: str) -> DataFrame:
    """A row per level that the row can meet another at, and per cell of that level (two at most)."""
    coarser = F.filter(F.array(*[F.lit(v) for v in sorted(others)]).cast("array<int>"), lambda v: v > F.col("_level"))
    leveled = rows.select("*", F.explode(F.concat(F.array("_level"), coarser)).alias("_at"))
    first, last = _at(F.col("_from"), F.col("_at")), _at(F.col("_to"), F.col("_at"))
    return leveled.select(
        *[f"_k{i}" for i in range(n_keys)],
        "_at",
        F.explode(F.array_distinct(F.array(first, last))).alias("_cell"),
        F.col("_level").alias(f"_level_{name}"),
        first.alias(f"_first_{name}"),
        F.col("_from").alias(f"_from_{name}"),
        F.col("_to").alias(f"_to_{name}"),
        name,
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[str, str]],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    columns: dict[str, Column | str] | None = None,
) -> DataFrame:
    """Pairs of a left and a right row of equal keys whose spans share a moment, each once.

    Spans are (start column, end column), bounds included; a point is a span with one
    column given twice. Rows with a null key or bound, or an end before the start,
    match nothing; repeated rows pair each time. The result has two structs, `l` and
    `r`, or the named expressions over them.
    """
    n = len(on)
    a, b = _side(left, [x for x, _ in on], *left_span, "l"), _side(right, [y for _, y in on], *right_span, "r")
    # A pair meets at the coarser of its levels: the row's own or a coarser one of the other side.
    p, q = _in_cells(a, _levels(b), n, "l"), _in_cells(b, _levels(a), n, "r")
    joined = p.join(q, [*[f"_k{i}" for i in range(n)], "_at", "_cell"])
    met = joined.where(
        (F.col("_at") == F.greatest("_level_l", "_level_r"))
        & (F.col("_cell") == F.greatest("_first_l", "_first_r"))
        & (F.col("_from_l") <= F.col("_to_r"))
        & (F.col("_from_r") <= F.col("_to_l"))
    )
    if columns is None:
        return met.select("l", "r")
    return met.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def points_in_spans(
    spans: DataFrame,
    points: DataFrame,
    on: Sequence[tuple[str, str]],
    span: tuple[str, str],
    at: str,
    columns: dict[str, Column | str] | None = None,
) -> DataFrame:
    """Pairs of a span (`l`) and a point (`r`) inside it, bounds included."""
    return overlap_join(spans, points, on, span, (at, at), columns)
