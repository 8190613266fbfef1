"""Grouping sets, rollup and cube from a lattice of partials.

Rows are read and combined once, into the finest groups. Every coarser set is
combined from the smallest finer set already made, not from the rows, so nothing is
expanded: a cube of many dimensions over a huge table costs one pass over it and
passes over partials. Distinct counts are exact and merge the same way: a value has a
number (itself, or its place in the sorted list of values), a group a bitmap per
bucket of 32,768 numbers, and bitmaps of finer groups are merged by or.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from facetframe.operators.frames import cell, stacked
from facetframe.operators.ordering import numbered
from facetframe.session import checkpointed

#: kind -> (partial of the rows, partial of partials)
_MERGES = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def cube_sets(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    return [s for k in range(len(dimensions), -1, -1) for s in combinations(dimensions, k)]


def rollup_sets(dimensions: Sequence[str]) -> list[tuple[str, ...]]:
    return [tuple(dimensions[:k]) for k in range(len(dimensions), -1, -1)]


def _numbers(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """Rows with a whole number per distinct value: the value itself, or its rank among all values."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df, cell(column).cast("long")
    values = numbered(df.where(cell(column).isNotNull()).select(cell(column).alias("_value")).distinct(), "_value", "_number")
    return df.join(values, cell(column) == F.col("_value"), "left").drop("_value"), F.col("_number")


def grouping_sets(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    measures: Mapping[str, tuple[str, str]],
    distinct: Mapping[str, str] | None = None,
) -> DataFrame:
    """(dimensions..., grouping_id, measures..., distinct counts...), a row per group of each set.

    `measures` maps a name to (`sum`, `count`, `min` or `max`, column); `*` may be
    counted. `distinct` maps a name to a column whose values, nulls left out, are
    counted once per group. A dimension outside a set is null; `grouping_id` has a bit
    per dimension in order, the first highest, set where it is outside, so a null of
    the data stays apart. Repeated sets come once. The empty set is one row, also for
    an empty table; other sets then have none.
    """
    sets = [tuple(s) for s in dict.fromkeys(frozenset(s) for s in sets)]
    dimensions = sorted({d for s in sets for d in s}, key=lambda d: df.columns.index(d))
    sets = sorted((tuple(d for d in dimensions if d in s) for s in sets), key=lambda s: (-len(s), s))
    if not sets:
        raise ValueError("there is no grouping set")
    value = lambda column: F.lit(1) if column == "*" else cell(column)
    dim = {d: f"_d{i}" for i, d in enumerate(dimensions)}
    rows = df.select(*[cell(d).alias(dim[d]) for d in dimensions], *[value(c).alias(f"_m{i}") for i, (_, c) in enumerate(measures.values())])
    finest = rows.groupBy(*dim.values()).agg(*[_MERGES[kind][0](f"_m{i}").alias(f"_m{i}") for i, (kind, _) in enumerate(measures.values())])
    merge = [_MERGES[kind][1](f"_m{i}").alias(f"_m{i}") for i, (kind, _) in enumerate(measures.values())]
    groups = _coarser(finest, sets, dimensions, dim, [], merge)
    for number, (name, column) in enumerate((distinct or {}).items()):
        numbered_rows, code = _numbers(df, column)
        bits = (
            numbered_rows.select(*[cell(d).alias(dim[d]) for d in dimensions], code.alias("_n"))
            .where("_n IS NOT NULL")
            .groupBy(*dim.values(), F.bitmap_bucket_number("_n").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("_bits"))
        )
        counted = _coarser(bits, sets, dimensions, dim, ["_bucket"], [F.bitmap_or_agg("_bits").alias("_bits")])
        for s, found in counted.items():
            n = found.groupBy(*[dim[d] for d in s]).agg(F.sum(F.bitmap_count("_bits")).alias(f"_n{number}"))
            same = F.lit(True)
            for d in s:
                same = same & groups[s][dim[d]].eqNullSafe(n[dim[d]])
            joined = groups[s].join(n, same, "left") if s else groups[s].crossJoin(F.broadcast(n))
            groups[s] = joined.select(groups[s]["*"], n[f"_n{number}"])
    out = []
    for s, found in groups.items():
        outside = sum(1 << (len(dimensions) - 1 - i) for i, d in enumerate(dimensions) if d not in s)
        out.append(
            found.select(
                *[(F.col(dim[d]) if d in s else F.lit(None).cast(df.schema[d].dataType)).alias(d) for d in dimensions],
                F.lit(outside).alias("grouping_id"),
                *[
                    (F.coalesce(f"_m{i}", F.lit(0)) if kind == "count" else F.col(f"_m{i}")).alias(name)
                    for i, (name, (kind, _)) in enumerate(measures.items())
                ],
                *[F.coalesce(f"_n{i}", F.lit(0)).alias(name) for i, name in enumerate(distinct or {})],
            )
        )
    return stacked(out)


def _coarser(finest: DataFrame, sets, dimensions, dim, extra, merge) -> dict[tuple[str, ...], DataFrame]:
    """The partials of every set, each combined from the set with the fewest rows that holds it.

    A set's rows are counted once it is materialised, so the choice rests on sizes
    and not on guesses; a set that no other needs is not materialised.
    """
    made: dict[tuple[str, ...], tuple[DataFrame, int]] = {}
    base = checkpointed(finest)
    made[tuple(dimensions)] = (base, base.count())
    out = {}
    for s in sets:
        if s in made:
            out[s] = made[s][0]
            continue
        source = min((m for m in made if set(s) <= set(m)), key=lambda m: made[m][1])
        found = made[source][0].groupBy(*[dim[d] for d in s], *extra).agg(*merge)
        if any(set(t) < set(s) for t in sets):
            found = checkpointed(found)
            made[s] = (found, found.count())
        out[s] = found
    return out
