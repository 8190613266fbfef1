"""Exact quantiles (linear interpolation) of all columns in two or three scans.

The first scan gives count, bounds and, by one mergeable summary per column, a
bracket around each rank; the last one counts the distinct values inside the
brackets, and the rows between them, so that the value at each rank is read off a
running count that is exact. Of a column so large that its brackets would hold too
many values, one scan in between counts what lies below each bracket and cuts it into
a fine grid. The number of scans does not depend on the number of columns or ranks. A
rank that is not in its bracket after all (summaries promise ranks only nearly) is
looked for in the whole column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.operators.frames import cell

BRACKET_VALUES = 20_000
ACCURACY = 10_000
#: Parts that the scan in between cuts a bracket into, and how often it is repeated at most.
GRID = 256
MOST_GRIDS = 6


@dataclass
class Wanted:
    """One column: its size, bounds, ranks, and a span (low, high, about how many rows) per probability."""

    n: int
    low: float
    high: float
    distinct: int
    spans: list[tuple[float, float, float]] = field(default_factory=list)

    def ranks(self, probabilities: Sequence[float]) -> list[tuple[int, int, float]]:
        out = []
        for p in probabilities:
            place = p * (self.n - 1)
            out.append((math.floor(place), math.ceil(place), place - math.floor(place)))
        return out

    def whole(self) -> tuple[float, float, float]:
        return self.low, self.high, 0.0


def number_cells(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> tuple[DataFrame, list[str]]:
    """(c, value) rows of all numbers, c being the position of the column, and the columns' names."""
    chosen = dict(columns) if isinstance(columns, Mapping) else {name: cell(name) for name in columns}
    cells = F.array(*[F.struct(F.lit(i).alias("c"), v.cast("double").alias("value")) for i, v in enumerate(chosen.values())])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value")), list(chosen)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str] | Mapping[str, Column],
    probabilities: Sequence[float],
    bracket_values: int = BRACKET_VALUES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row, with one array column per input column (null if it is empty)."""
    cells, names = number_cells(df, columns)
    found, _ = quantiles_of(cells, len(names), probabilities, bracket_values, accuracy)
    return df.sparkSession.range(1).select(
        *[
            (F.array(*[F.lit(v) for v in found[i]]) if i in found else F.lit(None).cast("array<double>")).alias(n)
            for i, n in enumerate(names)
        ]
    )


def quantiles_of(
    cells: DataFrame,
    size: int,
    probabilities: Sequence[float],
    bracket_values: int = BRACKET_VALUES,
    accuracy: int = ACCURACY,
    measures: Mapping[str, Column] | None = None,
) -> tuple[dict[int, list[float]], dict[int, dict[str, object]]]:
    """Position of each column that holds a number -> its quantiles, and -> its measures.

    `cells` has rows (c, value). The measures are aggregates of `value`, taken along
    in the first scan.
    """
    if not size:
        return {}, {}
    slack = 2.0 / accuracy
    guesses = [g for p in probabilities for g in (max(0.0, p - slack), min(1.0, p + slack))]
    first = cells.groupBy("c").agg(
        F.count("*").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.approx_count_distinct("value").alias("distinct"),
        F.percentile_approx("value", guesses or [0.5], accuracy).alias("guesses"),
        *[made.alias(f"m_{name}") for name, made in (measures or {}).items()],
    )
    # One row per column.
    wanted: dict[int, Wanted] = {}
    measured: dict[int, dict[str, object]] = {}
    for r in first.collect():
        measured[r["c"]] = {name: r[f"m_{name}"] for name in measures or {}}
        w = wanted[r["c"]] = Wanted(r["n"], r["low"], r["high"], r["distinct"])
        if min(w.n, w.distinct) <= bracket_values:
            w.spans = [w.whole()] * len(probabilities)
        else:
            g = r["guesses"]
            w.spans = [(g[2 * j], g[2 * j + 1], 2 * slack * w.n) for j in range(len(probabilities))]
    for _ in range(MOST_GRIDS):
        wide = {c for c, w in wanted.items() if any(s[2] > bracket_values and s[0] < s[1] for s in w.spans)}
        if not wide or not _narrow(cells, {c: wanted[c] for c in wide}, probabilities, accuracy):
            break
    out = _read(cells, wanted, probabilities)
    missed = {c: w for c, w in wanted.items() if c not in out}
    if missed:
        for w in missed.values():
            w.spans = [w.whole()] * len(probabilities)
        out |= _read(cells, missed, probabilities)
    return out, measured


def _beside(cells: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Each cell with its column's bounds: one small row per column, broadcast."""
    schema = ", ".join(f"{n} {'int' if n == 'c' else 'double'}" for n in names)
    return cells.join(F.broadcast(cells.sparkSession.createDataFrame(rows, schema)), "c")


def _narrow(cells: DataFrame, wanted: dict[int, Wanted], probabilities: Sequence[float], accuracy: int) -> bool:
    """Shrink the brackets of some columns in one scan; whether any got smaller."""
    k = len(probabilities)
    names = ["c", *[f"{side}{j}" for j in range(k) for side in ("lo", "hi")]]
    rows = [(c, *[float(x) for s in w.spans for x in s[:2]]) for c, w in wanted.items()]
    steps = [i / GRID for i in range(GRID + 1)]
    inside = [F.col("value").between(F.col(f"lo{j}"), F.col(f"hi{j}")) for j in range(k)]
    found = _beside(cells, rows, names).groupBy("c").agg(
        *[F.count_if(F.col("value") < F.col(f"lo{j}")).alias(f"below{j}") for j in range(k)],
        *[F.count_if(inside[j]).alias(f"in{j}") for j in range(k)],
        *[F.percentile_approx(F.when(inside[j], F.col("value")), steps, accuracy).alias(f"grid{j}") for j in range(k)],
    )
    moved = False
    for r in found.collect():
        w = wanted[r["c"]]
        for j, (low_rank, high_rank, _) in enumerate(w.ranks(probabilities)):
            below, n, grid = r[f"below{j}"], r[f"in{j}"], r[f"grid{j}"]
            if not below <= low_rank <= high_rank < below + n:
                w.spans[j] = w.whole()
                continue
            slack = 2.0 / accuracy + 1.0 / n
            at = math.floor(((low_rank - below) / n - slack) * GRID)
            to = math.ceil(((high_rank - below + 1) / n + slack) * GRID)
            low = grid[at] if at > 0 else w.spans[j][0]
            high = grid[to] if to < GRID else w.spans[j][1]
            about = n * (min(to, GRID) - max(at, 0)) / GRID
            moved |= low > w.spans[j][0] or high < w.spans[j][1]
            w.spans[j] = (low, high, about)
    return moved


def _apart(spans: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """The spans in order, overlapping ones joined."""
    out: list[tuple[float, float]] = []
    for low, high, _ in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _read(cells: DataFrame, wanted: dict[int, Wanted], probabilities: Sequence[float]) -> dict[int, list[float]]:
    """Values at the ranks, in one scan; columns with a rank outside its bracket are left out."""
    if not wanted:
        return {}
    spans = {c: _apart(w.spans) for c, w in wanted.items()}
    most = max(map(len, spans.values()))
    nothing = (float("nan"), float("nan"))
    rows = [(c, *[float(x) for s in [*ss, *[nothing] * (most - len(ss))] for x in s]) for c, ss in spans.items()]
    names = ["c", *[f"{side}{j}" for j in range(most) for side in ("lo", "hi")]]
    # Every cell falls below, into or between spans: 2j is below the j-th, 2j + 1 in it. NaN is above all numbers.
    part, value = F.lit(2 * most), F.lit(None).cast("double")
    for j in reversed(range(most)):
        low, high = F.col(f"lo{j}"), F.col(f"hi{j}")
        part = F.when(F.col("value") < low, 2 * j).when(F.col("value") <= high, 2 * j + 1).otherwise(part)
        value = F.when((F.col("value") >= low) & (F.col("value") <= high), F.col("value")).otherwise(value)
    counted = (
        _beside(cells, rows, names)
        .select("c", part.alias("part"), value.alias("value"))
        .groupBy("c", "part", "value")
        .agg(F.count("*").alias("n"))
    )
    upto = F.sum("n").over(W.partitionBy("c").orderBy("part", "value").rowsBetween(W.unboundedPreceding, 0))
    ranks = [(c, k) for c, w in wanted.items() for low, high, _ in w.ranks(probabilities) for k in {low, high}]
    asked = cells.sparkSession.createDataFrame(sorted(set(ranks)), "c int, rank long")
    hits = (
        counted.withColumn("upto", upto)
        .join(F.broadcast(asked), "c")
        .where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")) & F.col("value").isNotNull())
        .select("c", "rank", "value")
    )
    values = {(r["c"], r["rank"]): r["value"] for r in hits.collect()}
    out = {}
    for c, w in wanted.items():
        places = w.ranks(probabilities)
        if all((c, k) in values for low, high, _ in places for k in (low, high)):
            out[c] = [_between(values[c, low], values[c, high], share) for low, high, share in places]
    return out


def _between(low: float, high: float, share: float) -> float:
    # Not low + (high - low) * 0, which has no value between infinities.
    return low if share == 0 or low == high else low + (high - low) * share
