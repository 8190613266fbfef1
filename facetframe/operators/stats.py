"""Correlation, outliers, histograms, shape and normality."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.functions.numbers import without_nan
from facetframe.operators.comoments import co_moments
from facetframe.operators.frames import (
    AGG_BUFFERS,
    cell,
    in_chunks,
    numeric_columns,
    order_columns,
    rows_of,
    stacked,
    with_one_row,
)
from facetframe.operators.profile import numeric_aggregates, numeric_values
from facetframe.operators.quantiles import exact_quantiles

# ---------------------------------------------------------------- correlation


def pearson(a, b) -> Column:
    """Correlation over the rows that hold both values; null if one never varies.

    `corr` itself divides by zero for a constant column, an error in ANSI mode.
    """
    return F.try_divide(F.regr_sxy(a, b), F.sqrt(F.regr_sxx(a, b)) * F.sqrt(F.regr_syy(a, b)))


def _pair_rows(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r); each pair over the rows that have both values, all pairs in one scan."""
    at = {c: i for i, c in enumerate(columns)}
    moments = co_moments(df, columns, [(at[a], at[b]) for a, b in pairs])
    wanted = df.sparkSession.createDataFrame([(a, b, at[a], at[b]) for a, b in pairs], "a string, b string, i int, j int")
    r = F.try_divide(F.col("s_ij"), F.sqrt("s_ii") * F.sqrt("s_jj"))
    # A value beyond all bounds has no correlation; rounding must not leave -1..1.
    r = F.when(r.isNotNull() & ~F.isnan(r), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    return wanted.join(moments, ["i", "j"], "left").select("a", "b", r.alias("r"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """(a, b, r): the full Pearson matrix in long form; undefined is 0."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("a correlation matrix needs two numeric columns")
    half = _pair_rows(df, columns, list(combinations_with_replacement(columns, 2)))
    # A pair is computed once and shown both ways.
    one_way = F.struct(F.col("a").alias("a"), F.col("b").alias("b"))
    other_way = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    ways = F.when(F.col("a") == F.col("b"), F.array(one_way)).otherwise(F.array(one_way, other_way))
    r = F.round(F.coalesce("r", F.lit(0.0)), digits)
    return half.select(F.inline(ways), r.alias("r"))


def strong_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    above: float = 0.7,
    strong: float = 0.85,
    limit: int | None = None,
) -> DataFrame:
    """(column_a, column_b, correlation, strength, direction), strongest first."""
    columns = list(columns or numeric_columns(df))
    r = F.col("r")
    found = (
        _pair_rows(df, columns, list(combinations(columns, 2)))
        .where(F.abs(r) > above)
        .select(
            F.col("a").alias("column_a"),
            F.col("b").alias("column_b"),
            F.round(r, 4).alias("correlation"),
            F.when(F.abs(r) > strong, "strong").otherwise("moderate").alias("strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        )
    )
    if limit:
        # The report keeps the first pairs in column order, not the strongest.
        places = F.array(*[F.lit(c) for c in columns])
        return found.orderBy(
            F.array_position(places, F.col("column_a")), F.array_position(places, F.col("column_b"))
        ).limit(limit)
    return found.orderBy(F.desc(F.abs("correlation")), "column_a", "column_b")


# ---------------------------------------------------------------- outliers


def fences(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float, float] | None]:
    """Quartiles of each column, None if it is empty.

    They are two numbers per column; as literals they let the filters that
    follow reach the scan.
    """
    safe = {f"q{i}": v for i, v in enumerate(values.values())}
    row = exact_quantiles(df, safe, [0.25, 0.75]).first()
    return {name: tuple(row[i]) if row[i] else None for i, name in enumerate(values)}


def _iqr_bounds(quartiles: tuple[float, float] | None) -> tuple[Column, Column]:
    if quartiles is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    q1, q3 = quartiles
    return F.lit(q1 - (q3 - q1) * 1.5), F.lit(q3 + (q3 - q1) * 1.5)


def outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "iqr",
    quartiles: dict[str, tuple[float, float] | None] | None = None,
) -> DataFrame:
    """(column, method, n, outlier_count, outlier_pct, lower, upper[, q1, q3, iqr]).

    `zscore` marks by the population deviation and reports bounds by the
    sample deviation. All columns share one pass once their bounds are known.
    Fewer than four values: none, and no bounds.
    """
    if method not in ("iqr", "zscore"):
        raise ValueError("method must be iqr or zscore")
    values = numeric_values(df, columns)
    names = list(values)
    numbers = df.select(*[without_nan(v).alias(f"v{i}") for i, v in enumerate(values.values())])
    n = [F.col(f"n{i}") for i in range(len(names))]
    counts = [F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))]
    if method == "iqr":
        quartiles = fences(df, values) if quartiles is None else quartiles
        bounds = [_iqr_bounds(quartiles[c]) for c in names]
        wide = numbers.agg(
            *counts,
            *[F.count_if((F.col(f"v{i}") < b[0]) | (F.col(f"v{i}") > b[1])).alias(f"o{i}") for i, b in enumerate(bounds)],
        )
    else:
        level = numbers.agg(
            *[F.avg(f"v{i}").alias(f"m{i}") for i in range(len(names))],
            *[F.stddev_pop(f"v{i}").alias(f"p{i}") for i in range(len(names))],
            *[F.stddev_samp(f"v{i}").alias(f"s{i}") for i in range(len(names))],
        )
        far = [F.try_divide(F.abs(F.col(f"v{i}") - F.col(f"m{i}")), F.col(f"p{i}")) > 3 for i in range(len(names))]
        wide = (
            with_one_row(numbers, level)
            .groupBy(*level.columns)
            .agg(*counts, *[F.count_if(f).alias(f"o{i}") for i, f in enumerate(far)])
        )
        bounds = [(F.col(f"m{i}") - F.col(f"s{i}") * 3, F.col(f"m{i}") + F.col(f"s{i}") * 3) for i in range(len(names))]
    at = {c: i for i, c in enumerate(names)}

    def enough(c: str, value: Column) -> Column:
        return F.when(n[at[c]] >= 4, value)

    def found(c: str) -> Column:
        return F.col(f"o{at[c]}")

    fields = {
        "method": lambda c: F.lit(method),
        "n": lambda c: n[at[c]],
        "outlier_count": lambda c: F.coalesce(enough(c, found(c)), F.lit(0).cast("long")),
        "outlier_pct": lambda c: F.coalesce(enough(c, F.round(found(c) * 100.0 / n[at[c]], 2)), F.lit(0.0)),
        "lower": lambda c: enough(c, F.round(bounds[at[c]][0], 4)),
        "upper": lambda c: enough(c, F.round(bounds[at[c]][1], 4)),
    }
    if method == "iqr":

        def quartile(c: str, pick) -> Column:
            known = quartiles[c]
            return enough(c, F.round(F.lit(float(pick(*known)) if known else None).cast("double"), 4))

        fields["q1"] = lambda c: quartile(c, lambda q1, q3: q1)
        fields["q3"] = lambda c: quartile(c, lambda q1, q3: q3)
        fields["iqr"] = lambda c: quartile(c, lambda q1, q3: q3 - q1)
    return rows_of(wide, names, fields)


def total_outliers(found: DataFrame) -> DataFrame:
    return found.agg(F.sum("outlier_count").alias("total_outliers"), F.count("*").alias("column_count"))


def outlier_rows(df: DataFrame, column: str, order_by, limit: int | None = 100) -> DataFrame:
    """The rows outside the fences, first `limit` by the order key (None: all)."""
    value = numeric_values(df, [column])[column]
    low, high = _iqr_bounds(fences(df, {column: value})[column])
    marked = df.where(((value < low) | (value > high)) & ~F.isnan(value))
    return marked.orderBy(*order_columns(order_by)).limit(limit) if limit else marked


def anomalies(df: DataFrame, columns: Sequence[str], order_by, samples: int = 5, digits: int = 2) -> DataFrame:
    """(column, count, percentage, lower, upper, sample_values) of up to five columns.

    Columns with ten values or fewer, or without outliers, give no row.
    """
    chosen = list(columns)[:5]
    values = numeric_values(df, chosen)
    quartiles = fences(df, values)
    found = outliers(df, chosen, quartiles=quartiles).where((F.col("n") > 10) & (F.col("outlier_count") > 0))
    parts = []
    for name, value in values.items():
        low, high = _iqr_bounds(quartiles[name])
        parts.append(
            df.where(((value < low) | (value > high)) & ~F.isnan(value))
            .select(F.struct(*order_columns(order_by)).alias("_at"), value.alias("v"))
            .orderBy("_at", "v")
            .limit(samples)
            .select(F.lit(name).alias("column"), "_at", F.round("v", digits).alias("v"))
        )
    listed = (
        stacked(parts)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "v"))).alias("seen"))
        .select("column", F.col("seen.v").alias("sample_values"))
    )
    return found.join(F.broadcast(listed), "column", "left").select(
        "column",
        F.col("outlier_count").alias("count"),
        F.col("outlier_pct").alias("percentage"),
        F.round("lower", digits).alias("lower"),
        F.round("upper", digits).alias("upper"),
        "sample_values",
    )


# ---------------------------------------------------------------- histogram


LEAST_VALUES = 4


def histogram(df: DataFrame, column: str, bins: int | None = None, digits: int = 4) -> DataFrame:
    """(bin, bin_start, bin_end, count): equal widths, the last bin closed, empty bins kept.

    Without `bins` their number is n // 10, at least 5 and at most 20. Under four
    values there is no histogram. A constant column spreads over half a unit to each side.
    """
    value = numeric_values(df, [column])[column]
    numbers = df.select(without_nan(value).alias("v")).where(F.col("v").isNotNull())
    n_bins = F.lit(bins) if bins else F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.col("n") / 10)))
    flat = F.col("min") == F.col("max")
    bounds = (
        numbers.agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
        .where(F.col("n") >= LEAST_VALUES)
        .select(
            F.when(flat, F.col("min") - 0.5).otherwise(F.col("min")).alias("lo"),
            F.when(flat, F.col("max") + 0.5).otherwise(F.col("max")).alias("hi"),
            n_bins.cast("int").alias("bins"),
        )
    )
    width = (F.col("hi") - F.col("lo")) / F.col("bins")

    def left_edge(b: Column) -> Column:
        return F.when(b >= F.col("bins"), F.col("hi")).otherwise(b * width + F.col("lo"))

    guess = F.least(
        F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("int"),
        F.col("bins") - 1,
    )
    # A value on an edge goes by the edge itself, not by the rounded quotient.
    settled = (
        F.when(F.col("v") < left_edge(F.col("g")), F.col("g") - 1)
        .when((F.col("v") >= left_edge(F.col("g") + 1)) & (F.col("g") < F.col("bins") - 1), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counted = (
        with_one_row(numbers, bounds)
        .withColumn("g", guess)
        .groupBy(settled.alias("bin"))
        .agg(F.count("*").alias("count"))
    )
    grid = bounds.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return grid.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        F.round(left_edge(F.col("bin")), digits).alias("bin_start"),
        F.round(left_edge(F.col("bin") + 1), digits).alias("bin_end"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


# ---------------------------------------------------------------- shape


def corrected_skewness(n: Column, g1: Column) -> Column:
    return F.when(n >= 8, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n >= 8, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


def shape(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """(column, n, skewness, kurtosis), bias-corrected; null below eight values."""
    n = F.col("n")
    return numeric_aggregates(df, numeric_values(df, columns), ("n", "g1", "g2")).select(
        "column",
        "n",
        F.round(corrected_skewness(n, F.col("g1")), digits).alias("skewness"),
        F.round(corrected_kurtosis(n, F.col("g2")), digits).alias("kurtosis"),
    )


def skew_label(skewness: Column, above: float = 0.5) -> Column:
    return (
        F.when(skewness > above, "right-skewed")
        .when(skewness < -above, "left-skewed")
        .when(skewness.isNotNull(), "symmetric")
    )


def skew_labels(df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.5) -> DataFrame:
    raw = corrected_skewness(F.col("n"), F.col("g1"))
    return numeric_aggregates(df, numeric_values(df, columns), ("n", "g1")).select(
        "column", F.round(raw, 4).alias("skewness"), skew_label(raw, above).alias("label")
    )


def moments(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """(column, mean, variance, std) of the population."""
    return numeric_aggregates(df, numeric_values(df, columns), ("mean", "pop_std")).select(
        "column",
        F.round("mean", digits).alias("mean"),
        F.round(F.col("pop_std") * F.col("pop_std"), digits).alias("variance"),
        F.round("pop_std", digits).alias("std"),
    )
