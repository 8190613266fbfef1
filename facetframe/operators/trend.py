"""Trends, fits, forecasts and yearly patterns.

The tables are aggregated to one row per month or year first; windows run over
those few rows only. Points per number are ranked by ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.functions.text import capitalised
from facetframe.operators.aggregate import count_per_value, count_per_year, mean_per_month, mean_per_number
from facetframe.operators.frames import cell, kind_of, stacked, with_one_row
from facetframe.operators.ordering import numbered


def fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, slope, intercept, r_squared) of the least-squares line.

    Slope and intercept are null if x never varies; r_squared is 0 if y never
    does, and lies in 0..1.
    """
    px, py = cell(x).cast("double"), cell(y).cast("double")
    raw = F.regr_r2(py, px)
    return points.where(px.isNotNull() & py.isNotNull()).agg(
        F.count("*").alias("n"),
        F.when(F.var_pop(px) > 0, F.regr_slope(py, px)).alias("slope"),
        F.when(F.var_pop(px) > 0, F.regr_intercept(py, px)).alias("intercept"),
        F.when(F.var_pop(px) > 0, F.when(F.var_pop(py) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))).otherwise(0.0)).alias(
            "r_squared"
        ),
    )


def monthly_points(df: DataFrame, value: str, time: str) -> DataFrame:
    """(x, period, value): means per month (or per number), x = 0, 1, 2, ..."""
    if kind_of(df.schema[time].dataType) == "numeric":
        # As many rows as distinct numbers, which may be the table's: no window in one task.
        series = numbered(mean_per_number(df, time, value).select("period", "value"), F.col("period").cast("double"), "x")
    else:
        series = mean_per_month(df, time, value, limit=None, digits=None)
        series = series.withColumn("x", F.row_number().over(W.orderBy("period")))
    return series.select((F.col("x") - 1).alias("x"), "period", "value")


def _direction(slope: Column, r2: Column, deviation: Column, n: Column) -> Column:
    return (
        F.when(n < 3, "insufficient_data")
        .when(F.abs(slope) < deviation * 0.01, "stable")
        .when(r2 < 0.3, "fluctuating")
        .when(slope > 0, "increasing")
        .otherwise("decreasing")
    )


def trend(df: DataFrame, value: str, time: str) -> DataFrame:
    """One row (column, temporal_column, periods, direction, slope, r_squared)."""
    line = monthly_points(df, value, time).agg(
        F.count("*").alias("n"),
        F.regr_slope("value", "x").alias("slope"),
        F.coalesce(F.regr_r2("value", "x"), F.lit(0.0)).alias("r2"),
        F.stddev_pop("value").alias("deviation"),
    )
    few = F.col("n") < 3
    return line.select(
        F.lit(value).alias("column"),
        F.lit(time).alias("temporal_column"),
        F.col("n").alias("periods"),
        _direction(F.col("slope"), F.col("r2"), F.col("deviation"), F.col("n")).alias("direction"),
        F.when(few, 0.0).otherwise(F.round("slope", 6)).alias("slope"),
        F.when(~few, F.round("r2", 4)).alias("r_squared"),
    )


def report_trends(df: DataFrame, values: Sequence[str], time: str) -> DataFrame:
    """(column, temporal_column, direction, slope, r_squared) of up to two metrics, by sign alone."""
    parts = []
    for value in list(values)[:2]:
        line = monthly_points(df, value, time).agg(
            F.count("*").alias("n"),
            F.regr_slope("value", "x").alias("slope"),
            F.coalesce(F.regr_r2("value", "x"), F.lit(0.0)).alias("r2"),
        )
        slope = F.col("slope")
        parts.append(
            line.where(F.col("n") > 1).select(
                F.lit(value).alias("column"),
                F.lit(time).alias("temporal_column"),
                F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable").alias("direction"),
                F.round("slope", 6).alias("slope"),
                F.round("r2", 4).alias("r_squared"),
            )
        )
    return stacked(parts)


def forecast(yearly: DataFrame, future: int = 5, complete_until: int | None = None) -> DataFrame:
    """(year, actual, predicted, confidence) from (year, value) rows.

    Years after the last are the rounded line, never below zero. With
    `complete_until` later years are shown but not fitted, since a partial
    last year would drag the line down. Fewer than two years: no rows.
    """
    fitted = yearly if complete_until is None else yearly.where(F.col("year") <= complete_until)
    line = fit(fitted, "year", "value").where((F.col("n") >= 2) & F.col("slope").isNotNull())
    last = yearly.agg(F.max("year").alias("last"))
    model = with_one_row(line, last).select("slope", "intercept", "last", F.col("r_squared").alias("confidence"))
    actual = with_one_row(yearly, model).select(
        F.col("year").cast("int").alias("year"),
        F.col("value").cast("double").alias("actual"),
        F.lit(None).cast("double").alias("predicted"),
        F.round("confidence", 6).alias("confidence"),
    )
    ahead = model.select(
        F.explode(F.sequence(F.col("last").cast("int") + 1, F.col("last").cast("int") + future)).alias("year"),
        "slope",
        "intercept",
        "confidence",
    )
    predicted = F.floor(F.col("slope") * F.col("year") + F.col("intercept") + 0.5).cast("double")
    coming = ahead.select(
        "year",
        F.lit(None).cast("double").alias("actual"),
        F.greatest(F.lit(0.0), predicted).alias("predicted"),
        F.round("confidence", 6).alias("confidence"),
    )
    return actual.unionByName(coming).orderBy("year")


# ---------------------------------------------------------------- yearly patterns

NO_PATTERN = "Not enough data for pattern detection"


def yearly_trend(yearly: DataFrame) -> DataFrame:
    """(type, message, confidence): a steady rise or fall over at least three years."""
    ends = yearly.agg(
        F.count("*").alias("k"),
        F.avg("value").alias("mean"),
        F.min_by("value", "year").alias("first"),
        F.max_by("value", "year").alias("last"),
        F.greatest(F.max("year") - F.min("year"), F.count("*") - 1, F.lit(1)).alias("span"),
    )
    slope = (F.col("last") - F.col("first")) / F.col("span")
    return ends.where(
        (F.col("k") >= 3) & (F.col("mean") != 0) & (F.abs(slope) > F.col("mean") * 0.1)
    ).select(
        F.lit("trend").alias("type"),
        F.concat(
            F.lit("Content "), F.when(slope > 0, "increased").otherwise("decreased"), F.lit(" steadily over time.")
        ).alias("message"),
        F.round(F.least(F.lit(1.0), F.abs(slope) / F.col("mean")), 6).alias("confidence"),
    )


def yearly_anomalies(yearly: DataFrame) -> DataFrame:
    """(type, message, confidence): years more than two deviations off the mean."""
    level = yearly.agg(
        F.count("*").alias("k"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation")
    )
    distance = F.abs(F.col("value") - F.col("mean"))
    return (
        with_one_row(yearly, level)
        .where((F.col("k") >= 4) & (F.col("deviation") > 0) & (distance > F.col("deviation") * 2))
        .select(
            F.lit("anomaly").alias("type"),
            F.concat(
                F.lit("Sharp "),
                F.when(F.col("value") > F.col("mean"), "spike").otherwise("drop"),
                F.lit(" detected around "),
                F.col("year").cast("string"),
                F.lit("."),
            ).alias("message"),
            F.round(F.least(F.lit(1.0), distance / (F.col("deviation") * 2)), 6).alias("confidence"),
        )
    )


def dominance(counts: DataFrame, column: str) -> DataFrame:
    """(type, message, confidence): one value holds over 30% of the rows; ties by label."""
    top = counts.agg(
        F.count("*").alias("k"),
        F.min_by("label", F.struct(-F.col("value"), F.col("label"))).alias("label"),
        F.max("value").alias("value"),
        F.sum("value").alias("total"),
    )
    ratio = F.col("value") / F.col("total")
    return top.where((F.col("k") >= 2) & (F.col("total") > 0) & (ratio > 0.3)).select(
        F.lit("dominance").alias("type"),
        F.concat(capitalised(F.col("label")), F.lit(f" dominates the dataset in {column}.")).alias("message"),
        F.round(ratio, 6).alias("confidence"),
    )


def patterns(df: DataFrame, year_column: str | None, category: str | None) -> DataFrame:
    """All patterns found on the chosen columns; under three rows is an error."""
    if len(df.take(3)) < 3:
        raise ValueError(NO_PATTERN)
    found = []
    if year_column:
        yearly = count_per_year(df, year_column)
        found += [yearly_trend(yearly), yearly_anomalies(yearly)]
    if category:
        found.append(dominance(count_per_value(df, category), category))
    if not found:
        raise ValueError(NO_PATTERN)
    return stacked(found)
