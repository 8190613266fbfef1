"""Grouped aggregates over one dimension. All combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.functions.dates import lenient_timestamp, month_of, parse_date, year_rows
from facetframe.functions.numbers import without_nan
from facetframe.functions.text import blank_to_null, known_label, question_form, strip
from facetframe.operators.filters import number_in
from facetframe.operators.frames import cell, kind_of, order_columns


def _kind(df: DataFrame, column: str) -> str:
    return kind_of(df.schema[column].dataType)


def timestamp_in(df: DataFrame, column: str, parse=parse_date) -> Column:
    """The column as it is when it holds dates, else parsed."""
    return cell(column) if _kind(df, column) == "datetime" else parse(cell(column).cast("string"))


def _ordered(df: DataFrame, direction: str, limit: int | None) -> DataFrame:
    value = F.asc("value") if direction == "asc" else F.desc("value")
    ordered = df.orderBy(value, F.asc("label"))
    return ordered.limit(limit) if limit else ordered


def group_metric(
    df: DataFrame,
    dimension: str | None,
    measure: str | None = None,
    metric: str = "count",
    limit: int | None = 10,
    direction: str = "desc",
    average_all: bool = True,
) -> DataFrame:
    """(label, value) per group, best first; ties by label.

    `average` divides by all rows of the group, also those without a number;
    with `average_all` off only by the rows that have one. `min` and `max`
    fall back to the count where a group has no number. Without a dimension
    there is one row, labelled `Result`.
    """
    if dimension is None:
        group, label = F.lit("Result"), F.col("label")
    elif _kind(df, dimension) == "text":
        group, label = known_label(cell(dimension)), F.col("label")
    else:
        # Numbers and dates are grouped as they are and written out per group.
        group, label = cell(dimension), known_label(F.col("label"))
    number = number_in(df, measure) if measure else F.lit(None).cast("double")
    rows = df.select(group.alias("label"), number.cast("double").alias("number"))
    total = F.coalesce(F.sum("number"), F.lit(0.0))
    values = {
        "count": F.count("*").cast("double"),
        "sum": F.round(total, 2),
        "average": F.round(total / F.count("*") if average_all else F.coalesce(F.avg("number"), F.lit(0.0)), 2),
        "min": F.coalesce(F.min("number"), F.count("*").cast("double")),
        "max": F.coalesce(F.max("number"), F.count("*").cast("double")),
    }
    grouped = rows.groupBy("label").agg(values[metric].alias("value")).select(label.alias("label"), "value")
    return _ordered(grouped, direction, limit)


def group_labels(
    df: DataFrame,
    dimension: str,
    measure: str | None = None,
    metric: str = "count",
    values: Sequence[str] = (),
    trend: bool = False,
    limit: int | None = 10,
    direction: str = "desc",
) -> DataFrame:
    """(label, value); blank groups are skipped, min and max count rows.

    `values` keeps only the groups named. A trend is in natural label order.
    """
    label = blank_to_null(cell(dimension))
    number = number_in(df, measure).cast("double") if measure else F.lit(None).cast("double")
    rows = df.select(label.alias("label"), number.alias("number")).where(F.col("label").isNotNull())
    if values:
        rows = rows.where(question_form(F.col("label")).isin(*[question_form(F.lit(v)) for v in values]))
    average = F.round(F.coalesce(F.sum("number"), F.lit(0.0)) / F.count("*"), 2)
    value = average if metric == "average" else F.count("*").cast("double")
    grouped = rows.groupBy("label").agg(value.alias("value"))
    if trend:
        ordered = grouped.orderBy(F.col("label").try_cast("double"), "label")
        return ordered.limit(limit) if limit else ordered
    return _ordered(grouped, direction, limit)


def count_per_value(df: DataFrame, column: str) -> DataFrame:
    """(label, value): rows per non-blank value."""
    return (
        df.select(strip(cell(column)).alias("label"))
        .where(F.col("label") != "")
        .groupBy("label")
        .agg(F.count("*").alias("value"))
    )


def count_per_year(df: DataFrame, column: str) -> DataFrame:
    """(year, value): rows per four-digit year cell; other cells are left out."""
    return (
        df.where(year_rows(cell(column)))
        .groupBy(cell(column).cast("string").cast("int").alias("year"))
        .agg(F.count("*").alias("value"))
        .orderBy("year")
    )


def _periods(df: DataFrame, time: str, value: str, aggregate, parse=parse_date) -> DataFrame:
    rows = df.select(
        month_of(timestamp_in(df, time, parse)).alias("period"), without_nan(number_in(df, value)).alias("number")
    ).dropna()
    return rows.groupBy("period").agg(aggregate("number").alias("value"), F.count("*").alias("n"))


def mean_per_month(df: DataFrame, time: str, value: str, limit: int | None = 24, digits: int | None = 2) -> DataFrame:
    """(period, value): the mean of each month, oldest first."""
    months = _periods(df, time, value, F.avg).orderBy("period")
    shown = F.round("value", digits) if digits is not None else F.col("value")
    months = months.select("period", shown.alias("value"))
    return months.limit(limit) if limit else months


def sum_per_month(df: DataFrame, time: str, value: str, limit: int | None = 12) -> DataFrame:
    months = _periods(df, time, value, F.sum, lenient_timestamp).orderBy("period")
    months = months.select("period", F.round("value", 2).alias("value"))
    return months.limit(limit) if limit else months


def mean_per_number(df: DataFrame, time: str, value: str) -> DataFrame:
    """(period, value) when time is a number, such as a year."""
    rows = df.select(
        number_in(df, time).cast("double").alias("at"), without_nan(number_in(df, value)).alias("number")
    ).dropna()
    whole = F.col("at") == F.floor("at")
    label = F.when(whole, F.col("at").cast("long").cast("string")).otherwise(F.col("at").cast("string"))
    return rows.groupBy("at").agg(F.avg("number").alias("value")).orderBy("at").select(label.alias("period"), "value")


def mean_per_category(df: DataFrame, category: str, value: str, limit: int = 10, digits: int = 2) -> DataFrame:
    rows = df.select(cell(category).alias("label"), number_in(df, value).cast("double").alias("number")).dropna()
    grouped = rows.groupBy("label").agg(F.avg("number").alias("value"))
    return grouped.orderBy(F.desc("value"), "label").limit(limit).select("label", F.round("value", digits).alias("value"))


def sum_per_category(
    df: DataFrame, category: str, value: str, limit: int = 10, first_seen_by=None
) -> DataFrame:
    """(label, value): largest first, or in order of appearance by a given key."""
    number = F.coalesce(number_in(df, value).cast("double"), F.lit(0.0))
    label = known_label(cell(category))
    if first_seen_by is None:
        grouped = df.groupBy(label.alias("label")).agg(F.round(F.sum(number), 2).alias("value"))
        return _ordered(grouped, "desc", limit)
    at = F.struct(*order_columns(first_seen_by))
    grouped = df.groupBy(label.alias("label")).agg(F.sum(number).alias("value"), F.min(at).alias("_at"))
    return grouped.orderBy("_at", "label").limit(limit).select("label", F.round("value", 2).alias("value"))


def segmentation(
    df: DataFrame,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    segments: int = 10,
    results: int = 6,
) -> DataFrame:
    """(dimension, metric, segment, mean, count, std) for up to 3 x 2 pairs.

    Cells are unpivoted twice, so all pairs share one shuffle; segments are
    the first by name.
    """
    dims, nums = list(dimensions)[:3], list(metrics)[:2]
    pairs = [(d, m) for d in dims for m in nums][:results]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair"),
                cell(d).cast("string").alias("segment"),
                number_in(df, m).cast("double").alias("number"),
            )
            for i, (d, m) in enumerate(pairs)
        ]
    )
    grouped = (
        df.select(F.inline(cells))
        .where(F.col("segment").isNotNull())
        .groupBy("pair", "segment")
        .agg(
            F.round(F.avg("number"), 2).alias("mean"),
            F.count("number").alias("count"),
            F.coalesce(F.round(F.stddev_samp("number"), 2), F.lit(0.0)).alias("std"),
        )
    )
    names = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(m).alias("m")) for d, m in pairs])
    return (
        grouped.withColumn("_rank", F.row_number().over(W.partitionBy("pair").orderBy("segment")))
        .where(F.col("_rank") <= segments)
        .withColumn("_names", F.get(names, F.col("pair")))
        .select(
            F.col("_names.d").alias("dimension"), F.col("_names.m").alias("metric"), "segment", "mean", "count", "std"
        )
    )


def result_summary(df: DataFrame, value: str) -> DataFrame:
    """(row_count, min, max, mean, spread) of one numeric result column."""
    number = number_in(df, value).cast("double")
    return df.agg(
        F.count("*").alias("row_count"),
        F.round(F.min(number), 2).alias("min"),
        F.round(F.max(number), 2).alias("max"),
        F.round(F.avg(number), 2).alias("mean"),
        F.round(F.max(number) - F.min(number), 2).alias("spread"),
    )


def card_figures(df: DataFrame, value: str = "value") -> DataFrame:
    """(average, min, max) for the cards above a dashboard; zeros if it is empty."""
    number = number_in(df, value).cast("double")
    return df.agg(
        *[
            F.coalesce(F.round(f(number), 2), F.lit(0.0)).alias(name)
            for name, f in (("average", F.avg), ("min", F.min), ("max", F.max))
        ]
    )
