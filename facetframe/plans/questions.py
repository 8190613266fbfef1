"""The common questions about one table, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.functions.numbers import without_nan
from facetframe.operators.aggregate import group_labels, group_metric
from facetframe.operators.cleaning import sample_values
from facetframe.operators.filters import apply_filters, number_in
from facetframe.operators.frames import cell, order_columns
from facetframe.operators.profile import role_counts

TOP_GROUPS = 10


# ---------------------------------------------------------------- own SELECT


def run_select(df: DataFrame, sql: str, table: str = "dataset") -> DataFrame:
    """The user's own SELECT over the one table; `"name"` is a column, not a text."""
    statement = sql.strip().rstrip(";")
    if not statement.upper().startswith("SELECT"):
        raise ValueError("Only SELECT queries are allowed.")
    spark = df.sparkSession
    df.createOrReplaceTempView(table)
    option = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(option, "false")
    spark.conf.set(option, "true")
    try:
        return spark.sql(statement)
    finally:
        spark.conf.set(option, before)


def select_outcome(df: DataFrame, sql: str, table: str = "dataset") -> DataFrame:
    """(columns, row_count, error) of a SELECT: an error is a row, not an exception."""
    schema = "columns array<string>, row_count bigint, error string"
    try:
        result = run_select(df, sql, table)
    except Exception as failure:
        return df.sparkSession.createDataFrame([([], 0, str(failure))], schema)
    names = F.array(*[F.lit(c) for c in result.columns])
    return result.agg(F.count("*").alias("row_count")).select(
        names.alias("columns"), "row_count", F.lit(None).cast("string").alias("error")
    )


def distinct_samples(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    return sample_values(df, list(columns or df.columns), k)


# ---------------------------------------------------------------- grouped questions


def _by_group(df: DataFrame, group: str, aggregates: dict[str, Column], best: str, limit: int | None) -> DataFrame:
    grouped = df.groupBy(cell(group)).agg(*[c.alias(name) for name, c in aggregates.items()])
    ordered = grouped.orderBy(F.desc(best), cell(group))
    return ordered.limit(limit) if limit else ordered


def _mean(df: DataFrame, metric: str) -> Column:
    return F.round(F.avg(number_in(df, metric)), 2)


def how_many(df: DataFrame, group: str | None = None, limit: int | None = TOP_GROUPS) -> DataFrame:
    if group is None:
        return df.agg(F.count("*").alias("total_count"))
    return _by_group(df, group, {"count": F.count("*")}, "count", limit)


def top_rows(df: DataFrame, metric: str | None, n: int = 5, group: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Rows with the largest metric; without a metric the most frequent groups."""
    if metric is None:
        return how_many(df, group, n)
    return df.orderBy(cell(metric).desc(), *order_columns(ties)).limit(n)


def bottom_rows(df: DataFrame, metric: str, n: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    """Rows with the smallest metric; missing ones come first."""
    return df.orderBy(cell(metric).asc_nulls_first(), *order_columns(ties)).limit(n)


def average(df: DataFrame, metric: str, group: str | None = None) -> DataFrame:
    if group is None:
        return df.agg(_mean(df, metric).alias("average"))
    name = f"avg_{metric.lower().replace(' ', '_')}"
    return _by_group(df, group, {name: _mean(df, metric)}, name, TOP_GROUPS)


def total(df: DataFrame, metric: str, group: str | None = None, digits: int | None = None) -> DataFrame:
    value = F.sum(number_in(df, metric))
    value = value if digits is None else F.round(value, digits)
    if group is None:
        return df.agg(value.alias("total"))
    name = f"total_{metric.lower().replace(' ', '_')}"
    return _by_group(df, group, {name: value}, name, TOP_GROUPS)


def distribution(df: DataFrame, group: str, metric: str | None = None) -> DataFrame:
    aggregates = {"count": F.count("*")}
    if metric:
        aggregates[f"avg_{metric.lower().replace(' ', '_')}"] = _mean(df, metric)
    return _by_group(df, group, aggregates, "count", TOP_GROUPS)


def comparison(df: DataFrame, group: str, metric: str | None = None) -> DataFrame:
    """Every group, with count, average and sum."""
    aggregates = {"count": F.count("*")}
    if metric:
        suffix = metric.lower().replace(" ", "_")
        aggregates[f"avg_{suffix}"] = _mean(df, metric)
        aggregates[f"total_{suffix}"] = F.round(F.sum(number_in(df, metric)), 2)
    return _by_group(df, group, aggregates, "count", None)


def default_view(df: DataFrame, category: str | None, order_by=None, rows: int = 10) -> DataFrame:
    """The usual grouped count, or the first rows where there is no category."""
    if category:
        return how_many(df, category)
    return df.orderBy(*order_columns(order_by)).limit(rows)


# ---------------------------------------------------------------- intents


def trend_buckets(df: DataFrame, time: str, measure: str, metric: str = "sum", buckets: int = 12) -> DataFrame:
    """(bucket, value) ordered by bucket; a count question sums the measure."""
    wanted = "sum" if metric == "count" else metric
    grouped = group_metric(df, time, measure, wanted, limit=None)
    return grouped.select(F.col("label").alias("bucket"), "value").orderBy("bucket").limit(buckets)


def paired_values(df: DataFrame, x: str, y: str, order_by, limit: int = 20) -> DataFrame:
    """(x, value): the first pairs with both numbers."""
    return (
        df.select(
            F.struct(*order_columns(order_by)).alias("_at"),
            without_nan(number_in(df, x)).alias("x"),
            without_nan(number_in(df, y)).alias("value"),
        )
        .dropna(subset=["x", "value"])
        .orderBy("_at")
        .limit(limit)
        .select("x", "value")
    )


def grouped_answer(
    df: DataFrame,
    dimension: str | None,
    measure: str | None,
    metric: str,
    intent: str = "aggregation",
    conditions=(),
) -> DataFrame:
    """(label, value), top 10; only min, max and aggregation questions use the measure."""
    used = metric if metric in ("min", "max") or intent == "aggregation" else "count"
    direction = "asc" if metric == "min" else "desc"
    return group_metric(apply_filters(df, conditions), dimension, measure, used, TOP_GROUPS, direction)


def trend_counts(df: DataFrame, time: str) -> DataFrame:
    return group_labels(df, time, trend=True, limit=None)


def compare_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return group_labels(df, column, values=values, limit=2)


def filtered_total(df: DataFrame, conditions) -> DataFrame:
    return apply_filters(df, conditions).agg(F.count("*").alias("value")).select(F.lit("Result").alias("label"), "value")


def overview(roles: DataFrame) -> DataFrame:
    return role_counts(roles)
