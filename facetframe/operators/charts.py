"""The rows behind each chart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.functions.numbers import lenient_number, strict_number, without_nan
from facetframe.functions.text import question_form, strip
from facetframe.operators.aggregate import count_per_value, mean_per_category, mean_per_month
from facetframe.operators.filters import number_in
from facetframe.operators.frames import cell, kind_of, order_columns, with_one_row
from facetframe.operators.ordering import numbered, running_total
from facetframe.operators.stats import histogram, pearson

MAX_POINTS = 50
PIE_SLICES = 8
BAR_SLICES = 10


def category_bars(df: DataFrame, category: str, limit: int = BAR_SLICES) -> DataFrame:
    """(name, value): the most frequent values; ties by name."""
    counts = count_per_value(df, category).orderBy(F.desc("value"), "label").limit(limit)
    return counts.select(F.col("label").alias("name"), "value")


def category_pie(df: DataFrame, category: str) -> DataFrame:
    """As the bars, but no rows at all if there are more than eight values."""
    ranked = count_per_value(df, category).orderBy(F.desc("value"), "label").limit(PIE_SLICES + 1)
    sized = ranked.withColumn("_k", F.count("*").over(W.partitionBy(F.lit(0))))
    return sized.where(F.col("_k") <= PIE_SLICES).select(F.col("label").alias("name"), "value")


def monthly_line(df: DataFrame, time: str, value: str) -> DataFrame:
    months = mean_per_month(df, time, value)
    return months.select(F.col("period").alias("name"), "value")


def scatter_points(df: DataFrame, x: str, y: str, order_by, limit: int = 100, at_least: int = 6) -> DataFrame:
    """(x, y, r): the first complete pairs and their correlation; none if they are too few."""
    head = (
        df.select(
            F.struct(*order_columns(order_by)).alias("_at"),
            without_nan(number_in(df, x)).alias("x"),
            without_nan(number_in(df, y)).alias("y"),
        )
        .dropna(subset=["x", "y"])
        .orderBy("_at", "x", "y")
        .limit(limit)
    )
    # Both sides are the same few points.
    measured = head.agg(F.round(pearson("x", "y"), 4).alias("r"), F.count("*").alias("_k"))
    return with_one_row(head, measured).where(F.col("_k") >= at_least).select("x", "y", "r")


def average_bars(df: DataFrame, category: str, value: str) -> DataFrame:
    means = mean_per_category(df, category, value)
    return means.select(F.col("label").alias("name"), "value")


def histogram_bars(df: DataFrame, column: str, bins: int = 15) -> DataFrame:
    """(bin, name, value); the name is the two edges to one decimal."""
    edges = histogram(df, column, bins, digits=12)

    def shown(c: Column) -> Column:
        return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))

    return edges.select(
        "bin",
        F.concat(shown(F.col("bin_start")), F.lit("-"), shown(F.col("bin_end"))).alias("name"),
        F.col("count").alias("value"),
    )


def result_points(df: DataFrame, order_by, limit: int = MAX_POINTS) -> DataFrame:
    """(name, value): first label column and first numeric one (or two numeric ones), the first rows by a key."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    labels = [c for c, k in kinds.items() if k != "numeric"]
    if not numbers:
        raise ValueError("no numeric column to chart")
    if labels:
        x, y = labels[0], numbers[0]
    elif len(numbers) >= 2:
        x, y = numbers[0], numbers[1]
    else:
        x, y = df.columns[0], numbers[0]
    rows = df.orderBy(*order_columns(order_by))
    # The cap counts result rows; rows with nothing to draw are dropped after it.
    return (
        rows.select(cell(x).cast("string").alias("name"), without_nan(cell(y)).alias("value")).limit(limit).dropna()
    )


def dashboard_rows(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, value): rows whose value is a number."""
    number = number_in(df, value).cast("double")
    return df.select(strip(cell(category)).alias("category"), without_nan(number).alias("value")).where(
        F.col("value").isNotNull()
    )


def cumulative(df: DataFrame, value: str, order_by, digits: int | None = 2) -> DataFrame:
    """Rows with their running total, over the whole table."""
    total = running_total(df, value, order_by, "cumulative")
    if digits is None:
        return total
    return total.withColumn("cumulative", F.round("cumulative", digits))


def row_numbers(df: DataFrame, order_by, name: str = "index") -> DataFrame:
    return numbered(df, order_by, name)


def share_of_total(df: DataFrame, value: str = "value", digits: int = 6) -> DataFrame:
    """Add `share`: each value over the sum of all.

    The sum is a one-row aggregate, so the rows need no common partition.
    """
    total = df.agg(F.sum(cell(value)).alias("_total"))
    return (
        df.crossJoin(F.broadcast(total))
        .withColumn("share", F.round(F.try_divide(cell(value), F.col("_total")), digits))
        .drop("_total")
    )


def item_label(label: Column, position: Column) -> Column:
    """Missing or empty labels become `Item n`."""
    text = label.cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("Item "), position.cast("string")))


def labelled_rows(df: DataFrame, candidates: Sequence[str], order_by, name: str = "name") -> DataFrame:
    """Add a label: first candidate that is not null, else the row number; `Item n` if it is empty."""
    rows = numbered(df, order_by, "_n")
    source = F.coalesce(*[cell(c).cast("string") for c in candidates], F.col("_n").cast("string"))
    return rows.withColumn(name, item_label(source, F.col("_n"))).drop("_n")


def zip_points(df: DataFrame, labels: str, values: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., position, name, value): labels and values by position, cut to the shorter."""
    length = F.least(F.size(cell(labels)), F.size(cell(values)))
    zipped = F.slice(F.arrays_zip(cell(labels).alias("l"), cell(values).alias("v")), F.lit(1), length)
    points = df.where(length > 0).select(*[cell(k) for k in keep], F.posexplode(zipped).alias("position", "p"))
    label = F.col("p").getField("l")
    value = F.col("p").getField("v").cast("string")
    return points.select(
        *[cell(k) for k in keep],
        "position",
        item_label(label, F.col("position") + 1).alias("name"),
        F.coalesce(lenient_number(value, blank=0), F.lit(0.0)).alias("value"),
    )


def series_rows(df: DataFrame, label: str, series: Sequence[str]) -> DataFrame:
    """Label and one number or null per series; every row stays."""
    numbers = [lenient_number(cell(s).cast("string"), blank=0).alias(s) for s in series]
    return df.select(cell(label).cast("string").alias(label), *numbers)


def value_rows(df: DataFrame, label: str, value: str, pie: bool = False) -> DataFrame:
    """Label and value, what is no number as 0; a pie keeps values above zero."""
    number = F.coalesce(lenient_number(cell(value).cast("string"), blank=0), F.lit(0.0))
    rows = df.select(cell(label).cast("string").alias(label), number.alias(value))
    return rows.where(cell(value) > 0) if pie else rows


def merge_suggestions(lists: Sequence[DataFrame], limit: int = 4) -> DataFrame:
    """First of each (title, type) over lists of (position, title, type), earlier lists first."""
    tagged = [
        frame.select(
            F.lit(i).alias("turn"),
            "position",
            F.coalesce(F.nullif("title", F.lit("")), F.lit("chart")).alias("title"),
            F.coalesce(F.nullif("type", F.lit("")), F.lit("bar")).alias("type"),
        )
        for i, frame in enumerate(lists)
    ]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    first = union.groupBy("title", "type").agg(F.min(F.struct("turn", "position")).alias("at"))
    return first.orderBy("at", "title", "type").limit(limit).select("title", "type")


CHART_TYPES = ("bar", "line", "pie", "area", "scatter")


def valid_points(df: DataFrame, chart_type: Column, name: str, label: str, x: str, value: str) -> DataFrame:
    """(type, name, x, label, value): points with some label and a number."""
    n, l, p = (F.nullif(cell(c).cast("string"), F.lit("")) for c in (name, label, x))
    kind = F.lower(chart_type)
    return df.where(F.coalesce(n, l, p).isNotNull() & without_nan(cell(value)).isNotNull()).select(
        F.when(kind.isin(*CHART_TYPES), kind).otherwise("bar").alias("type"),
        F.coalesce(n, l, p).alias("name"),
        F.coalesce(p, n, l).alias("x"),
        F.coalesce(l, n, p).alias("label"),
        cell(value).cast("double").alias("value"),
    )


def numeric_text_points(df: DataFrame, category: str, value: str) -> DataFrame:
    """(category, value) from text columns by the strict number grammar."""
    return df.select(
        cell(category).cast("string").alias("category"), strict_number(cell(value)).alias("value")
    ).where(F.col("value").isNotNull())


def chart_type_of(question: Column, row_count: Column, has_label: Column) -> Column:
    """Chart type by the words of a question and the size of its result."""
    text = F.lower(question)

    def says(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    return (
        F.when(says("trend", "over time", "timeline", "by year", "by month"), "line")
        .when(
            says("distribution", "breakdown", "share", "proportion"),
            F.when(row_count <= PIE_SLICES, "pie").otherwise("bar"),
        )
        .when(says("scatter", "relationship", "correlation"), "scatter")
        .when((row_count <= 6) & has_label & says("percent", "share"), "pie")
        .otherwise("bar")
    )


def chart_type_by_intent(intent: Column, requested: Column, row_count: Column) -> Column:
    return (
        F.when(requested.isNotNull(), requested)
        .when(intent == "trend", "line")
        .when(intent == "correlation", "scatter")
        .when((intent == "distribution") & (row_count <= 6), "pie")
        .otherwise("bar")
    )


def local_chart_type(question: Column, intent: Column) -> Column:
    return F.when(intent == "trend", "line").when(question_form(question).contains("pie"), "pie").otherwise("bar")


def feature_suggestions(roles: DataFrame) -> DataFrame:
    """(position, title, type): what to draw, from the first columns of each role."""
    place = F.struct("position", "column")

    def nth(role: str, n: int) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col("role") == role, place)))
        return F.get(found, F.lit(n))["column"]

    first = roles.agg(
        nth("measure", 0).alias("m0"),
        nth("measure", 1).alias("m1"),
        nth("dimension", 0).alias("d0"),
        nth("time", 0).alias("t0"),
    )
    offers = F.array(
        F.struct(F.lit(0).alias("position"), F.concat("m0", F.lit(" by "), "d0").alias("title"), F.lit("bar").alias("type")),
        F.struct(F.lit(1).alias("position"), F.concat("m0", F.lit(" over "), "t0").alias("title"), F.lit("line").alias("type")),
        F.struct(F.lit(2).alias("position"), F.concat("m0", F.lit(" vs "), "m1").alias("title"), F.lit("scatter").alias("type")),
    )
    return first.select(F.inline(offers)).where(F.col("title").isNotNull())
