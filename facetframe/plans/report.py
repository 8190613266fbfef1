"""Reports put together from the operators: KPI rows, insights, overview, JSON.

Column choices ("first numeric column") are windows over the profile, which
has one row per column of the table. A report reads its profile many times, so
callers pass it through `settled_profile` once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.functions.text import title_label
from facetframe.operators import charts
from facetframe.operators.aggregate import segmentation
from facetframe.operators.frames import cell, numeric_columns, stacked
from facetframe.operators.profile import (
    PROFILER,
    REPORT,
    TypeRules,
    column_counts,
    cv_of,
    domain_of,
    duplicate_rows,
    full_profile,
    numeric_aggregates,
    numeric_values,
    REPORT_DOMAIN_WORDS,
    DOMAIN_WORDS,
)
from facetframe.operators.stats import anomalies, correlations, corrected_skewness, outliers, strong_pairs
from facetframe.operators.trend import report_trends
from facetframe.session import checkpointed


def settled_profile(df: DataFrame, order_by, rules: TypeRules = PROFILER) -> DataFrame:
    """The full profile, computed once and kept: it is one row per column."""
    return checkpointed(full_profile(df, order_by, rules))


def names_of(profile: DataFrame, condition: Column) -> list[str]:
    """Column names in table order. The profile has one row per column."""
    rows = profile.where(condition).orderBy("position").select("column").collect()
    return [r["column"] for r in rows]


def _nth(profile: DataFrame, condition: Column) -> DataFrame:
    """The matching profile rows with their 0-based rank `k` in table order."""
    return profile.where(condition).withColumn("k", F.row_number().over(W.orderBy("position")) - 1)


def _money(c: Column, digits: int = 2) -> Column:
    return F.format_number(c, digits)


def _numeric() -> Column:
    return F.col("detected_type") == "numeric"


def _categorical() -> Column:
    return F.col("detected_type") == "categorical"


# ---------------------------------------------------------------- KPI rows


def _whole(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.max("row_count").alias("rows"),
        F.sum("missing").alias("missing"),
        (F.max("row_count") * F.count("*")).alias("cells"),
    )


def _completeness(missing: Column, cells: Column) -> Column:
    return F.coalesce(F.try_divide((cells - missing) * 100.0, cells), F.lit(100.0))


def profile_kpis(profile: DataFrame, limit: int = 8) -> DataFrame:
    """(place, label, value): records, first numeric columns, completeness, first category."""
    whole = _whole(profile)
    numbers = _nth(profile, _numeric()).where(F.col("k") < 3)
    rows = [
        whole.select(F.lit(0).alias("place"), F.lit("Total Records").alias("label"), _money(F.col("rows"), 0).alias("value")),
        numbers.where(F.col("sum") > 0).select(
            (F.col("k") * 2 + 1).alias("place"),
            F.concat(F.lit("Total "), "column").alias("label"),
            _money(F.col("sum")).alias("value"),
        ),
        numbers.where(F.col("average").isNotNull()).select(
            (F.col("k") * 2 + 2).alias("place"),
            F.concat(F.lit("Avg "), "column").alias("label"),
            _money(F.col("average")).alias("value"),
        ),
        whole.where(F.col("cells") > 0).select(
            F.lit(10).alias("place"),
            F.lit("Data Completeness").alias("label"),
            F.concat(_money(_completeness(F.col("missing"), F.col("cells")), 1), F.lit("%")).alias("value"),
        ),
        _nth(profile, _categorical())
        .where(F.col("k") == 0)
        .select(
            F.lit(11).alias("place"),
            F.concat(F.lit("Unique "), "column").alias("label"),
            F.col("unique_count").cast("string").alias("value"),
        ),
    ]
    return stacked(rows).orderBy("place").limit(limit)


def report_kpis(profile: DataFrame, limit: int = 10) -> DataFrame:
    """(place, label, value, formula); the headline is the numeric column with the largest sum."""
    whole = _whole(profile)
    positive = _numeric() & (F.col("sum") > 0)
    numbers = _nth(profile, positive)
    title = title_label(F.col("column"))
    cv = cv_of(F.col("std"), F.abs("average"))
    level = F.when(cv > 50, "High").when(cv > 20, "Moderate").otherwise("Low")
    headline = profile.where(positive).orderBy(F.desc("sum"), "position").limit(1)
    rows = [
        headline.select(
            F.lit(0).alias("place"),
            F.concat(F.lit("Total "), title).alias("label"),
            _money(F.col("sum")).alias("value"),
            F.concat(F.lit("SUM("), "column", F.lit(")")).alias("formula"),
        ),
        whole.select(
            F.lit(1).alias("place"),
            F.lit("Total Records").alias("label"),
            _money(F.col("rows"), 0).alias("value"),
            F.lit("COUNT(*)").alias("formula"),
        ),
        numbers.where((F.col("k") < 3) & F.col("average").isNotNull()).select(
            (F.col("k") + 2).alias("place"),
            F.concat(F.lit("Average "), title).alias("label"),
            _money(F.col("average")).alias("value"),
            F.concat(F.lit("AVG("), "column", F.lit(")")).alias("formula"),
        ),
        whole.select(
            F.lit(10).alias("place"),
            F.lit("Data Completeness").alias("label"),
            F.concat(_money(_completeness(F.col("missing"), F.col("cells")), 1), F.lit("%")).alias("value"),
            F.lit("(Filled Cells / Total Cells) × 100").alias("formula"),
        ),
        _nth(profile, _categorical())
        .where(F.col("k") < 2)
        .select(
            (F.col("k") + 11).alias("place"),
            F.concat(F.lit("Unique "), title).alias("label"),
            F.col("unique_count").cast("string").alias("value"),
            F.concat(F.lit("COUNT(DISTINCT "), "column", F.lit(")")).alias("formula"),
        ),
        numbers.where((F.col("k") < 2) & F.col("std").isNotNull() & (F.col("average") != 0)).select(
            (F.col("k") + 13).alias("place"),
            F.concat(title, F.lit(" Variability")).alias("label"),
            F.concat(level, F.lit(" (CV: "), _money(cv, 1), F.lit("%)")).alias("value"),
            F.lit("(STDDEV / MEAN) × 100").alias("formula"),
        ),
    ]
    return stacked(rows).orderBy("place").limit(limit)


def column_kpis(profile: DataFrame, limit: int = 4) -> DataFrame:
    """(place, label, value, basis): the sum of a numeric column, or its mean if the sum is small."""
    large = F.abs(F.col("sum")) >= 1000
    return (
        _nth(profile, _numeric() & F.col("sum").isNotNull())
        .where(F.col("k") < limit)
        .select(
            F.col("k").alias("place"),
            F.col("column").alias("label"),
            _money(F.when(large, F.col("sum")).otherwise(F.col("average"))).alias("value"),
            F.when(large, "sum").otherwise("average").alias("basis"),
        )
        .orderBy("place")
    )


def legacy_kpis(df: DataFrame) -> DataFrame:
    """(place, label, value): records, columns and the share of filled cells."""
    whole = column_counts(df).agg(
        F.max("row_count").alias("rows"), F.sum("filled").alias("filled"), F.sum("row_count").alias("cells"), F.count("*").alias("k")
    )
    health = F.concat(F.format_number(F.try_divide(F.col("filled") * 100.0, F.col("cells")), 1), F.lit("%"))
    entries = F.array(
        F.struct(F.lit(0).alias("place"), F.lit("Total Records").alias("label"), F.col("rows").cast("string").alias("value")),
        F.struct(F.lit(1).alias("place"), F.lit("Total Columns").alias("label"), F.col("k").cast("string").alias("value")),
        F.struct(F.lit(2).alias("place"), F.lit("Overall Health").alias("label"), health.alias("value")),
    )
    return whole.select(F.inline(entries))


# ---------------------------------------------------------------- insights


def _said(place: Column, kind: str, column: Column, text: Column, importance: str | Column = "medium") -> list[Column]:
    level = F.lit(importance) if isinstance(importance, str) else importance
    return [
        place.alias("place"),
        F.lit(kind).alias("category"),
        column.alias("column"),
        text.alias("message"),
        level.alias("importance"),
    ]


def _worst(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("missing") > 0).orderBy(F.desc("missing"), "position").limit(1)


def _missing_pct() -> Column:
    return F.col("missing") * 100.0 / (F.col("filled") + F.col("missing"))


def profile_insights(profile: DataFrame, domain: str = "general", limit: int = 10) -> DataFrame:
    """(place, category, column, message, importance), in order of telling."""
    counts = profile.agg(
        F.max("row_count").alias("rows"),
        F.count("*").alias("k"),
        F.count_if(_numeric()).alias("numbers"),
        F.count_if(_categorical()).alias("categories"),
    )
    opening = F.format_string(
        f"This {domain} dataset contains %s records across %d columns (%d numeric, %d categorical).",
        F.format_number("rows", 0),
        "k",
        "numbers",
        "categories",
    )
    cv = cv_of(F.col("std"), F.abs("average"))
    usable = _numeric() & F.col("min").isNotNull() & (F.coalesce(F.col("std"), F.lit(0.0)) != 0) & (F.col("average") != 0)
    span = [_money(F.col("min")), _money(F.col("max"))]
    varied = F.format_string(
        "**%s** shows high variability (CV=%s%%) — ranging from %s to %s.",
        "column",
        F.replace(F.format_number(cv, 0), F.lit(","), F.lit("")),
        *span,
    )
    steady = F.format_string("**%s** ranges from %s to %s with average %s.", "column", *span, _money(F.col("average")))
    gap = F.format_string(
        "**%s** has the most missing data (%s values, %s%%).",
        "column",
        F.format_number("missing", 0),
        F.format_number(_missing_pct(), 1),
    )
    top = F.get("top_values", F.lit(0))
    leader = F.format_string(
        'The most common **%s** is "%s" (%s occurrences).', "column", top["value"], F.format_number(top["n"], 0)
    )
    rows = [
        counts.select(*_said(F.lit(0), "overview", F.lit("*"), opening, "high")),
        profile.where(usable).select(
            *_said(F.col("position") + 1, "distribution", F.col("column"), F.when(cv > 50, varied).otherwise(steady))
        ),
        _worst(profile).select(*_said(F.lit(10_000), "quality", F.col("column"), gap)),
        profile.where(_categorical() & (F.size("top_values") > 0)).select(
            *_said(F.col("position") + 20_000, "pattern", F.col("column"), leader)
        ),
    ]
    return stacked(rows).orderBy("place").limit(limit)


def report_insights(df: DataFrame, profile: DataFrame, domain: str = "general", limit: int = 12) -> DataFrame:
    """As the profile insights, with skewness, category shares and IQR outliers."""
    numbers = names_of(profile, _numeric())
    context = "This dataset" if domain == "general" else f"This {domain} dataset"
    counts = profile.agg(
        F.max("row_count").alias("rows"),
        F.count("*").alias("k"),
        F.count_if(_numeric()).alias("numbers"),
        F.count_if(_categorical()).alias("categories"),
    )
    opening = F.format_string(
        f"{context} contains %s records with %d attributes (%d metrics, %d dimensions).",
        F.format_number("rows", 0),
        "k",
        "numbers",
        "categories",
    )
    rows = [counts.select(*_said(F.lit(0), "overview", F.lit("*"), opening, "high"))]
    if numbers:
        skews = numeric_aggregates(df, numeric_values(df, numbers), ("n", "g1")).select(
            "column", F.col("n"), corrected_skewness(F.col("n"), F.col("g1")).alias("skew")
        )
        skew = F.col("skew")
        figures = [_money(F.col("min")), _money(F.col("max")), _money(F.col("average"))]
        leaning = F.format_string(
            "**%s** is %s (skewness: %s), ranging from %s to %s with average %s.",
            "column",
            F.when(skew > 0, "right-skewed").otherwise("left-skewed"),
            F.format_number(skew, 2),
            *figures,
        )
        level = F.format_string(
            "**%s** ranges from %s to %s with average %s and standard deviation %s.",
            "column",
            *figures,
            F.replace(F.format_number("std", 2), F.lit(","), F.lit("")),
        )
        skewed = F.abs(skew) > 1
        rows.append(
            profile.join(F.broadcast(skews), "column")
            .where((F.coalesce(F.col("std"), F.lit(0.0)) != 0) & (F.col("average") != 0) & (F.col("n") > 10))
            .select(
                *_said(
                    F.col("position") + 1,
                    "distribution",
                    F.col("column"),
                    F.when(skewed, leaning).otherwise(level),
                    F.when(skewed, "medium").otherwise("low"),
                )
            )
        )
        found = outliers(df, numbers[:3]).where(
            (F.col("n") > 10) & (F.col("outlier_count") > 0) & (F.col("outlier_count") / F.col("n") > 0.01)
        )
        odd = F.format_string(
            "Found %s potential outliers (%s%%) in **%s** using IQR method.",
            F.format_number("outlier_count", 0),
            F.format_number(F.col("outlier_count") * 100.0 / F.col("n"), 1),
            "column",
        )
        rows.append(
            profile.select("column", "position")
            .join(F.broadcast(found), "column")
            .select(*_said(F.col("position") + 30_000, "anomaly", F.col("column"), odd))
        )
    top = F.get("top_values", F.lit(0))
    shown = F.aggregate("top_values", F.lit(0).cast("long"), lambda a, v: a + v["n"])
    leader = F.format_string(
        "**%s** is the most common %s with %s occurrences (%s%% of data).",
        top["value"],
        "column",
        F.format_number(top["n"], 0),
        F.format_number(top["n"] * 100.0 / shown, 1),
    )
    rows.append(
        profile.where(_categorical() & (F.size("top_values") > 0)).select(
            *_said(F.col("position") + 10_000, "pattern", F.col("column"), leader)
        )
    )
    gap = F.format_string(
        "**%s** has %s missing values (%s%% missing).",
        "column",
        F.format_number("missing", 0),
        F.format_number(_missing_pct(), 1),
    )
    rows.append(
        _worst(profile).select(
            *_said(F.lit(20_000), "quality", F.col("column"), gap, F.when(_missing_pct() > 10, "high").otherwise("medium"))
        )
    )
    return stacked(rows).orderBy("place").limit(limit)


def legacy_insights(df: DataFrame, limit: int = 6) -> DataFrame:
    """(column, kind, value): CV above 50 (signed mean), or under 80% filled, in table order."""
    numbers = numeric_columns(df)
    places = {c: i for i, c in enumerate(df.columns)}
    counts = column_counts(df)
    place = reduce(lambda acc, c: F.when(F.col("column") == c, places[c]).otherwise(acc), df.columns, F.lit(0))
    parts = [
        counts.where(F.col("filled") * 100.0 / F.col("row_count") < 80).select(
            (place * 2 + 1).alias("place"),
            "column",
            F.lit("missing").alias("kind"),
            F.round(F.col("filled") * 100.0 / F.col("row_count"), 1).alias("value"),
        )
    ]
    if numbers:
        stats = numeric_aggregates(df, numeric_values(df, numbers), ("mean", "std"))
        cv = cv_of(F.col("std"), F.col("mean"))
        parts.append(
            stats.where(cv > 50).select(
                (place * 2).alias("place"), "column", F.lit("variability").alias("kind"), F.round(cv, 1).alias("value")
            )
        )
    return stacked(parts).orderBy("place").limit(limit).select("column", "kind", "value")


def role_patterns(roles: DataFrame, averages: DataFrame, tops: DataFrame) -> DataFrame:
    """(type, message, confidence): first measure, leader of the first dimension, time by measure.

    `roles` comes from `with_roles`, `averages` holds (column, average) and
    `tops` (column, rank, value, n).
    """

    def first(role: str) -> DataFrame:
        return roles.where(F.col("role") == role).orderBy("position").limit(1)

    measure, time, dimension = first("measure"), first("time"), first("dimension")
    average = F.format_number(F.coalesce("average", F.lit(0.0)), 2)
    mean = measure.join(averages, "column", "left").select(
        F.lit("measure").alias("type"),
        F.format_string("%s averages %s across %d rows.", "column", F.replace(average, F.lit(","), F.lit("")), "row_count").alias(
            "message"
        ),
        F.lit(0.72).alias("confidence"),
    )
    lead = dimension.join(tops.where(F.col("rank") == 1), "column").select(
        F.lit("distribution").alias("type"),
        F.format_string("%s is led by %s with %d rows.", "column", "value", "n").alias("message"),
        F.lit(0.68).alias("confidence"),
    )
    over = time.select(F.col("column").alias("t")).crossJoin(measure.select(F.col("column").alias("m"))).select(
        F.lit("trend").alias("type"),
        F.format_string("%s can be used to chart %s over time.", "t", "m").alias("message"),
        F.lit(0.74).alias("confidence"),
    )
    return stacked([mean, lead, over])


# ---------------------------------------------------------------- overview


def type_counts(profile: DataFrame) -> DataFrame:
    kinds = ("numeric", "categorical", "datetime", "text", "boolean")
    return profile.agg(
        F.count("*").alias("column_count"),
        *[F.count_if(F.col("detected_type") == k).alias(f"{k}_count") for k in kinds],
    )


def key_fields(profile: DataFrame, limit: int = 10) -> DataFrame:
    """(position, column, type): metrics, small dimensions and time columns."""
    kind = (
        F.when(_numeric() & (F.col("sum") > 0), "metric")
        .when(_categorical() & (F.col("unique_count") <= 20), "dimension")
        .when(F.col("detected_type") == "datetime", "temporal")
    )
    fields = profile.select("position", "column", kind.alias("type")).where(F.col("type").isNotNull())
    return fields.orderBy("position").limit(limit)


def data_quality(df: DataFrame, profile: DataFrame) -> DataFrame:
    """One row (row_count, column_count, completeness, duplicate_rows, worst_column, worst_missing)."""
    whole = profile.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.round(_completeness(F.sum("missing"), F.max("row_count") * F.count("*")), 2).alias("completeness"),
    )
    worst = _worst(profile).agg(
        F.first("column").alias("worst_column"), F.coalesce(F.first("missing"), F.lit(0).cast("long")).alias("worst_missing")
    )
    return whole.crossJoin(duplicate_rows(df)).crossJoin(worst)


# ---------------------------------------------------------------- reports


def table_domain(df: DataFrame, words=DOMAIN_WORDS) -> str:
    """The domain the column names speak for; headers only, no data is read."""
    row = df.sparkSession.range(1).select(domain_of(F.lit(" ".join(df.columns)), words).alias("d"))
    return row.first()["d"]


def statistics_report(df: DataFrame, name: str) -> DataFrame:
    """One JSON document: row and column counts, column summary, correlations, IQR outliers."""

    def packed(frame: DataFrame, alias: str) -> DataFrame:
        # Each section has a row per column, or per pair of columns.
        row = F.struct(*[cell(c) for c in frame.columns])
        return frame.agg(F.array_sort(F.collect_list(row)).alias(alias))

    counts = column_counts(df)
    sections = (
        counts.agg(F.max("row_count").alias("total_rows"), F.count("*").alias("total_columns"))
        .crossJoin(packed(counts, "summary"))
        .crossJoin(packed(correlations(df), "correlations"))
        .crossJoin(packed(outliers(df), "outliers"))
    )
    document = F.struct(
        F.struct(F.lit(name).alias("dataset_name"), "total_rows", "total_columns").alias("metadata"),
        "summary",
        F.struct("correlations", "outliers").alias("analysis"),
    )
    return sections.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("report"))


@dataclass
class Report:
    """The sections of the comprehensive report, each a DataFrame."""

    domain: str
    profile: DataFrame
    types: DataFrame
    key_fields: DataFrame
    quality: DataFrame
    kpis: DataFrame
    insights: DataFrame
    charts: dict[str, DataFrame]
    segmentation: DataFrame | None
    correlations: DataFrame | None
    trends: DataFrame | None
    anomalies: DataFrame | None


def report_charts(df: DataFrame, profile: DataFrame, order_by) -> dict[str, DataFrame]:
    """The charts that the columns allow, at most six: only those that exist."""
    small = _categorical() & (F.col("unique_count") <= 20)
    categories = names_of(profile, small)
    few = names_of(profile, small & (F.col("unique_count") <= charts.PIE_SLICES))
    numbers = names_of(profile, _numeric())
    dates = names_of(profile, F.col("detected_type") == "datetime")
    made: dict[str, DataFrame] = {}
    if categories:
        made[f"{categories[0]} Distribution"] = charts.category_bars(df, categories[0])
        if categories[0] in few:
            made[f"{categories[0]} Breakdown"] = charts.category_pie(df, categories[0])
    if dates and numbers:
        made[f"{numbers[0]} Trend Over Time"] = charts.monthly_line(df, dates[0], numbers[0])
    if len(numbers) >= 2:
        made[f"{numbers[0]} vs {numbers[1]}"] = charts.scatter_points(df, numbers[0], numbers[1], order_by)
    if categories and numbers:
        made[f"Average {numbers[0]} by {categories[0]}"] = charts.average_bars(df, categories[0], numbers[0])
    if numbers:
        made[f"{numbers[0]} Histogram"] = charts.histogram_bars(df, numbers[0])
    return made


def comprehensive_report(df: DataFrame, order_by) -> Report:
    """Everything at once. The profile is computed once; each section stays lazy."""
    profile = settled_profile(df, order_by, REPORT)
    domain = table_domain(df, REPORT_DOMAIN_WORDS)
    numbers = names_of(profile, _numeric())
    categories = names_of(profile, _categorical())
    dates = names_of(profile, F.col("detected_type") == "datetime")
    physical = [c for c in numeric_columns(df) if c in numbers]
    return Report(
        domain=domain,
        profile=profile,
        types=type_counts(profile),
        key_fields=key_fields(profile),
        quality=data_quality(df, profile),
        kpis=report_kpis(profile),
        insights=report_insights(df, profile, domain),
        charts=report_charts(df, profile, order_by),
        segmentation=segmentation(df, categories, numbers) if categories and numbers else None,
        correlations=strong_pairs(df, physical, above=0.5, strong=0.7, limit=5) if len(physical) >= 2 else None,
        trends=report_trends(df, numbers, dates[0]) if dates and numbers else None,
        anomalies=anomalies(df, numbers, order_by) if numbers else None,
    )
