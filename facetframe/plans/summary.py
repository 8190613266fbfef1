"""Short summary of a table of cells: the first measure and the first category, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from facetframe.functions.numbers import finite, plain_number
from facetframe.operators.frames import cell, numeric_columns

UNKNOWN = "Unknown"


def _two_places(c: Column) -> Column:
    """Two decimals; only odd eighths are ties in binary, and they go away from zero."""
    eighths = c * 8
    tie = (eighths == F.floor(eighths)) & (F.abs(eighths) % 2 == 1)
    return F.replace(F.format_number(F.when(tie, F.round(c, 2)).otherwise(c), 2), F.lit(","), F.lit(""))


def column_figures(df: DataFrame) -> DataFrame:
    """(position, column, row_count, filled, numbers, sum, min, max), a row per column, by one scan.

    A cell is filled unless it is null or empty; it is a number if it is a finite
    literal, so a blank cell is filled and no number. Cells of all columns are rows of one
    group-by that only passes partial sums on.
    """
    physical = set(numeric_columns(df))
    cells = []
    for i, field in enumerate(df.schema.fields):
        text = isinstance(field.dataType, T.StringType)
        filled = cell(field.name).isNotNull() & ((cell(field.name) != "") if text else F.lit(True))
        number = cell(field.name).cast("double") if field.name in physical else plain_number(cell(field.name)) if text else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(i).alias("position"), filled.alias("filled"), finite(number).alias("number")))
    names = F.array(*[F.lit(c) for c in df.columns])
    rows = df.select(F.inline(F.array(*cells))).groupBy("position")
    return rows.agg(
        F.count("*").alias("row_count"),
        F.count_if("filled").alias("filled"),
        F.count("number").alias("numbers"),
        F.sum("number").alias("sum"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    ).select("position", F.get(names, F.col("position")).alias("column"), "row_count", "filled", "numbers", "sum", "min", "max")


def summary_insights(df: DataFrame, top: int = 3) -> DataFrame:
    """(place, message): average and range of the first measure, the top values of the first category.

    A column is a measure if every filled cell is a number and there is one, else a
    category. Empty and null cells of the category count as ``Unknown``; of equally
    frequent values the least goes first. A table without rows says nothing.
    """
    # One row per column comes to the driver; it names the two columns that are told of.
    figures = sorted(column_figures(df).collect()) if df.columns else []
    measures = [f for f in figures if f["numbers"] == f["filled"] > 0]
    categories = [f for f in figures if f not in measures]
    spark = df.sparkSession
    parts = []
    if measures:
        f = measures[0]
        one = spark.range(1).select(*[F.lit(float(f[c])).alias(c) for c in ("sum", "min", "max")])
        mean = F.format_string("%s has an average value of %s across %d rows.", F.lit(f["column"]), _two_places(F.col("sum") / f["numbers"]), F.lit(f["row_count"]))
        span = F.format_string("%s ranges from %s to %s.", F.lit(f["column"]), _two_places(F.col("min")), _two_places(F.col("max")))
        parts += [one.select(F.lit(0).alias("place"), mean.alias("message")), one.select(F.lit(1).alias("place"), span.alias("message"))]
    if categories:
        name = categories[0]["column"]
        value = F.coalesce(F.nullif(cell(name).cast("string"), F.lit("")), F.lit(UNKNOWN))
        most = df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
        # At most `top` rows are listed.
        ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value")))
        listed = F.array_join(F.transform(ranked, lambda r: F.format_string("%s (%d)", r["value"], -r["n"])), ", ")
        said = most.agg(listed.alias("listed")).select(F.lit(2).alias("place"), F.format_string("Top %s values: %s.", F.lit(name), F.col("listed")).alias("message"))
        parts.append(said)
    if not parts:
        return spark.createDataFrame([], "place int, message string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("place")
