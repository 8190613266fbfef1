"""Header and row cleaning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from facetframe.functions.dates import DAY_FIRST_FORMATS, day_first, parse_date
from facetframe.functions.numbers import plain_number, without_nan
from facetframe.functions.text import LONG_TEXT, is_long, short_form
from facetframe.operators.frames import cell, long_cells, order_columns, text_columns


def clean_name(name: str, legacy: bool = False) -> str:
    if legacy:
        return re.sub(r"[\s\-]+", "_", name).lower().strip("_")
    return name.strip().replace(" ", "_").replace("-", "_")


def clean_headers(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Names made fit for SQL. Two names that become one are an error."""
    names = [clean_name(c, legacy) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"columns collide after cleaning: {clashes}")
    return df.toDF(*names)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN in numbers and empty text become null, once, at load."""

    def fix(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(cell(field.name)), cell(field.name)).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return F.nullif(cell(field.name), F.lit("")).alias(field.name)
        return cell(field.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def coerce_numeric_columns(df: DataFrame) -> DataFrame:
    """A text column becomes double if every value it holds parses.

    One aggregate looks at all text columns; only its one row of flags
    reaches the driver.
    """
    texts = text_columns(df)
    if not texts:
        return df
    flags = df.agg(
        *[
            ((F.count_if(cell(c).isNotNull() & plain_number(cell(c)).isNull()) == 0) & (F.count(cell(c)) > 0)).alias(c)
            for c in texts
        ]
    ).first()
    return df.select(
        *[plain_number(cell(c)).alias(c) if c in texts and flags[c] else cell(c) for c in df.columns]
    )


def meaningful_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose every cell is missing or one of the empty words."""
    filled = [
        cell(c).isNotNull() & ~cell(c).cast("string").isin("", "null", "undefined") for c in df.columns
    ]
    return df.where(reduce(lambda a, b: a | b, filled))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that hold a value (null and NaN are none) in each chosen column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def filled(c: str) -> Column:
        floating = isinstance(kinds[c], (T.DoubleType, T.FloatType))
        return without_nan(cell(c)).isNotNull() if floating else cell(c).isNotNull()

    return df.where(reduce(lambda a, b: a & b, [filled(c) for c in columns]))


def sample_values(df: DataFrame, columns: Sequence[str], k: int = 5, order_by=None) -> DataFrame:
    """(column, samples): up to k distinct values of each column.

    With `order_by` the values seen first, else the smallest. The limit per
    column is pushed below the shuffle of the ranking, so no list is longer
    than k. Long texts are ranked by a digest or by their first characters;
    only those that make the list are read again in full.
    """
    ranked = _first_seen(df, columns, k, order_by) if order_by is not None else _smallest(df, columns, k)
    return (
        ranked.groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "value"))).alias("_ranked"))
        .select("column", F.col("_ranked.value").alias("samples"))
    )


def _first_seen(df: DataFrame, columns: Sequence[str], k: int, order_by) -> DataFrame:
    keyed = df.withColumn("_at", F.struct(*order_columns(order_by)))
    cells = long_cells(keyed, columns, keep=["_at"]).where(F.col("value").isNotNull())
    marked = cells.select("*", short_form(F.col("value")).alias("_key"), is_long(F.col("value")).alias("_long"))
    rank = W.partitionBy("column").orderBy("_at", "_key")
    firsts = (
        marked.groupBy("column", "_key", "_long")
        .agg(F.min("_at").alias("_at"))
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= k)
    )
    short = firsts.where(~F.col("_long")).select("column", "_rank", F.col("_key").alias("value"))
    wanted = firsts.where("_long").select("column", "_key", "_at", "_rank")
    long = (
        marked.where("_long")
        .join(F.broadcast(wanted), ["column", "_key", "_at"])
        .groupBy("column", "_rank")
        .agg(F.min("value").alias("value"))
    )
    return short.unionByName(long)


def _smallest(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    cells = long_cells(df, columns).where(F.col("value").isNotNull())
    start = F.substring("value", 1, LONG_TEXT)
    marked = cells.select("*", start.alias("_key"), is_long(F.col("value")).alias("_long"))
    # A start comes before all longer texts that share it, so the first k groups
    # hold the first k values.
    rank = W.partitionBy("column").orderBy("_key", "_long")
    groups = (
        marked.select("column", "_key", "_long")
        .distinct()
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= k)
    )
    short = groups.where(~F.col("_long")).select("column", F.col("_key").alias("value"))
    wanted = groups.where("_long").select("column", "_key")
    long = marked.where("_long").join(F.broadcast(wanted), ["column", "_key"]).select("column", "value").distinct()
    order = W.partitionBy("column").orderBy("value")
    return (
        short.unionByName(long).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    )


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of dates to timestamps, each column by one order of day and month.

    One scan tells the order of all columns; it is one row. Columns that show no order,
    or both, are read cell by cell, month first where a cell leaves it open. What
    cannot be read is null.
    """
    if not columns:
        return df
    told = df.agg(*[day_first(cell(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    parsed = {
        c: parse_date(cell(c).cast("string"), DAY_FIRST_FORMATS) if told[f"c{i}"] else parse_date(cell(c).cast("string"))
        for i, c in enumerate(columns)
    }
    return df.select(*[parsed[c].alias(c) if c in parsed else cell(c) for c in df.columns])
