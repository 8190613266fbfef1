"""Row predicates as column expressions; `where` drops what is null."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.functions.dates import year_rows
from facetframe.functions.numbers import strict_number
from facetframe.functions.text import question_form, value_form
from facetframe.operators.frames import cell

COMPARE = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
YEAR_WORDS = {"after": "gt", "since": "gte", "before": "lt"}


def number_in(df: DataFrame, column: str) -> Column:
    """The column when numeric, NaN as null; text is parsed. Whole numbers stay bare, so filters reach the scan."""
    kind = dict(df.dtypes)[column]
    if kind in ("double", "float"):
        return F.nanvl(cell(column), F.lit(None).cast(kind))
    return cell(column) if kind != "string" else strict_number(cell(column))


def equals(column: str, value: str, question_rules: bool = False) -> Column:
    """Case-blind equality of trimmed text; `question_rules` also ignores punctuation."""
    form = question_form if question_rules else value_form
    return form(cell(column)) == form(F.lit(value))


def compares(df: DataFrame, column: str, operator: str, value: float) -> Column:
    if dict(df.dtypes)[column] in ("double", "float"):
        # NaN would be the largest number; the bare comparison still reaches the scan.
        return COMPARE[operator](cell(column), F.lit(value)) & ~F.isnan(cell(column))
    return COMPARE[operator](number_in(df, column), F.lit(value))


def apply_filters(df: DataFrame, conditions: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Conjunction of (column, operator, value) conditions."""
    predicates = [
        equals(column, str(value)) if operator == "eq" else compares(df, column, operator, float(value))
        for column, operator, value in conditions
    ]
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def year_range(df: DataFrame, column: str, word: str, year: int) -> DataFrame:
    """`after` is >, `since` is >=, `before` is <."""
    return df.where(compares(df, column, YEAR_WORDS[word], year))


def among(column: str, values: Sequence[str]) -> Column:
    return question_form(cell(column)).isin(*[question_form(F.lit(v)) for v in values])


def outside(value: Column, low: Column, high: Column) -> Column:
    return (value < low) | (value > high)


def four_digit_years(df: DataFrame, column: str) -> DataFrame:
    return df.where(year_rows(cell(column)))


def positive_slices(df: DataFrame, value: str = "value") -> DataFrame:
    """A pie shows only what is above zero."""
    return df.where(cell(value) > 0)
