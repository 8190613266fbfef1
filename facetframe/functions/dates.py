"""Dates and periods out of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from facetframe.functions.text import strip

# The date shapes that mark a text column as dates.
DATE_SHAPES = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}")
REPORT_DATE_SHAPES = DATE_SHAPES + (r"\d{4}/\d{2}/\d{2}",)

# A text is given to a parser only if it has the parser's shape: a failed parse
# costs an exception, which a column of ordinary text would pay on every row.
PARSE_FORMATS = {
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "MM-dd-yyyy": r"^\d{2}-\d{2}-\d{4}$",
    # A first part over 12 can only be the day.
    "dd/MM/yyyy": r"^(?:1[3-9]|2\d|3[01])/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^(?:1[3-9]|2\d|3[01])-\d{2}-\d{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Z][a-z]{2} \d{4}$",
}
MONTH_FIRST_FORMATS = {f: shape for f, shape in PARSE_FORMATS.items() if not f.startswith("dd")}
# For columns that write the day first.
DAY_FIRST_FORMATS = {f: shape for f, shape in PARSE_FORMATS.items() if f not in ("MM/dd/yyyy", "MM-dd-yyyy")} | {
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{2}-\d{2}-\d{4}$",
}
PARTS_SHAPE = r"^(\d{2})[/-](\d{2})[/-]\d{4}$"
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}(?:[T ].*)?$"
YEAR_SHAPE = r"^\d{4}$"


def looks_like_date(c: Column, shapes=DATE_SHAPES) -> Column:
    """The text starts with one of the date shapes."""
    return strip(c).rlike("^(?:" + "|".join(shapes) + ")")


def parse_date(c: Column, formats=PARSE_FORMATS) -> Column:
    """Timestamp of a date text; a bare four-digit year is its first of January, what cannot be read is null.

    `formats` maps each further format to the shape of the texts it is tried on.
    """
    text = strip(c)
    iso = F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))
    shaped = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in formats.items()]
    year = F.when(text.rlike(YEAR_SHAPE), F.concat(text, F.lit("-01-01")).try_cast("timestamp"))
    return F.coalesce(iso, year, *shaped)


def lenient_timestamp(c: Column, formats=MONTH_FIRST_FORMATS) -> Column:
    """As `parse_date`, but parts between slashes are always month first."""
    return parse_date(c, formats)


def day_first(c: Column) -> Column:
    """Aggregate: whether a column of dates in parts writes the day first.

    It does if some first part is over 12, so that it can only be a day, and no second
    part is. Without such a cell, or with both kinds, the answer is no.
    """
    text = strip(c)
    first, second = (F.regexp_extract(text, PARTS_SHAPE, i).try_cast("int") for i in (1, 2))
    return F.coalesce(F.bool_or(first > 12), F.lit(False)) & ~F.coalesce(F.bool_or(second > 12), F.lit(False))


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def year_rows(c: Column) -> Column:
    """Predicate: the cell is exactly a four-digit year."""
    return c.cast("string").rlike(YEAR_SHAPE)


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)
