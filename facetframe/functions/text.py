"""Text column expressions. All are built-in functions; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\u000b\u000c ﻿"

LONG_TEXT = 64


def strip(c: Column) -> Column:
    """Trim white space of every kind, not only the space character."""
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def is_long(c: Column) -> Column:
    return F.length(c) > LONG_TEXT


def short_form(c: Column) -> Column:
    """The text itself, or the digest of a long one: what a shuffle should carry."""
    return F.when(is_long(c), F.sha2(c, 256)).otherwise(c)


def key_form(c: Column) -> Column:
    """`Unit Price ($)` -> `unit_price`."""
    lowered = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def question_form(c: Column) -> Column:
    """Lower case, `_` and `-` as spaces, punctuation dropped, single spaces."""
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    text = F.regexp_replace(text, "[_-]+", " ")
    text = F.regexp_replace(text, r"[^\w\s]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def link_form(c: Column) -> Column:
    """Lower case, every character but letters and digits as a space."""
    lowered = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]", " "))


def value_form(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def spaced_form(c: Column) -> Column:
    """Trimmed, lower case, white space runs as one space; punctuation stays."""
    return F.regexp_replace(value_form(c), r"\s+", " ")


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def known_label(c: Column) -> Column:
    """Group label; missing and blank become `Unknown`."""
    return F.coalesce(blank_to_null(c), F.lit("Unknown"))


def grouped_number(c: Column, digits: int = 2) -> Column:
    return F.format_number(c, digits)


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(c, digits), F.lit("%"))
