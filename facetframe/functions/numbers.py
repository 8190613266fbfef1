"""Numbers out of text. Every cast of dirty text is a `try_cast`: ANSI mode is on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from facetframe.functions.text import strip

INFINITY = float("inf")
BRACKET = "\u0001"
DECIMAL_GRAMMAR = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
FLOAT_GRAMMAR = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))$"


def finite(c: Column) -> Column:
    """NaN and the infinities become null."""
    return F.when(F.abs(c) < F.lit(INFINITY), c)


def without_nan(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def formatted_number(c: Column) -> Column:
    """Currency, grouping, percent signs and accounting brackets dropped."""
    text = strip(c)
    text = F.when(~text.isin("", "nan", "None", "null"), text)
    text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    return F.regexp_replace(text, r"[^0-9.\-+]", "").try_cast("double")


def plain_number(c: Column) -> Column:
    """A number literal, `nan` and `inf` included; the grammar keeps `12d` and `1f` out of the cast."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(FLOAT_GRAMMAR), text.try_cast("double"))


def _whole_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def strict_number(c: Column) -> Column:
    """Only a plain finite literal (grouping commas allowed) is a number.

    The grammar guards the cast, which alone would also take `12d`, `NaN`
    and `1e400`. Prefixed base-2, -8 and -16 integers are accepted.
    """
    raw = F.replace(strip(c), F.lit(","), F.lit(""))
    prefixed = [
        F.conv(_whole_match(raw, pattern, 1), base, 10).try_cast("double")
        for pattern, base in (
            (r"^0[xX]([0-9a-fA-F]{1,15})$", 16),
            (r"^0[oO]([0-7]{1,20})$", 8),
            (r"^0[bB]([01]{1,60})$", 2),
        )
    ]
    return F.coalesce(finite(_whole_match(raw, DECIMAL_GRAMMAR).try_cast("double")), *prefixed)


def lenient_number(c: Column, blank: float | None = None) -> Column:
    """Brackets mean negative, everything but digits and signs is dropped.

    `blank` is the value of a non-empty text that holds no digits or signs.
    Brackets are first turned into one mark, so that the text is written once
    in the expression and not in each branch of a sign rule.
    """
    marked = F.regexp_replace(strip(c), r"(?s)^\((.*)\)$", f"{BRACKET}$1")
    kept = F.regexp_replace(marked, rf"[^0-9.\-+{BRACKET}]", "")
    number = finite(F.regexp_replace(kept, f"^{BRACKET}-?", "-").try_cast("double"))
    if blank is None:
        return number
    nothing = kept.rlike(f"^{BRACKET}?$") & (strip(c) != "")
    return F.when(nothing, F.lit(float(blank))).otherwise(number)


def chart_number(c: Column) -> Column:
    return F.coalesce(lenient_number(c), F.lit(0.0))


def safe_float(c: Column, default: float = 0.0) -> Column:
    """Null, NaN and text become the default."""
    return F.coalesce(without_nan(plain_number(c)), F.lit(float(default)))
