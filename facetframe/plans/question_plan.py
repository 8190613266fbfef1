"""What each message of a table asks for: metric, measure, dimension, time and group column.

The columns of the asked table are a catalogue of one row per column. It goes beside
every message as one sorted list; each choice is the least (rule, place) among the
columns, so a message costs one pass over the catalogue and no join per rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.functions.text import key_form, question_form
from facetframe.operators.frames import cell, with_one_row

# Words that ask for a metric, in the order in which they count; the rest asks for a count.
METRIC_WORDS = (
    ("average", "avg|average|mean"),
    ("min", "min|lowest|smallest|least"),
    ("max", "max|highest|largest|top|most"),
    ("sum", "sum|total|revenue|sales|amount"),
)
# Name parts of columns that hold a time, and words that ask for a column of that name.
TIME_PARTS = "(year|date|month|day|time)"
GROUP_WORDS = ("country", "type", "rating")


def metric_of(text: Column) -> Column:
    out = F.lit("count")
    lowered = F.lower(text)
    for name, words in reversed(METRIC_WORDS):
        out = F.when(lowered.rlike(rf"\b({words})\b"), name).otherwise(out)
    return out


def _first(rank) -> Column:
    """Name of the catalogue column with the least rank; a null rank is no choice."""
    ranked = F.transform("_columns", lambda c: F.struct(rank(c).alias("rank"), c["position"].alias("position"), c["column"].alias("column")))
    return F.array_min(F.filter(ranked, lambda c: c["rank"].isNotNull()))["column"]


def question_plans(messages: DataFrame, text: str, catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., metric, measure, dimension, time, grouped_by) of every message.

    `catalog` has position, column, role (measure, dimension, time or identifier),
    detected_type, unique_count and row_count, as `with_roles` gives them. A measure
    or dimension that the message names goes before the first one of the table; a time
    column before no dimension, but a named one before one not named. The group column
    is a named one; else one that one of the group words asks for (or the first that is
    no number and no identifier, if there is none of that name); else the one with the
    fewest values. A null message names nothing; choices without a candidate are null.
    """
    few = F.greatest(F.lit(12), F.ceil(F.col("row_count") * 0.5))
    listed = catalog.select(
        "position",
        "column",
        "role",
        "unique_count",
        (F.col("detected_type") == "numeric").alias("numeric"),
        (F.col("unique_count") <= few).alias("few"),
        key_form(F.col("column")).alias("key"),
        question_form(F.col("column")).alias("form"),
    )
    # One entry per column of the table.
    columns = listed.agg(F.array_sort(F.collect_list(F.struct(*listed.columns))).alias("_columns"))
    asked = messages.select(
        *[cell(k) for k in keep],
        metric_of(F.coalesce(cell(text), F.lit(""))).alias("metric"),
        key_form(cell(text)).alias("_key"),
        question_form(F.coalesce(cell(text), F.lit(""))).alias("_form"),
    )
    rows = with_one_row(asked, columns)
    named = lambda c: F.col("_key").contains(c["key"])
    said = lambda c: F.col("_form").contains(c["form"])
    dated = lambda c: c["form"].rlike(TIME_PARTS)
    measure = _first(lambda c: F.when(c["role"] == "measure", F.when(named(c), 0).otherwise(1)))
    dimension = _first(
        lambda c: F.when(c["role"] == "dimension", F.when(named(c), 0).otherwise(2)).when(
            c["role"] == "time", F.when(named(c), 1).otherwise(3)
        )
    )
    time = _first(lambda c: F.when(dated(c), F.when(said(c), 0).otherwise(1)))

    def group_rank(c: Column) -> Column:
        rank = F.when(said(c), F.lit(0).cast("long"))
        word_asked = F.lit(False)
        for i, word in enumerate(GROUP_WORDS):
            asks = F.col("_form").rlike(rf"\b{word}\b") & ~word_asked
            rank = rank.when(asks & F.lower(c["column"]).contains(word), 1)
            word_asked = word_asked | F.col("_form").rlike(rf"\b{word}\b")
        plain = ~c["numeric"] & ~F.lower(c["column"]).rlike("(id|index)")
        return rank.when(word_asked & plain, 2).when(~word_asked & ~c["numeric"] & c["few"], F.lit(3) + c["unique_count"])

    return rows.select(
        *[cell(k) for k in keep],
        "metric",
        measure.alias("measure"),
        dimension.alias("dimension"),
        time.alias("time"),
        _first(group_rank).alias("grouped_by"),
    )
