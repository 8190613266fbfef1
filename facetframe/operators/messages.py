"""Tagging a table of user messages with the question rules.

Rules over the text alone are column expressions. Rules that look for column
names or values test each message against a catalog; a catalog is bounded by
the schema (or by 24 values per column) and travels as one array, so no join
of messages with names is ever materialised.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.functions.text import key_form, link_form, question_form, spaced_form, strip, value_form
from facetframe.operators.frames import cell, long_cells, order_columns, with_one_row
from facetframe.operators.profile import column_counts

# The words of each rule, in the order they are tried.
TREND_WORDS = "trend|timeline|over time|monthly|daily|yearly|by month|by year"
SERVER_INTENTS = (
    ("correlation", "scatter|correlation|relationship"),
    ("trend", TREND_WORDS),
    ("comparison", "compare|comparison|versus|vs"),
    ("distribution", "distribution|breakdown|share|split|pie"),
    ("aggregation", "sum|total|revenue|sales|amount"),
    ("aggregation", "avg|average|mean"),
    ("count", "count|how many|number of"),
)
BROWSER_INTENTS = (
    ("correlation", "scatter|correlation|relationship"),
    ("trend", TREND_WORDS),
    ("comparison", "compare|comparison|versus|vs"),
    ("distribution", "distribution|breakdown|share|split|pie"),
    ("aggregation", "sum|total|average|avg|max|min|highest|lowest|top|count"),
    ("filter", "where|only|with|after|before|between"),
)
LOCAL_INTENTS = (
    ("comparison", "vs|versus|compare|comparison"),
    ("trend", "trend|over time|timeline|by year|by month"),
    ("filter", "after|before|since|only|where|with"),
)
SERVER_METRICS = (
    ("average", "avg|average|mean"),
    ("min", "min|lowest|smallest|least"),
    ("max", "max|highest|largest|top|most"),
    ("sum", "sum|total|revenue|sales|amount"),
)
BROWSER_METRICS = (
    ("sum", "sum|total"),
    ("average", "avg|average|mean"),
    ("max", "max|highest|top|largest|most"),
    ("min", "min|lowest|smallest|least"),
)
LOCAL_METRICS = (
    ("average", "avg|average|mean"),
    ("max", "max|highest|largest|top|most"),
    ("min", "min|lowest|least|smallest"),
)
SQL_SHAPES = (
    ("count", "how many|count|total number|number of"),
    ("top", "top|highest|most|largest|greatest|best|maximum"),
    ("bottom", "bottom|lowest|least|smallest|minimum|worst"),
    ("average", "average|avg|mean"),
    ("sum", "sum|total|combined"),
    ("distribution", "distribution|breakdown|group|by each|per|by"),
    ("comparison", "vs|versus|compare|comparison|difference between"),
)
# Names and message words that stand for one another.
ALIASES = {
    "name": ("name", "title", "label", "description"),
    "date": ("date", "time", "timestamp", "created", "updated", "year", "month", "day"),
    "amount": ("amount", "total", "sum", "value", "price", "cost", "revenue", "sales"),
    "count": ("count", "quantity", "number", "num", "qty"),
    "category": ("category", "type", "kind", "class", "group", "genre"),
    "status": ("status", "state", "condition", "active", "enabled"),
    "location": ("country", "city", "state", "region", "location", "address", "place"),
    "person": ("user", "customer", "employee", "student", "player", "author", "name"),
    "id": ("id", "identifier", "code", "key"),
    "rating": ("rating", "score", "grade", "rank", "stars"),
}
LOCAL_ALIASES = {
    "country": ("country", "countries", "nation", "region", "location"),
    "type": ("type", "content type", "category", "format"),
    "release_year": ("release year", "year", "release", "released"),
    "rating": ("rating", "rated", "certificate"),
    "date": ("date", "time", "month"),
}


def first_rule(text: Column, rules, otherwise: str, extra: Sequence[tuple[str, str, str]] = ()) -> Column:
    """Label of the first rule with a word in the text, which is searched once.

    `extra` adds (word, pattern, label) for a word with a condition of its own.
    """
    turns: dict[str, int] = {}
    labels: list[str] = []
    for label, words in rules:
        labels.append(label)
        for word in words.split("|"):
            turns.setdefault(word, len(labels))
    patterns = sorted(turns, key=len, reverse=True)
    # A search takes the longest word at a place and goes on behind it, so a
    # shorter word inside must not belong to an earlier rule.
    for long in turns:
        for short in turns:
            if short != long and re.search(rf"\b{short}\b", long) and turns[short] < turns[long]:
                raise ValueError(f"rule of {short!r} would be hidden by {long!r}")
    for word, pattern, label in extra:
        turns[word] = labels.index(label) + 1
        patterns.append(pattern)
    found = F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9_])({'|'.join(patterns)})(?![A-Za-z0-9_])"), F.lit(1))
    lookup = F.create_map(*[F.lit(x) for pair in turns.items() for x in pair])
    first = F.array_min(F.transform(found, lambda word: lookup[word]))
    return F.coalesce(F.get(F.array(*[F.lit(label) for label in labels]), first - 1), F.lit(otherwise))


def intent(message: Column, rules: str = "server") -> Column:
    if rules == "server":
        return first_rule(value_form(message), SERVER_INTENTS, "overview")
    if rules == "browser":
        text = spaced_form(message)
        asked = F.when(text.contains("?"), "question").otherwise("overview")
        return F.coalesce(F.nullif(first_rule(text, BROWSER_INTENTS, ""), F.lit("")), asked)
    # "in" counts only in front of another word.
    inside = ("in", "in(?= [a-z0-9_])", "filter")
    return first_rule(question_form(message), LOCAL_INTENTS, "aggregation", [inside])


def metric(message: Column, rules: str = "server") -> Column:
    if rules == "server":
        return first_rule(value_form(message), SERVER_METRICS, "count")
    if rules == "browser":
        return first_rule(spaced_form(message), BROWSER_METRICS, "count")
    return first_rule(question_form(message), LOCAL_METRICS, "count")


def chart_hint(message: Column, rules: str = "browser") -> Column:
    """The chart a message names, or null."""
    order = ("scatter", "pie", "line", "area", "bar") if rules == "browser" else ("pie", "line", "scatter", "area")
    text = spaced_form(message) if rules == "browser" else value_form(message)
    chain = F.when(text.contains(order[0]), order[0])
    for word in order[1:]:
        chain = chain.when(text.contains(word), word)
    return chain


def sql_shape(message: Column) -> Column:
    """Which grouped or top-n question a message is; `default` if none."""
    text = value_form(message)
    return first_rule(text, SQL_SHAPES, "default")


def asked_limit(message: Column, default: int = 5) -> Column:
    """The first whole number of the message if it lies in 1..100."""
    digits = F.regexp_extract(value_form(message), r"(?<![A-Za-z0-9_])(\d+)(?![A-Za-z0-9_])", 1)
    number = digits.try_cast("int")
    return F.when(number.between(1, 100), number).otherwise(default)


def year_after(message: Column) -> tuple[Column, Column]:
    """(operator, year) of `after Y` (gt) or `since Y` (gte); null if absent."""
    text = question_form(message)
    pattern = r"(?<![a-z0-9_])(after|since)\s+(\d{4})(?![a-z0-9_])"
    word = F.regexp_extract(text, pattern, 1)
    operator = F.when(word == "since", "gte").when(word == "after", "gt")
    return operator, F.regexp_extract(text, pattern, 2).try_cast("int")


def year_before(message: Column) -> Column:
    pattern = r"(?<![a-z0-9_])before\s+(\d{4})(?![a-z0-9_])"
    return F.regexp_extract(question_form(message), pattern, 1).try_cast("int")


def compared_pair(message: Column) -> tuple[Column, Column]:
    """The two sides of `a vs b`, filler words dropped; null where there is none."""
    # The text begins and ends in a word, so a match spans all of it: anchored,
    # the search does not start anew at every word.
    text = question_form(message)
    pattern = r"^(.+?)\s+(?:vs|versus)\s+(.+)$"

    def side(group: int) -> Column:
        raw = F.regexp_extract(text, pattern, group)
        bare = F.regexp_replace(raw, r"(?<![a-z0-9_])(?:compare|show|between)(?![a-z0-9_])", "")
        return F.nullif(F.trim(bare), F.lit(""))

    return side(1), side(2)


# ---------------------------------------------------------------- mentions


def _catalog(names: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("column")) for i, n in enumerate(names)])


def _mentioned(messages: DataFrame, names: Sequence[str], test, keep: Sequence[str]) -> DataFrame:
    found = F.transform(F.filter(_catalog(names), test), lambda e: e["column"])
    return messages.select(*[cell(k) for k in keep], F.explode(found).alias("column"))


def column_mentions(
    messages: DataFrame, text: str, names: Sequence[str], keep: Sequence[str], rules: str = "server"
) -> DataFrame:
    """(keep..., column): columns whose name a message holds.

    `server` compares key forms, with and without `_`; `linker` also takes
    all words of the name in any place; `browser` wants the name as written.
    """
    forms = {"server": key_form, "linker": link_form, "browser": spaced_form}
    form = forms[rules]
    prepared = messages.withColumn("_text", form(cell(text)))

    def test(entry: Column) -> Column:
        name = form(entry["column"])
        direct = F.col("_text").contains(name)
        if rules == "server":
            return direct | F.col("_text").contains(F.replace(name, F.lit("_"), F.lit("")))
        if rules == "linker":
            words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
            return direct | ((F.size(words) > 1) & F.forall(words, lambda w: F.col("_text").contains(w)))
        return direct

    return _mentioned(prepared, names, test, keep)


def alias_mentions(
    messages: DataFrame, text: str, names: Sequence[str], keep: Sequence[str], rules: str = "server"
) -> DataFrame:
    """(keep..., column, alias): columns meant by a word of the same alias group.

    The first group in order that both the name and the message hold counts.
    """
    groups = ALIASES if rules == "server" else LOCAL_ALIASES
    form = link_form if rules == "server" else question_form
    linked = []
    for i, name in enumerate(names):
        plain = re.sub("[^a-z0-9]", " ", name.lower()).strip()
        for turn, (group, words) in enumerate(groups.items()):
            if rules == "server":
                triggers = list(words) if any(w in plain for w in words) else []
            else:
                triggers = [w for w in words if w in plain or plain in w]
            if triggers:
                linked.append((i, name, turn, group, triggers))
    if not linked:
        raise ValueError("no column belongs to an alias group")
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                F.lit(turn).alias("turn"),
                F.lit(group).alias("alias"),
                F.array(*[F.lit(t) for t in triggers]).alias("triggers"),
            )
            for i, name, turn, group, triggers in linked
        ]
    )
    prepared = messages.withColumn("_text", form(cell(text)))
    hits = F.filter(entries, lambda e: F.exists(e["triggers"], lambda t: F.col("_text").contains(t)))
    # Keep the first group of each column: no earlier hit names the same column.
    firsts = F.filter(
        F.col("_hits"),
        lambda e: ~F.exists(
            F.col("_hits"), lambda o: (o["position"] == e["position"]) & (o["turn"] < e["turn"])
        ),
    )
    named = F.transform(firsts, lambda e: F.struct(e["column"].alias("column"), e["alias"].alias("alias")))
    return prepared.withColumn("_hits", hits).select(*[cell(k) for k in keep], F.inline(named))


def low_cardinality_values(df: DataFrame, columns: Sequence[str], at_most: int = 24) -> DataFrame:
    """(column, value): distinct non-blank values of columns that have few.

    The columns are chosen by their exact counts (one row per column reaches
    the driver), which shuffle digests of long texts; only the values of the
    chosen ones, `at_most` each, are then gathered. The server's rule takes 24
    values, the browser's 20 and text columns alone.
    """
    counts = column_counts(df, columns, blank_is_missing=True)
    few = [r["column"] for r in counts.where(F.col("unique_count") <= at_most).collect()]
    if not few:
        return df.sparkSession.createDataFrame([], "column string, value string")
    cells = long_cells(df, few).select("column", strip(F.col("value")).alias("value"))
    return cells.where(F.col("value") != "").distinct()


def value_mentions(
    messages: DataFrame, text: str, values: DataFrame, keep: Sequence[str], rules: str = "server"
) -> DataFrame:
    """(keep..., column, value): a value of each column that a message holds.

    `server` takes the first value by name, `browser` the longest one and
    compares without punctuation; a value that is one side of `a vs b` is no
    mention there.
    """
    form = value_form if rules == "server" else question_form
    width = F.length("value") if rules == "browser" else F.lit(0)
    listed = values.groupBy("column").agg(
        F.sort_array(
            F.collect_list(F.struct((-width).alias("rank"), F.col("value").alias("value"), form(F.col("value")).alias("form")))
        ).alias("entries")
    )
    catalog = listed.agg(F.collect_list(F.struct("column", "entries")).alias("_catalog"))
    prepared = with_one_row(messages.withColumn("_text", form(cell(text))), catalog)
    hits = F.transform(
        F.col("_catalog"),
        lambda c: F.struct(
            c["column"].alias("column"),
            F.get(F.filter(c["entries"], lambda e: F.col("_text").contains(e["form"])), F.lit(0))["value"].alias("value"),
        ),
    )
    if rules == "browser":
        sides = F.array(*[question_form(side) for side in compared_pair(cell(text))])
        found = prepared.select(*[cell(k) for k in keep], sides.alias("_sides"), F.inline(hits))
        compared = F.exists("_sides", lambda side: side.eqNullSafe(question_form(F.col("value"))))
        found = found.where(~compared).drop("_sides")
    else:
        found = prepared.select(*[cell(k) for k in keep], F.inline(hits))
    return found.where(F.col("value").isNotNull())


def recent_topics(
    messages: DataFrame,
    key: str,
    order_by,
    role: str = "role",
    text: str = "text",
    last: int = 4,
    topics: int = 6,
) -> DataFrame:
    """(key, topics): first words of over three letters in the last user messages of each key."""
    order = F.struct(*order_columns(order_by))
    recent = (
        messages.where(cell(role) == "user")
        .select(cell(key), order.alias("_at"), cell(text).alias("_text"))
        .withColumn("_back", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_at"))))
        .where(F.col("_back") <= last)
    )
    words = recent.select(key, "_back", F.posexplode(F.split("_text", r"\s+")).alias("_pos", "_raw")).select(
        key,
        F.struct((-F.col("_back")).alias("m"), F.col("_pos").alias("p")).alias("_seen"),
        F.lower(F.regexp_replace("_raw", r"[^A-Za-z0-9_]", "")).alias("_word"),
    )
    firsts = words.where(F.length("_word") > 3).groupBy(key, "_word").agg(F.min("_seen").alias("_seen"))
    return (
        firsts.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy("_seen")))
        .where(F.col("_rank") <= topics)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "_word"))).alias("_ranked"))
        .select(key, F.col("_ranked._word").alias("topics"))
    )
