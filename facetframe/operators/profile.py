"""Column profiles: counts, types, roles, numeric summaries, top values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from facetframe.functions.dates import DATE_SHAPES, REPORT_DATE_SHAPES, lenient_timestamp, looks_like_date
from facetframe.functions.numbers import finite, formatted_number, plain_number, strict_number, without_nan
from facetframe.functions.text import blank_to_null, key_form, short_form
from facetframe.operators.frames import (
    cell,
    kind_of,
    numeric_columns,
    order_columns,
    stacked,
    value_counts,
)
from facetframe.operators.quantiles import number_cells, quantiles_of
from facetframe.session import checkpointed

# ---------------------------------------------------------------- counts


def typed_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, b, d, s): each cell as a whole number, a double or a text, by the type of its column; c is its position."""

    def cell_of(i: int, name: str) -> Column:
        kind = df.schema[name].dataType
        whole = isinstance(kind, T.IntegralType)
        floating = isinstance(kind, (T.DoubleType, T.FloatType))
        as_type = lambda wanted, name_of: (cell(name) if wanted else F.lit(None)).cast(name_of)
        return F.struct(
            F.lit(i).alias("c"),
            as_type(whole, "bigint").alias("b"),
            as_type(floating, "double").alias("d"),
            as_type(not whole and not floating, "string").alias("s"),
        )

    return df.select(F.inline(F.array(*[cell_of(i, name) for i, name in enumerate(columns)])))


def named(per_column: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of (c, ...) with the name of the column in place of its position."""
    name = F.element_at(F.array(*[F.lit(n) for n in columns]), F.col("c") + 1)
    return per_column.select(name.alias("column"), *[x for x in per_column.columns if x != "c"])


def every_column(per_column: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of (c, ...) named, with a row of nulls for each column that has none."""
    places = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(n).alias("column")) for i, n in enumerate(columns)])
    places = places if columns else F.array().cast("array<struct<c:int,column:string>>")
    base = per_column.sparkSession.range(1).select(F.inline(places))
    # At most one row per column.
    return base.join(F.broadcast(per_column), "c", "left").drop("c")


def _typed_counts(df: DataFrame, columns: Sequence[str], text: Callable[[Column], Column], parse=None) -> DataFrame:
    """(c, b, d, s, parsed, n): each distinct cell of each column with its number, combined before the shuffle.

    Long texts become digests; what `parse` makes of such a text (whether it is
    anything) is told by `parsed`, as the digest no longer can.
    """
    cells = typed_cells(df, columns).withColumn("s", text(F.col("s")))
    short = short_form(F.col("s"))
    told = F.lit(None).cast("boolean") if parse is None else F.when(short != F.col("s"), parse(F.col("s")).isNotNull())
    return cells.select("c", "b", "d", short.alias("s"), told.alias("parsed")).groupBy("c", "b", "d", "s", "parsed").agg(F.count("*").alias("n"))


def _is_filled() -> Column:
    """Whether a typed cell holds something; not a number is nothing."""
    number = F.col("b").isNotNull() | (F.col("d").isNotNull() & ~F.isnan("d"))
    return F.coalesce(number | F.col("s").isNotNull(), F.lit(False))


def _count_fields() -> list[Column]:
    return [
        F.sum("n").alias("row_count"),
        F.sum(F.when(_is_filled(), F.col("n")).otherwise(0)).alias("filled"),
        F.sum(F.when(_is_filled(), 0).otherwise(F.col("n"))).alias("missing"),
        F.count_if(_is_filled()).alias("unique_count"),
    ]


def column_counts(df: DataFrame, columns: Sequence[str] | None = None, blank_is_missing: bool = False) -> DataFrame:
    """(column, row_count, filled, missing, unique_count), one pass for all columns.

    Numbers are counted as numbers, long texts by digest, so the shuffle carries 64
    characters for each of them and not the text.
    """
    columns = list(columns or df.columns)
    counts = _typed_counts(df, columns, blank_to_null if blank_is_missing else lambda s: s)
    return named(counts.groupBy("c").agg(*_count_fields()), columns)


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """(column, rank, value, n): the k most frequent values; ties by value."""
    counts = value_counts(df, columns) if counts is None else counts
    rank = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("column", "rank", "value", "n")
    )


def completeness(counts: DataFrame) -> DataFrame:
    """(column, completeness) with `*` for the whole table, in percent."""
    each = counts.select("column", _share(F.col("filled"), F.col("row_count")).alias("completeness"))
    whole = counts.agg(_share(F.sum("filled"), F.sum("row_count")).alias("completeness"))
    return each.unionByName(whole.select(F.lit("*").alias("column"), "completeness"))


def _share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def worst_missing(counts: DataFrame) -> DataFrame:
    """The column with the most missing cells, if there is one; ties by name."""
    return (
        counts.where(F.col("missing") > 0)
        .orderBy(F.desc("missing"), "column")
        .limit(1)
        .select("column", "missing", _share(F.col("missing"), F.col("row_count")).alias("missing_pct"))
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Second and later copies of whole rows, counted by a digest of the row."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    row = F.struct(*[(cell(c) + F.lit(0.0) if c in floating else cell(c)).alias(c) for c in df.columns])
    digest = F.unhex(F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))
    return (
        df.select(digest.alias("digest"))
        .groupBy("digest")
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


# ---------------------------------------------------------------- numeric summaries


_MOMENTS: dict[str, Callable[[Column | str], Column]] = {
    "n": F.count,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": F.stddev_samp,
    "pop_std": F.stddev_pop,
    "sum": F.sum,
    "g1": F.skewness,
    "g2": F.kurtosis,
}
NUMERIC_FIELDS = ("min", "max", "average", "median", "std", "sum")
SUMMARY = ("n", "min", "max", "mean", "std", "sum")


def parsed_cells(df: DataFrame, columns: Sequence[str], parse: Callable[[Column], Column]) -> DataFrame:
    """(c, value) rows of the numbers of all columns; texts are parsed once they are rows, by one expression."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    def cell_of(i: int, name: str) -> Column:
        number = kinds[name] == "numeric"
        return F.struct(
            F.lit(i).alias("c"),
            (cell(name) if number else F.lit(None)).cast("double").alias("d"),
            (F.lit(None) if number else cell(name)).cast("string").alias("s"),
        )

    cells = df.select(F.inline(F.array(*[cell_of(i, name) for i, name in enumerate(columns)])))
    if all(kinds[name] == "numeric" for name in columns):
        value = F.col("d")
    else:
        value = F.coalesce("d", parse(F.col("s")))
    return cells.select("c", value.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))


def numeric_aggregates(df: DataFrame, values: dict[str, Column], fields: Sequence[str] = SUMMARY) -> DataFrame:
    """(column, <fields>), unrounded, one pass for all columns. Fields: n, min, max, mean, std, pop_std, sum, g1, g2."""
    cells, names = number_cells(df, values)
    found = cells.groupBy("c").agg(*[_MOMENTS[field]("value").alias(field) for field in fields])
    return every_column(found, names).select(
        "column", *[F.coalesce(f, F.lit(0)).alias(f) if f == "n" else F.col(f) for f in fields]
    )


def numeric_values(df: DataFrame, columns: Sequence[str] | None = None, parse=plain_number) -> dict[str, Column]:
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    chosen = list(columns or numeric_columns(df))
    return {c: cell(c).cast("double") if kinds[c] == "numeric" else parse(cell(c)) for c in chosen}


def _measured(
    df: DataFrame, columns: Sequence[str], parse, fields: Sequence[str], probabilities: dict[str, float], digits: int
) -> DataFrame:
    """(column, fields..., quantiles...), rounded: moments come along in the first scan of the quantiles.

    One row per column is fetched and comes back as literals.
    """
    cells = parsed_cells(df, columns, parse)
    quantiles, measured = quantiles_of(
        cells, len(columns), list(probabilities.values()), measures={f: _MOMENTS[f](F.col("value")) for f in fields}
    )
    names = [*fields, *probabilities]
    rows = []
    for i, column in enumerate(columns):
        known = [measured[i][f] for f in fields] + quantiles[i] if i in measured else [0 if f == "n" else None for f in names]
        values = [F.lit(v).cast("long" if f == "n" else "double").alias(f) for f, v in zip(names, known)]
        rows.append(F.struct(F.lit(column).alias("column"), *values))
    frame = df.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return frame.select("column", *[F.col(f) if f == "n" else F.round(f, digits).alias(f) for f in names])


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, parse=formatted_number, digits: int = 2) -> DataFrame:
    """(column, min, max, average, median, std, sum), rounded."""
    columns = list(columns or numeric_columns(df))
    found = _measured(df, columns, parse, ("min", "max", "mean", "std", "sum"), {"median": 0.5}, digits)
    return found.select("column", "min", "max", F.col("mean").alias("average"), "median", "std", "sum")


def describe(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = _measured(df, columns, plain_number, ("n", "mean", "std", "min", "max"), quartiles, digits)
    return found.select("column", F.col("n").alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def variation(df: DataFrame, columns: Sequence[str] | None = None, signed: bool = False) -> DataFrame:
    """Coefficient of variation in percent and its label; `signed` divides by the signed mean."""
    base = F.col("mean") if signed else F.abs("mean")
    return numeric_aggregates(df, numeric_values(df, columns), ("mean", "std")).select(
        "column",
        F.round(cv_of(F.col("std"), base), 2).alias("cv"),
        cv_label(cv_of(F.col("std"), base)).alias("variability"),
    )


def cv_of(std: Column, mean: Column) -> Column:
    return F.try_divide(std, mean) * 100


def cv_label(cv: Column) -> Column:
    return F.when(cv > 50, "high").when(cv > 20, "moderate").when(cv.isNotNull(), "low")


# ---------------------------------------------------------------- types


@dataclass(frozen=True)
class TypeRules:
    """Thresholds of the two rule sets that look at the first values of a column."""

    date_shapes: tuple[str, ...] = DATE_SHAPES
    date_probe: int = 20
    date_share: float = 0.7
    number_probe: int = 200
    number_share: float = 0.7
    parse: Callable[[Column], Column] = formatted_number
    empty_is_numeric: bool = False
    flag_share: float = 0.05
    flag_values: int = 2
    category_share: float = 0.8
    category_values: int = 50


PROFILER = TypeRules()
REPORT = TypeRules(
    date_shapes=REPORT_DATE_SHAPES,
    number_probe=50,
    number_share=1.0,
    parse=plain_number,
    empty_is_numeric=True,
    category_share=0.5,
)


#: Rows of the head that is read for all columns at once, per cell that a rule looks at.
HEAD_ROWS = 4


def _probes(df: DataFrame, columns: Sequence[str], order_by, rules: TypeRules) -> DataFrame:
    """(column, date_share, number_share) among the first filled cells of each text column.

    All columns share the head of the table, a top-k per partition on the order key.
    Columns too empty there are read once more, all together, with the first cells
    of each kept before the shuffle. So there are two scans at most, however many the
    columns.
    """
    depth = max(rules.date_probe, rules.number_probe)
    texts = df.select(F.struct(*order_columns(order_by)).alias("_at"), *[cell(c).cast("string").alias(f"_t{i}") for i, c in enumerate(columns)])
    head = checkpointed(texts.orderBy("_at").limit(depth * HEAD_ROWS))
    filled = head.agg(F.count("*").alias("rows"), *[F.count(f"_t{i}").alias(f"_t{i}") for i in range(len(columns))]).first()
    whole = filled["rows"] < depth * HEAD_ROWS
    sparse = [] if whole else [i for i in range(len(columns)) if filled[f"_t{i}"] < depth]

    def first_cells(rows: DataFrame, chosen: Sequence[int]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_t{i}").alias("v")) for i in chosen])
        each = rows.select("_at", F.inline(cells)).where("v IS NOT NULL")
        at = F.row_number().over(W.partitionBy("c").orderBy("_at"))
        return each.withColumn("at", at).where(F.col("at") <= depth)

    chosen = [i for i in range(len(columns)) if i not in sparse]
    parts = ([first_cells(head, chosen)] if chosen else []) + ([first_cells(texts, sparse)] if sparse else [])
    early, probe = F.col("at") <= rules.date_probe, F.col("at") <= rules.number_probe
    shares = stacked(parts).groupBy("c").agg(
        F.avg(F.when(early, looks_like_date(F.col("v"), rules.date_shapes).cast("int"))).alias("date_share"),
        F.avg(F.when(probe, rules.parse(F.col("v")).isNotNull().cast("int"))).alias("number_share"),
    )
    return named(shares, columns)


def kinds_frame(df: DataFrame) -> DataFrame:
    """(position, column, kind): the schema as data."""
    rows = [(i, f.name, kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, kind string")


def detected_types(
    df: DataFrame, order_by, rules: TypeRules = PROFILER, counts: DataFrame | None = None
) -> DataFrame:
    """(position, column, row_count, filled, missing, unique_count, detected_type)."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    texts = [c for c, k in kinds.items() if k == "text"]
    counts = column_counts(df) if counts is None else counts
    base = counts.join(F.broadcast(kinds_frame(df)), "column")
    if texts:
        base = base.join(F.broadcast(_probes(df, texts, order_by, rules)), "column", "left")
    else:
        base = base.withColumn("date_share", F.lit(None).cast("double")).withColumn(
            "number_share", F.lit(None).cast("double")
        )
    ratio = F.try_divide(F.col("unique_count"), F.col("filled"))
    empty_number = F.lit(rules.empty_is_numeric) & (F.col("filled") == 0)
    kind = (
        F.when(F.col("kind") != "text", F.col("kind"))
        .when(F.col("date_share") > rules.date_share, "datetime")
        .when((F.col("number_share") >= rules.number_share) | empty_number, "numeric")
        .when((ratio < rules.flag_share) & (F.col("unique_count") <= rules.flag_values), "boolean")
        .when((ratio < rules.category_share) & (F.col("unique_count") <= rules.category_values), "categorical")
        .otherwise("text")
    )
    return base.select(
        "position", "column", "row_count", "filled", "missing", "unique_count", kind.alias("detected_type")
    )


# Pairs of words that make a column boolean.
FLAG_PAIRS = (("true", "false"), ("yes", "no"), ("y", "n"), ("t", "f"))
# Name parts that make a column a date, legacy rules.
DATE_NAME_PARTS = ("date", "time", "year")


def legacy_types(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(column, unique_count, detected_type) by the rules that look at names and word pairs."""
    counts = column_counts(df) if counts is None else counts
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    names = list(kinds)

    cells = typed_cells(df, names)
    decimals = [i for i, c in enumerate(names) if isinstance(df.schema[c].dataType, T.DecimalType)]
    is_decimal = F.array_contains(F.array(*[F.lit(i) for i in decimals]).cast("array<int>"), F.col("c"))
    number = F.coalesce(F.col("b").cast("double"), F.col("d"), F.when(is_decimal, F.col("s").try_cast("double")))
    lowered = F.lower("s")
    pairs = [F.bool_and(lowered.isin(*pair)) for pair in FLAG_PAIRS]
    is_bool = F.array_contains(F.array(*[F.lit(i) for i, c in enumerate(names) if kinds[c] == "boolean"]).cast("array<int>"), F.col("c"))
    # Booleans are texts here: their pair of words is true and false.
    found = cells.groupBy("c").agg(
        F.bool_and(F.when(is_bool, lowered.isin("true", "false")).otherwise(number.isin(0.0, 1.0))).alias("_numbers"),
        *[p.alias(f"_pair{i}") for i, p in enumerate(pairs)],
    )
    is_number = reduce(lambda a, b: a | b, [F.col("column") == c for c, k in kinds.items() if k in ("numeric", "boolean")], F.lit(False))
    worded = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_pair{i}"), F.lit(False)) for i in range(len(pairs))])
    flags = every_column(found, names).select(
        "column",
        is_number.alias("is_number"),
        F.when(is_number, F.coalesce("_numbers", F.lit(False))).otherwise(worded).alias("is_flag"),
    )
    named_date = reduce(lambda a, b: a | b, [F.lower("column").contains(p) for p in DATE_NAME_PARTS])
    return counts.join(F.broadcast(flags), "column").select(
        "column",
        "unique_count",
        F.when(F.col("filled") == 0, "text")
        .when(F.col("is_flag"), "boolean")
        .when(F.col("is_number"), "numeric")
        .when(named_date, "datetime")
        .when(F.col("unique_count") / F.col("row_count") < 0.3, "categorical")
        .otherwise("text")
        .alias("detected_type"),
    )


def ratio_types(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(position, column, row_count, filled, unique_count, detected_type) by shares over the full column."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    names = df.columns
    is_a = lambda k: F.array_contains(F.array(*[F.lit(i) for i, c in enumerate(names) if kinds[c] == k]).cast("array<int>"), F.col("c"))
    held = F.col("b").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    # Texts are parsed once per distinct value; one too long to keep can only be a number.
    number = F.coalesce("parsed", strict_number(F.col("s")).isNotNull())
    date = F.col("parsed").isNull() & lenient_timestamp(F.col("s")).isNotNull()
    weight = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    found = (
        _typed_counts(df, names, blank_to_null, strict_number)
        .groupBy("c")
        .agg(
            *_count_fields(),
            weight((is_a("numeric") & held) | (is_a("text") & number)).alias("numbers"),
            weight((is_a("datetime") & held) | (is_a("text") & date)).alias("dates"),
        )
    )
    mine = named(found, names)
    whole = mine if counts is None else counts.join(F.broadcast(mine.select("column", "numbers", "dates")), "column")
    few = F.greatest(F.lit(12), F.ceil(F.col("filled") * 0.2))
    return (
        whole.join(F.broadcast(kinds_frame(df)), "column")
        .select(
            "position",
            "column",
            "row_count",
            "filled",
            "unique_count",
            F.when((F.col("numbers") > 0) & (F.col("numbers") >= F.col("filled") * 0.85), "numeric")
            .when((F.col("dates") > 0) & (F.col("dates") >= F.col("filled") * 0.75), "datetime")
            .when(F.col("unique_count") <= few, "categorical")
            .otherwise("text")
            .alias("detected_type"),
        )
    )


def all_numeric(df: DataFrame) -> DataFrame:
    """(column, filled, is_numeric): every non-empty cell is a finite number."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}

    names = df.columns
    texts = F.array(*[F.lit(i) for i, c in enumerate(names) if kinds[c] == "text"]).cast("array<int>")
    decimals = [c for c in names if kinds[c] == "numeric" and isinstance(df.schema[c].dataType, T.DecimalType)]
    typed = df.select(*[cell(c).cast("double").alias(c) if c in decimals else cell(c) for c in names])
    number = F.coalesce(F.col("b").cast("double"), F.col("d"))
    text = F.when(F.array_contains(texts, F.col("c")), blank_to_null(F.col("s"))).otherwise(F.col("s"))
    found = typed_cells(typed, names).groupBy("c").agg(
        F.count(F.when(F.col("b").isNotNull() | F.col("d").isNotNull() | text.isNotNull(), 1)).alias("filled"),
        F.count(F.coalesce(finite(number), strict_number(F.col("s")))).alias("_numbers"),
    )
    return every_column(found, names).select(
        "column",
        F.coalesce("filled", F.lit(0)).alias("filled"),
        F.coalesce((F.col("_numbers") == F.col("filled")) & (F.col("filled") > 0), F.lit(False)).alias("is_numeric"),
    )


def with_roles(types: DataFrame) -> DataFrame:
    """Add `role`: identifier, measure, dimension or time."""
    many = F.greatest(F.lit(8), F.ceil(F.col("row_count") * 0.15))
    return types.withColumn(
        "role",
        F.when(key_form(F.col("column")).rlike("(^|_)(id|uuid|code|index)(_|$)"), "identifier")
        .when(
            F.col("detected_type") == "numeric",
            F.when(F.col("unique_count") >= many, "measure").otherwise("dimension"),
        )
        .when(F.col("detected_type") == "datetime", "time")
        .otherwise("dimension"),
    )


def with_name_roles(types: DataFrame) -> DataFrame:
    """Simple roles: numeric is a measure, a date-like name is time, else a dimension."""
    return types.withColumn(
        "role",
        F.when(F.col("detected_type") == "numeric", "measure")
        .when(F.lower("column").rlike("(date|time|year|month)"), "time")
        .otherwise("dimension"),
    )


def role_counts(roles: DataFrame) -> DataFrame:
    """Row, column, measure and dimension counts of a table."""
    return roles.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.count_if(F.col("role") == "measure").alias("measure_count"),
        F.count_if(F.col("role") == "dimension").alias("dimension_count"),
    )


# ---------------------------------------------------------------- whole profile


def full_profile(df: DataFrame, order_by, rules: TypeRules = PROFILER, top_k: int = 10) -> DataFrame:
    """One row per column with everything the reports need.

    The types, one row per column, are fetched first: only numeric columns are
    then parsed and summarised, and only categorical ones (at most 50 values)
    are ranked, so no long text is parsed or shuffled for nothing.
    """
    types = detected_types(df, order_by, rules)
    known = types.collect()
    out = df.sparkSession.createDataFrame(known, types.schema)
    numbers = [r["column"] for r in known if r["detected_type"] == "numeric"]
    categories = [r["column"] for r in known if r["detected_type"] == "categorical"]
    if numbers:
        out = out.join(F.broadcast(numeric_profile(df, numbers, rules.parse)), "column", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("double").alias(f) for f in NUMERIC_FIELDS])
    if categories:
        tops = (
            top_values(df, categories, top_k)
            .groupBy("column")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
        )
        return out.join(F.broadcast(tops), "column", "left")
    return out.withColumn("top_values", F.lit(None).cast("array<struct<rank:int,value:string,n:bigint>>"))


# ---------------------------------------------------------------- domain

# Words that speak for a domain, profiler list.
DOMAIN_WORDS = {
    "finance": ("revenue", "profit", "sales", "price", "cost", "income", "expense", "budget", "tax"),
    "healthcare": ("patient", "diagnosis", "treatment", "hospital", "medical", "health", "symptom"),
    "education": ("student", "grade", "course", "school", "university", "teacher", "exam"),
    "ecommerce": ("product", "order", "customer", "cart", "shipping", "payment", "review"),
    "hr": ("employee", "salary", "department", "hire", "position", "manager", "attendance"),
    "marketing": ("campaign", "click", "impression", "conversion", "channel", "ad", "roi"),
    "sports": ("player", "team", "score", "match", "season", "league", "goal"),
}
# Words that speak for a domain, report list.
REPORT_DOMAIN_WORDS = {
    "sales": ("revenue", "sales", "order", "customer", "product", "price", "quantity", "amount", "total"),
    "finance": ("profit", "cost", "expense", "budget", "tax", "income", "asset", "liability", "transaction"),
    "marketing": ("campaign", "click", "impression", "conversion", "channel", "ad", "roi", "ctr", "cpc"),
    "hr": ("employee", "salary", "department", "hire", "position", "manager", "attendance", "performance"),
    "healthcare": ("patient", "diagnosis", "treatment", "hospital", "medical", "health", "drug", "dosage"),
    "ecommerce": ("product", "cart", "checkout", "shipping", "payment", "order", "inventory", "sku"),
    "education": ("student", "grade", "course", "school", "teacher", "exam", "score", "enrollment"),
    "logistics": ("shipment", "delivery", "warehouse", "route", "vehicle", "package", "tracking"),
}


def domain_of(text: Column, words: dict[str, tuple[str, ...]] = DOMAIN_WORDS, whole_words: bool = False) -> Column:
    """The domain with the most keywords in the text, if it has at least two.

    Keywords count once each and match inside words unless `whole_words`;
    ties go to the domain listed first.
    """
    body = F.replace(F.lower(text), F.lit("_"), F.lit(" "))

    def found(word: str) -> Column:
        hit = body.rlike(rf"(?<![a-z0-9]){word}(?![a-z0-9])") if whole_words else body.contains(word)
        return hit.cast("int")

    votes = F.array(
        *[
            F.struct(
                reduce(lambda a, b: a + b, [found(w) for w in listed]).alias("score"),
                F.lit(-i).alias("turn"),
                F.lit(domain).alias("domain"),
            )
            for i, (domain, listed) in enumerate(words.items())
        ]
    )
    best = F.array_max(votes)
    return F.when(best["score"] >= 2, best["domain"]).otherwise("general")


def domains_of_tables(catalog: DataFrame, table: str, column: str, words=DOMAIN_WORDS) -> DataFrame:
    """(table, domain): the vote over the column names of every table in a catalog.

    A keyword holds no space, so it lies inside one name: names vote alone,
    each keyword once per table.
    """
    name = F.replace(F.lower(cell(column)), F.lit("_"), F.lit(" "))
    hits = [
        F.max(name.contains(w).cast("int")).alias(f"{domain}|{w}")
        for domain, listed in words.items()
        for w in listed
    ]
    scored = catalog.groupBy(cell(table).alias("table")).agg(*hits)
    votes = F.array(
        *[
            F.struct(
                reduce(lambda a, b: a + b, [cell(f"{domain}|{w}") for w in listed]).alias("score"),
                F.lit(-i).alias("turn"),
                F.lit(domain).alias("domain"),
            )
            for i, (domain, listed) in enumerate(words.items())
        ]
    )
    best = F.array_max(votes)
    return scored.select("table", F.when(best["score"] >= 2, best["domain"]).otherwise("general").alias("domain"))
