"""Literal cases on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from facetframe.functions import dates as D, numbers as N, text as X
from facetframe.operators import aggregate, charts, cleaning, messages, profile, stats, trend
from facetframe.plans import questions, report
from facetframe.sources import tables


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [
        ("2020", "Movie", "India", "PG"),
        ("2020", "Movie", "India", "PG"),
        ("2021", "Series", "US", "PG-13"),
        ("2022", "Movie", "India", "PG"),
        ("2023", "Movie", "India", "PG"),
        ("2023", "Series", "US", "PG-13"),
    ]
    return spark.createDataFrame(rows, "release_year string, type string, country string, rating string")


@pytest.fixture(scope="module")
def pattern(spark):
    years = ["2020"] + ["2021"] * 2 + ["2022"] * 3 + ["2023"] * 3
    rows = [(y, "Movie", "India", "PG") for y in years] + [("2023", "Series", "US", "PG-13")]
    return spark.createDataFrame(rows, "release_year string, type string, country string, rating string")


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def one(spark, expression, raw, kind="string"):
    return spark.createDataFrame([(raw,)], f"raw {kind}").select(expression(F.col("raw")).alias("v")).first()["v"]


def test_count_per_year(catalog):
    found = values(aggregate.count_per_year(catalog, "release_year"), "year", "value")
    assert found == [(2020, 2), (2021, 1), (2022, 1), (2023, 2)]


def test_count_per_value(catalog):
    assert dict(values(aggregate.count_per_value(catalog, "type"), "label", "value")) == {"Movie": 4, "Series": 2}


def test_patterns(pattern):
    found = {r["type"]: r for r in trend.patterns(pattern, "release_year", "type").collect()}
    assert found["trend"]["confidence"] == pytest.approx(0.4)
    assert "increased" in found["trend"]["message"]
    assert found["dominance"]["confidence"] == pytest.approx(0.9)


def test_patterns_need_three_rows(catalog):
    with pytest.raises(ValueError):
        trend.patterns(catalog.limit(2), "release_year", "type")


def test_forecast(spark):
    yearly = spark.createDataFrame([(2020, 2), (2021, 3), (2022, 4)], "year int, value bigint")
    found = values(trend.forecast(yearly, 2), "year", "actual", "predicted", "confidence")
    assert [f[0] for f in found] == [2020, 2021, 2022, 2023, 2024]
    assert [f[1] for f in found] == [2, 3, 4, None, None]
    assert [f[2] for f in found] == [None, None, None, 5, 6]
    assert {f[3] for f in found} == {1.0}


def test_forecast_needs_two_years(spark):
    assert trend.forecast(spark.createDataFrame([(2020, 2)], "year int, value bigint")).count() == 0


def test_fit_of_constants(spark):
    flat_x = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = trend.fit(flat_x, "x", "y").first()
    assert row["slope"] is None and row["r_squared"] is None
    flat_y = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    assert trend.fit(flat_y, "x", "y").first()["r_squared"] == 0.0


def test_zip_points(spark):
    df = spark.createDataFrame([(["USA", "India", "UK"], ["10", "20"])], "labels array<string>, data array<string>")
    assert values(charts.zip_points(df, "labels", "data"), "name", "value") == [("USA", 10.0), ("India", 20.0)]


def test_value_rows(spark):
    df = spark.createDataFrame([("USA", "100"), ("India", None), ("UK", "bad")], "country string, salary_usd string")
    found = values(charts.value_rows(df, "country", "salary_usd"), "country", "salary_usd")
    assert found == [("USA", 100.0), ("India", 0.0), ("UK", 0.0)]


def test_empty_pie(spark):
    df = spark.createDataFrame([("A", None)], "name string, value double")
    assert charts.value_rows(df, "name", "value", pie=True).count() == 0


def test_validated(spark, catalog):
    with pytest.raises(ValueError, match="invalid or empty"):
        tables.validated(catalog.where("false"))
    with pytest.raises(ValueError):
        tables.validated(catalog, ["missing"])


@pytest.mark.parametrize(
    "raw,formatted,strict,lenient",
    [
        ("1,234", 1234.0, 1234.0, 1234.0),
        ("$120.50", 120.5, None, 120.5),
        ("(123.4)", -123.4, None, -123.4),
        ("(-5)", None, None, -5.0),
        ("45%", 45.0, None, 45.0),
        ("12d", 12.0, None, 12.0),
        ("1e400", 1400.0, None, 1400.0),
        ("1e3", 13.0, 1000.0, 13.0),
        ("NaN", None, None, None),
        ("", None, None, None),
        (None, None, None, None),
        ("abc", None, None, None),
        ("1-2", None, None, None),
        ("()", None, None, None),
        (" .5 ", 0.5, 0.5, 0.5),
        ("0x1F", 1.0, 31.0, 1.0),
        ("Infinity", None, None, None),
    ],
)
def test_numbers(spark, raw, formatted, strict, lenient):
    row = (
        spark.createDataFrame([(raw,)], "raw string")
        .select(
            N.formatted_number(F.col("raw")).alias("f"),
            N.strict_number(F.col("raw")).alias("s"),
            N.lenient_number(F.col("raw")).alias("l"),
        )
        .first()
    )
    assert (row["f"], row["s"], row["l"]) == (formatted, strict, lenient)


@pytest.mark.parametrize(
    "raw,day,parsed",
    [
        ("2020", "2020-01-01", "2020-01-01"),
        ("2020-01-31", "2020-01-31", "2020-01-31"),
        ("31/01/2020", None, "2020-01-31"),
        ("01/31/2020", "2020-01-31", "2020-01-31"),
        ("2020/01/31", "2020-01-31", "2020-01-31"),
        ("2020-01-31T10:00:00", "2020-01-31", "2020-01-31"),
        ("2020-13-41", None, None),
        ("bad", None, None),
        (None, None, None),
    ],
)
def test_dates(spark, raw, day, parsed):
    shown = lambda f: lambda c: F.date_format(f(c), "yyyy-MM-dd")
    assert one(spark, shown(D.lenient_timestamp), raw) == day
    assert one(spark, shown(D.parse_date), raw) == parsed


def test_texts(spark):
    assert one(spark, X.key_form, " Unit Price ($) ") == "unit_price"
    assert one(spark, X.question_form, "  Show_me -- the Rating, please! ") == "show me the rating please"
    assert one(spark, X.capitalised, "movie") == "Movie"
    assert one(spark, X.title_label, "unit_price") == "Unit Price"
    assert [one(spark, X.known_label, v) for v in ("", "  ", None, " a ")] == ["Unknown"] * 3 + ["a"]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["a b", "a-b"])
    with pytest.raises(ValueError, match="collide"):
        cleaning.clean_headers(df)


def test_group_metric_without_numbers(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "3"), (" ", "4")], "g string, v string")
    assert values(aggregate.group_metric(df, "g", "v", "min", direction="asc"), "label", "value") == [("a", 2.0), ("Unknown", 3.0)]
    assert values(aggregate.group_metric(df, "g", "v", "average"), "label", "value") == [("Unknown", 3.5), ("a", 0.0)]


def test_tied_groups(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0)], "g string, v double")
    assert [r["label"] for r in aggregate.group_metric(df, "g", "v", "sum", limit=2).collect()] == ["a", "b"]


def test_degenerate_columns(spark):
    df = spark.createDataFrame([(5.0, None, 1.0)] * 6 + [(5.0, None, float("nan"))], "c double, e double, n double")
    found = {r["column"]: r for r in stats.outliers(df, ["c", "e", "n"]).collect()}
    assert found["c"]["outlier_count"] == 0 and found["c"]["lower"] == 5.0
    assert found["e"]["n"] == 0 and found["e"]["lower"] is None
    assert found["n"]["n"] == 6
    assert stats.histogram(df, "e").count() == 0
    bins = stats.histogram(df, "c").collect()
    assert (bins[0]["bin_start"], bins[-1]["bin_end"], sum(b["count"] for b in bins)) == (4.5, 5.5, 7)
    shapes = {r["column"]: r["skewness"] for r in stats.shape(df, ["n"]).collect()}
    assert shapes["n"] is None
    matrix = {(r["a"], r["b"]): r["r"] for r in stats.correlations(df, ["c", "e", "n"]).collect()}
    assert set(matrix.values()) == {0.0} and len(matrix) == 9


def test_zscore_uses_two_deviations(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 20 + [10]], "v double")
    row = stats.outliers(df, ["v"], "zscore").first()
    assert row["outlier_count"] == 1
    assert row["upper"] == pytest.approx(10 / 21 + 3 * math.sqrt((100 - 100 / 21) / 20), abs=1e-4)


def test_select_rules(spark, catalog):
    assert questions.run_select(catalog, 'SELECT "type" FROM dataset WHERE "type" = \'Series\'').count() == 2
    with pytest.raises(ValueError):
        questions.run_select(catalog, "WITH t AS (SELECT 1) SELECT * FROM t")
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


@pytest.mark.parametrize(
    "text,server,browser,local",
    [
        ("show type distribution", "distribution", "distribution", "aggregation"),
        ("show top categories", "overview", "aggregation", "aggregation"),
        ("Movie vs Series", "comparison", "comparison", "comparison"),
        ("titles after 2020", "overview", "filter", "filter"),
        ("sales in India", "aggregation", "overview", "filter"),
        ("what is this?", "overview", "question", "aggregation"),
        ("summary", "overview", "overview", "aggregation"),
    ],
)
def test_intents(spark, text, server, browser, local):
    for rules, wanted in (("server", server), ("browser", browser), ("local", local)):
        assert one(spark, lambda c: messages.intent(c, rules), text) == wanted


def test_message_parts(spark):
    assert one(spark, messages.asked_limit, "top 7 by price") == 7
    assert one(spark, messages.asked_limit, "top 700 of 3") == 5
    assert one(spark, lambda c: messages.year_after(c)[0], "since 2021") == "gte"
    assert one(spark, lambda c: messages.year_after(c)[1], "titles after 2020") == 2020
    assert one(spark, messages.year_before, "before 2022") == 2022
    assert one(spark, lambda c: messages.compared_pair(c)[0], "compare Movie vs Series") == "movie"
    assert one(spark, lambda c: messages.compared_pair(c)[1], "compare Movie vs Series") == "series"
    assert one(spark, messages.sql_shape, "how many per type") == "count"


def test_low_cardinality(spark):
    df = spark.createDataFrame([(str(i % 3), str(i)) for i in range(100)], "few string, many string")
    found = messages.low_cardinality_values(df, ["few", "many"])
    assert sorted(values(found, "column", "value")) == [("few", "0"), ("few", "1"), ("few", "2")]


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('name,note\n"a, b","say ""hi"""\n\n c ,"two\nlines"\n', encoding="utf8")
    rows = values(tables.read_csv(spark, str(path)), "name", "note")
    assert rows[0] == ("a, b", 'say "hi"') and rows[1][1] == "two\nlines"
    short = tmp_path / "short.csv"
    short.write_text("a,b,c\n1, 2\n\n1,2,3,4\n", encoding="utf8")
    assert values(tables.read_csv_text(spark, str(short)), "a", "b", "c") == [("1", "2", ""), ("1", "2", "3")]
    lone = tmp_path / "lone.csv"
    lone.write_text("a,b\n", encoding="utf8")
    with pytest.raises(ValueError):
        tables.read_csv_text(spark, str(lone))


def test_report(spark):
    rows = [(i, f"2020-{i % 12 + 1:02d}-15", "ab"[i % 2], float(i), float(i * 2 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "row int, sold_date string, grade string, price double, cost double")
    made = report.comprehensive_report(df, "row")
    kinds = {r["column"]: r["detected_type"] for r in made.profile.collect()}
    assert kinds == {"row": "numeric", "sold_date": "datetime", "grade": "boolean", "price": "numeric", "cost": "numeric"} or (
        kinds["grade"] == "categorical"
    )
    assert made.domain == "general"
    assert made.kpis.count() >= 5 and made.insights.count() >= 3
    assert {r["column_a"] for r in made.correlations.collect()}
    assert made.trends.count() == 2
    assert 1 <= len(made.charts) <= 6
    for frame in made.charts.values():
        assert frame.count() > 0


def test_report_as_json(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(-2 * i), "x") for i in range(20)], "a double, b double, c string")
    path = str(tmp_path / "report")
    document = report.statistics_report(df, "small")
    tables.write_json(document.select(F.from_json("report", "metadata struct<dataset_name string, total_rows long>, "
                      "analysis struct<correlations array<struct<a string, b string, r double>>>").alias("r")).select("r.*"), path)
    row = spark.read.json(path).first()
    assert (row["metadata"]["dataset_name"], row["metadata"]["total_rows"]) == ("small", 20)
    assert {(c["a"], c["b"]): c["r"] for c in row["analysis"]["correlations"]}["a", "b"] == -1.0


def test_domain_words(spark):
    assert one(spark, profile.domain_of, "order_id customer_name") == "ecommerce"
    assert one(spark, profile.domain_of, "grade") == "general"
    assert one(spark, lambda c: profile.domain_of(c, whole_words=True), "grades roi") == "general"


def test_float_literals_are_guarded(spark):
    for raw, value in (("12d", 0.0), ("1f", 0.0), (" 12.5 ", 12.5), ("nan", 0.0), ("1e3", 1000.0), (None, 0.0)):
        assert one(spark, N.safe_float, raw) == value
    df = spark.createDataFrame([("12d", "1"), ("7f", "2.5")], "a string, b string")
    from facetframe.operators.cleaning import coerce_numeric_columns

    assert dict(coerce_numeric_columns(df).dtypes) == {"a": "string", "b": "double"}


def test_nan_is_missing_in_groups(spark):
    from facetframe.operators.aggregate import group_metric
    from facetframe.operators.filters import among, compares

    df = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", 1.0)], "g string, v double")
    assert [tuple(r) for r in group_metric(df, "g", "v", "sum").collect()] == [("a", 2.0), ("b", 1.0)]
    assert [tuple(r) for r in group_metric(df, "g", "v", "max").collect()] == [("a", 2.0), ("b", 1.0)]
    assert df.where(compares(df, "v", "gt", 0.0)).count() == 2
    names = spark.createDataFrame([("Sci-Fi",), ("sci fi",), ("a_b",), ("Drama!",), ("x",)], "genre string")
    assert names.where(among("genre", ["Sci-Fi", "a_b", "drama"])).count() == 4


def test_browser_mentions_leave_out_compared_values(spark):
    values = spark.createDataFrame([("kind", "Movie"), ("kind", "Series"), ("kind", "TV Movie")], "column string, value string")
    asked = spark.createDataFrame(
        [(1, "movie vs series"), (2, "show TV-Movie ratings"), (3, "compare series versus movie"), (4, None), (5, "movie rating vs series rating")],
        "id int, text string",
    )
    found = messages.value_mentions(asked, "text", values, ["id"], "browser")
    assert sorted((r["id"], r["value"]) for r in found.collect()) == [(2, "TV Movie"), (5, "Series")]
