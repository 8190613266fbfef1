"""Choices of the question plans, on a small catalogue."""

from facetframe.plans.question_plan import question_plans

CATALOG = [
    (0, "order_id", "identifier", "numeric", 900, 1000),
    (1, "unit_price", "measure", "numeric", 700, 1000),
    (2, "score", "measure", "numeric", 300, 1000),
    (3, "country_name", "dimension", "text", 990, 1000),
    (4, "status", "dimension", "categorical", 3, 1000),
    (5, "sold_date", "time", "datetime", 365, 1000),
]
SCHEMA = "position int, column string, role string, detected_type string, unique_count long, row_count long"


def test_choices(spark):
    asked = {
        # The group is the first column that is named, a measure too.
        "average score by status": ("average", "score", "status", "sold_date", "score"),
        "Lowest price per COUNTRY": ("min", "unit_price", "country_name", "sold_date", "country_name"),
        "total by rating": ("sum", "unit_price", "country_name", "sold_date", "country_name"),
        "trend over Sold-Date": ("count", "unit_price", "sold_date", "sold_date", "sold_date"),
        "": ("count", "unit_price", "country_name", "sold_date", "status"),
        None: ("count", "unit_price", "country_name", "sold_date", "status"),
        "top things": ("max", "unit_price", "country_name", "sold_date", "status"),
    }
    messages = spark.createDataFrame([(i, m) for i, m in enumerate(asked)], "i int, text string")
    catalog = spark.createDataFrame(CATALOG, SCHEMA)
    got = {r["i"]: tuple(r)[1:] for r in question_plans(messages, "text", catalog, ["i"]).collect()}
    assert got == dict(enumerate(asked.values()))
    none = question_plans(messages, "text", catalog.where("role = 'time'"), ["i"]).first()
    assert none["measure"] is None and none["dimension"] == "sold_date"
    assert question_plans(messages.limit(0), "text", catalog, ["i"]).count() == 0
