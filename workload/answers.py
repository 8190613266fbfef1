"""Question shapes and chart rows."""

from pyspark.sql import functions as F

from facetframe.operators import charts, profile
from facetframe.plans import questions
from workload.base import ASKED_SQL, DIRTY_SQL, MIXED_COLUMNS, MIXED_SQL, asked, dirty, mixed, query, table
from workload.loading import LENIENT_SQL, LENIENT_VALUE, STRICT_SQL

# ---------------------------------------------------------------- questions


@query(
    "q1_own_select",
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(avg(l_discount), 4) AS discount
       FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2""",
)
def _(spark, folder):
    return questions.run_select(
        table(spark, folder, "lineitem"),
        """SELECT "l_returnflag" AS flag, "l_linestatus" AS status, COUNT(*) AS n, ROUND(AVG("l_discount"), 4) AS discount
           FROM dataset WHERE "l_quantity" > 25 GROUP BY "l_returnflag", "l_linestatus";""",
    )


@query(
    "q1_select_outcome",
    """SELECT 'right' AS asked, 2 AS columns, count(DISTINCT o_orderpriority) AS row_count, false AS failed FROM orders
       UNION ALL SELECT 'not a select', 0, 0, true UNION ALL SELECT 'no such column', 0, 0, true""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    asks = {
        "right": 'SELECT "o_orderpriority", COUNT(*) AS n FROM dataset GROUP BY "o_orderpriority"',
        "not a select": "DROP TABLE dataset",
        "no such column": "SELECT missing_column FROM dataset",
    }
    frames = [
        questions.select_outcome(orders, sql).select(
            F.lit(name).alias("asked"), F.size("columns").alias("columns"), "row_count", F.col("error").isNotNull().alias("failed")
        )
        for name, sql in asks.items()
    ]
    return frames[0].union(frames[1]).union(frames[2])


@query(
    "q2_distinct_samples",
    f"WITH {MIXED_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY v) AS samples FROM
            (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM mixed WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)"""
        for c in MIXED_COLUMNS
    ),
)
def _(spark, folder):
    found = questions.distinct_samples(mixed(spark, folder))
    return found.select("column", F.concat_ws("|", "samples").alias("samples"))


@query(
    "q3_how_many_per_group",
    "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, folder):
    return questions.how_many(table(spark, folder, "lineitem"), "l_suppkey")


@query("q3_how_many", "SELECT count(*) AS total_count FROM lineitem")
def _(spark, folder):
    return questions.how_many(table(spark, folder, "lineitem"))


@query(
    "q4_top_rows",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return questions.top_rows(rows, "o_totalprice", 7, ties=["o_orderkey"])


@query("q4_top_groups", "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, folder):
    return questions.top_rows(table(spark, folder, "orders"), None, 5, "o_custkey")


@query(
    "q5_bottom_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders
       ORDER BY price ASC NULLS FIRST, o_orderkey LIMIT 20""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 1000 != 0, F.col("o_totalprice")).alias("price")
    )
    return questions.bottom_rows(rows, "price", 20, ties=["o_orderkey"])


@query(
    "q6_average_per_group",
    "SELECT l_suppkey, round(avg(l_extendedprice), 2) AS avg_l_extendedprice FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, folder):
    return questions.average(table(spark, folder, "lineitem"), "l_extendedprice", "l_suppkey")


@query("q6_average", "SELECT round(avg(l_extendedprice), 2) AS average FROM lineitem")
def _(spark, folder):
    return questions.average(table(spark, folder, "lineitem"), "l_extendedprice")


@query(
    "q7_sum_per_group",
    "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total_l_extendedprice FROM lineitem GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
)
def _(spark, folder):
    return questions.total(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag", digits=2)


@query("q7_sum", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def _(spark, folder):
    return questions.total(table(spark, folder, "lineitem"), "l_extendedprice", digits=2)


@query(
    "q8_distribution",
    "SELECT o_orderpriority, count(*) AS count, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, folder):
    return questions.distribution(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice")


@query(
    "q9_comparison",
    """SELECT l_suppkey, count(*) AS count, round(avg(l_extendedprice), 2) AS avg_l_extendedprice,
              round(sum(l_extendedprice), 2) AS total_l_extendedprice FROM lineitem GROUP BY 1""",
)
def _(spark, folder):
    return questions.comparison(table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice")


@query("q10_default_groups", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, folder):
    return questions.default_view(table(spark, folder, "part"), "p_brand")


@query("q10_default_rows", "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_partkey LIMIT 10")
def _(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    return questions.default_view(rows, None, "p_partkey")


@query(
    "q11_trend_buckets",
    "SELECT strftime(l_shipdate, '%Y-%m') AS bucket, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 12",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice")
    return questions.trend_buckets(rows, "month", "l_extendedprice", "count")


@query(
    "q12_paired_values",
    """SELECT l_quantity AS x, l_extendedprice AS value FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
       ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 20""",
)
def _(spark, folder):
    return questions.paired_values(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey"]
    )


@query(
    "q13_grouped_answer",
    """SELECT l_suppkey_text AS label, min(l_extendedprice) AS value FROM (SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey_text, l_extendedprice
         FROM lineitem WHERE lower(l_returnflag) = 'n' AND l_quantity > 5) GROUP BY 1 ORDER BY 2, 1 LIMIT 10""",
)
def _(spark, folder):
    return questions.grouped_answer(
        table(spark, folder, "lineitem"),
        "l_suppkey",
        "l_extendedprice",
        "min",
        conditions=[("l_returnflag", "eq", "N"), ("l_quantity", "gt", 5)],
    )


@query(
    "q14_trend_counts",
    "SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1",
)
def _(spark, folder):
    return questions.trend_counts(table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")), "year")


@query(
    "q15_compare_values",
    "SELECT c_mktsegment AS label, CAST(count(*) AS DOUBLE) AS value FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
)
def _(spark, folder):
    return questions.compare_values(table(spark, folder, "customer"), "c_mktsegment", ["building", "machinery"])


@query("q16_filtered_total", "SELECT 'Result' AS label, count(*) AS value FROM orders WHERE year(o_orderdate) > 1998 AND o_orderstatus = 'F'")
def _(spark, folder):
    rows = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    return questions.filtered_total(rows, [("y", "gt", 1998), ("o_orderstatus", "eq", "f")])


@query(
    "q17_overview",
    """SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count,
              CASE WHEN count(DISTINCT p_partkey) >= greatest(8, ceil(count(*) * 0.15)) THEN 1 ELSE 0 END
              + CASE WHEN count(DISTINCT p_size) >= greatest(8, ceil(count(*) * 0.15)) THEN 1 ELSE 0 END
              + CASE WHEN count(DISTINCT p_retailprice) >= greatest(8, ceil(count(*) * 0.15)) THEN 1 ELSE 0 END AS measure_count,
              6 - (CASE WHEN count(DISTINCT p_partkey) >= greatest(8, ceil(count(*) * 0.15)) THEN 1 ELSE 0 END
              + CASE WHEN count(DISTINCT p_size) >= greatest(8, ceil(count(*) * 0.15)) THEN 1 ELSE 0 END
              + CASE WHEN count(DISTINCT p_retailprice) >= greatest(8, ceil(count(*) * 0.15)) THEN 1 ELSE 0 END) AS dimension_count FROM part""",
)
def _(spark, folder):
    found = questions.overview(profile.with_roles(profile.ratio_types(table(spark, folder, "part"))))
    return found.withColumns({c: F.col(c).cast("int") for c in ("measure_count", "dimension_count")})


# ---------------------------------------------------------------- charts


@query("h1_category_bars", "SELECT p_brand AS name, count(*) AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, folder):
    return charts.category_bars(table(spark, folder, "part"), "p_brand")


@query("h1_category_pie", "SELECT o_orderpriority AS name, count(*) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, folder):
    return charts.category_pie(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "h2_monthly_line",
    "SELECT strftime(l_shipdate, '%Y-%m') AS name, round(avg(l_quantity), 2) AS value FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 24",
)
def _(spark, folder):
    return charts.monthly_line(table(spark, folder, "lineitem"), "l_shipdate", "l_quantity")


def _scatter_sql(limit):
    return f"""WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, l_extendedprice AS y FROM lineitem
                 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice LIMIT {limit})
               SELECT x, y, (SELECT round(corr(x, y), 4) FROM t) AS r FROM t"""


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


@query("h3_scatter_points", _scatter_sql(100))
def _(spark, folder):
    return charts.scatter_points(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", LINE_KEY)


@query("h3_scatter_small", _scatter_sql(12))
def _(spark, folder):
    return charts.scatter_points(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", LINE_KEY, limit=12, at_least=3
    )


@query(
    "h4_average_bars",
    "SELECT c_mktsegment AS name, round(avg(c_acctbal), 2) AS value FROM customer GROUP BY 1 ORDER BY avg(c_acctbal) DESC, 1 LIMIT 10",
)
def _(spark, folder):
    return charts.average_bars(table(spark, folder, "customer"), "c_mktsegment", "c_acctbal")


@query(
    "h5_histogram_bars",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
         e AS (SELECT CAST(i AS INTEGER) AS bin, i * (hi - lo) / 15 + lo AS l, CASE WHEN i = 14 THEN hi ELSE (i + 1) * ((hi - lo) / 15) + lo END AS r FROM b, range(15) t(i))
       SELECT bin, format('{:.1f}', l) || '-' || format('{:.1f}', r) AS name,
              (SELECT count(*) FROM lineitem WHERE l_extendedprice >= l AND (l_extendedprice < r OR (bin = 14 AND l_extendedprice <= r))) AS value FROM e""",
)
def _(spark, folder):
    return charts.histogram_bars(table(spark, folder, "lineitem"), "l_extendedprice")


@query(
    "h6_result_points",
    """SELECT name, value FROM (SELECT c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS value, c_custkey FROM customer
         ORDER BY c_custkey LIMIT 50) WHERE value IS NOT NULL""",
)
def _(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"), "c_custkey"
    )
    return charts.result_points(rows, order_by="c_custkey")


HAS = "regexp_matches(lower(long_text), '{}')"
INTENT = "CASE conv_id % 4 WHEN 0 THEN 'trend' WHEN 1 THEN 'correlation' WHEN 2 THEN 'distribution' ELSE 'count' END"


@query(
    "h7_chart_type",
    f"""WITH {ASKED_SQL} SELECT conv_id, turn,
          CASE WHEN {HAS.format('trend|over time|timeline|by year|by month')} THEN 'line'
               WHEN {HAS.format('distribution|breakdown|share|proportion')} THEN CASE WHEN turn + 4 <= 8 THEN 'pie' ELSE 'bar' END
               WHEN {HAS.format('scatter|relationship|correlation')} THEN 'scatter'
               WHEN turn + 4 <= 6 AND {HAS.format('percent|share')} THEN 'pie' ELSE 'bar' END AS by_words,
          CASE WHEN {HAS.format('pie')} THEN 'pie' WHEN {INTENT} = 'trend' THEN 'line' WHEN {INTENT} = 'correlation' THEN 'scatter'
               WHEN {INTENT} = 'distribution' AND turn + 4 <= 6 THEN 'pie' ELSE 'bar' END AS by_intent,
          CASE WHEN {INTENT} = 'trend' THEN 'line' WHEN {HAS.format('pie')} THEN 'pie' ELSE 'bar' END AS local FROM asked""",
)
def _(spark, folder):
    text, size = F.col("long_text"), F.col("turn") + 4
    turn = F.col("conv_id") % 4
    intent = F.when(turn == 0, "trend").when(turn == 1, "correlation").when(turn == 2, "distribution").otherwise("count")
    requested = F.when(F.lower(text).contains("pie"), "pie")
    return asked(spark, folder).select(
        "conv_id",
        "turn",
        charts.chart_type_of(text, size, F.lit(True)).alias("by_words"),
        charts.chart_type_by_intent(intent, requested, size).alias("by_intent"),
        charts.local_chart_type(text, intent).alias("local"),
    )


@query(
    "h8_dashboard_rows",
    f"WITH {DIRTY_SQL}, t AS (SELECT CAST(o_orderkey AS VARCHAR) AS category, {STRICT_SQL.format('raw')} AS value FROM dirty) SELECT * FROM t WHERE value IS NOT NULL",
)
def _(spark, folder):
    return charts.dashboard_rows(dirty(spark, folder), "o_orderkey", "raw")


@query(
    "h9_running_total",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM orders""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return charts.cumulative(rows, "o_totalprice", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "cumulative")


@query("h10_row_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS index FROM orders")
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return charts.row_numbers(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "index")


@query(
    "h11_share_of_total",
    "SELECT o_orderkey, round(o_totalprice * 1000000 / (SELECT sum(o_totalprice) FROM orders), 6) AS share FROM orders",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    shares = charts.share_of_total(rows.withColumn("o_totalprice", F.col("o_totalprice")), "o_totalprice", digits=18)
    return shares.select("o_orderkey", F.round(F.col("share") * 1000000, 6).alias("share"))


@query(
    "h12_zip_points",
    """WITH t AS (SELECT vec_id, embedding AS v, list_transform(range(len(embedding) - CAST(vec_id % 2 AS INTEGER)),
                     lambda i: CASE i % 4 WHEN 0 THEN 'USA' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'UK' END) AS l FROM embeddings),
            z AS (SELECT vec_id, CAST(unnest(range(least(len(v), len(l)))) AS INTEGER) AS position, v, l FROM t)
       SELECT vec_id, position, coalesce(nullif(l[position + 1], ''), 'Item ' || CAST(position + 1 AS VARCHAR)) AS name,
              CAST(round(v[position + 1] * 100) AS DOUBLE) AS value FROM z""",
)
def _(spark, folder):
    four = F.array(F.lit("USA"), F.lit(""), F.lit(None), F.lit("UK"))
    # One label fewer than numbers in every other row.
    places = F.sequence(F.lit(0), F.size("embedding") - 1 - (F.col("vec_id") % 2).cast("int"))
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.transform(places, lambda i: F.get(four, i % 4)).alias("labels"),
        F.transform("embedding", lambda x: F.round(x * 100)).alias("numbers"),
    )
    return charts.zip_points(rows, "labels", "numbers", keep=["vec_id"])


# A text without any digit counts as 0 in a chart series; an empty cell is null.
SERIES_VALUE = f"CASE WHEN x <> '' AND kept = '' THEN 0.0 ELSE {LENIENT_VALUE} END"


@query(
    "h13_series_rows",
    f"""WITH {DIRTY_SQL}, {LENIENT_SQL}, s AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {SERIES_VALUE} AS a,
             CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS b FROM lenient)
        SELECT * FROM s""",
)
def _(spark, folder):
    rows = dirty(spark, folder).select(
        "o_orderkey",
        F.col("raw").alias("a"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("b"),
    )
    return charts.series_rows(rows, "o_orderkey", ["a", "b"])


@query(
    "h13_value_rows",
    f"""WITH {DIRTY_SQL}, {LENIENT_SQL} SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce({SERIES_VALUE}, 0.0) AS raw FROM lenient""",
)
def _(spark, folder):
    return charts.value_rows(dirty(spark, folder), "o_orderkey", "raw")


@query(
    "h13_pie_rows",
    f"""WITH {DIRTY_SQL}, {LENIENT_SQL}, t AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce({SERIES_VALUE}, 0.0) AS raw FROM lenient)
        SELECT * FROM t WHERE raw > 0""",
)
def _(spark, folder):
    return charts.value_rows(dirty(spark, folder), "o_orderkey", "raw", pie=True)


@query(
    "h14_merge_suggestions",
    """WITH u AS (
         SELECT 0 AS t, o_orderkey AS p, o_orderpriority AS title, 'bar' AS type FROM orders
         UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, 'pie' FROM orders
         UNION ALL SELECT 2, p_partkey, p_type, NULL FROM part),
       f AS (SELECT coalesce(nullif(title, ''), 'chart') AS title, coalesce(type, 'bar') AS type, min(t * 1000000000000 + p) AS seen FROM u GROUP BY 1, 2)
       SELECT title, type FROM f ORDER BY seen, title, type LIMIT 8""",
)
def _(spark, folder):
    orders, part = table(spark, folder, "orders"), table(spark, folder, "part")
    lists = [
        orders.select(F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("title"), F.lit("bar").alias("type")),
        orders.select(
            F.col("o_orderkey").alias("position"),
            F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("title"),
            F.lit("pie").alias("type"),
        ),
        part.select(F.col("p_partkey").alias("position"), F.col("p_type").alias("title"), F.lit(None).cast("string").alias("type")),
    ]
    return charts.merge_suggestions(lists, limit=8)


@query(
    "h15_valid_points",
    """WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS n,
                    CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS l,
                    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS x,
                    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS value,
                    CASE o_orderkey % 3 WHEN 0 THEN 'PIE' WHEN 1 THEN 'radar' ELSE 'line' END AS kind FROM orders)
       SELECT CASE WHEN lower(kind) IN ('bar', 'line', 'pie', 'area', 'scatter') THEN lower(kind) ELSE 'bar' END AS type,
              coalesce(nullif(n, ''), nullif(l, ''), x) AS name, coalesce(x, nullif(n, ''), nullif(l, '')) AS x,
              coalesce(nullif(l, ''), nullif(n, ''), x) AS label, value
       FROM t WHERE coalesce(nullif(n, ''), nullif(l, ''), x) IS NOT NULL AND value IS NOT NULL""",
)
def _(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("n"),
        F.when(k % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("l"),
        F.when(k % 5 != 0, k.cast("string")).alias("x"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("value"),
        F.when(k % 3 == 0, "PIE").when(k % 3 == 1, "radar").otherwise("line").alias("kind"),
    )
    return charts.valid_points(rows, F.col("kind"), "n", "l", "x", "value")


@query(
    "h16_feature_suggestions",
    """WITH c AS (SELECT count(DISTINCT p_size) >= greatest(8, ceil(count(*) * 0.15)) AS sized,
                         count(DISTINCT p_retailprice) >= greatest(8, ceil(count(*) * 0.15)) AS priced FROM part)
       SELECT CAST(position AS INTEGER) AS position, title, type FROM (
         SELECT 0 AS position, 'p_partkey by p_name' AS title, 'bar' AS type FROM c UNION ALL
         SELECT 2, 'p_partkey vs ' || CASE WHEN sized THEN 'p_size' ELSE 'p_retailprice' END, 'scatter' FROM c WHERE sized OR priced)""",
)
def _(spark, folder):
    return charts.feature_suggestions(profile.with_roles(profile.ratio_types(table(spark, folder, "part"))))
