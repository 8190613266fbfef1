"""Correlation, outliers, distributions, trends, forecasts and patterns."""

from itertools import combinations

from pyspark.sql import functions as F

from facetframe.operators import aggregate, normality, stats, trend
from facetframe.operators.quantiles import exact_quantiles
from facetframe.operators.frames import rows_of
from workload.base import query, table

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _line(spark, folder):
    return table(spark, folder, "lineitem").select(*LINE)


def _matrix_sql():
    arms = [
        f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0.0), 4) + 0.0 AS r FROM lineitem"
        for a in LINE
        for b in LINE
        if a != b
    ]
    arms += [f"SELECT '{c}' AS a, '{c}' AS b, CAST(1.0 AS DOUBLE) AS r" for c in LINE]
    return " UNION ALL ".join(arms)


@query("a1_correlations", _matrix_sql())
def _(spark, folder):
    return stats.correlations(_line(spark, folder), LINE)


# Columns that do move together, so that the thresholds have something to find.
LINKED_SQL = """
linked AS (
  SELECT l_quantity AS q, l_extendedprice AS p, l_extendedprice * (1 - l_discount) AS net,
         -l_extendedprice + 900 * l_quantity AS gap, l_tax AS t FROM lineitem
)
"""
LINKED = ["q", "p", "net", "gap", "t"]


def _linked(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("p"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_extendedprice") + 900 * F.col("l_quantity")).alias("gap"),
        F.col("l_tax").alias("t"),
    )


def _pairs_sql(above, strong, limit):
    arms = " UNION ALL ".join(
        f"SELECT {i} AS i, '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM linked"
        for i, (a, b) in enumerate(combinations(LINKED, 2))
    )
    return f"""WITH {LINKED_SQL}, r AS ({arms})
      SELECT column_a, column_b, round(r, 4) AS correlation, CASE WHEN abs(r) > {strong} THEN 'strong' ELSE 'moderate' END AS strength,
             CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM r WHERE abs(r) > {above}
      ORDER BY {'i' if limit else 'abs(r) DESC'} {f'LIMIT {limit}' if limit else ''}"""


@query("a2_strong_pairs", _pairs_sql(0.7, 0.85, None))
def _(spark, folder):
    return stats.strong_pairs(_linked(spark, folder), LINKED)


@query("a3_report_pairs", _pairs_sql(0.5, 0.7, 5))
def _(spark, folder):
    return stats.strong_pairs(_linked(spark, folder), LINKED, above=0.5, strong=0.7, limit=5)


# ---------------------------------------------------------------- outliers

FENCES = "quantile_cont({0}, 0.25) AS q1, quantile_cont({0}, 0.75) AS q3"


def _iqr_sql(name, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", 'iqr' AS method, count({c}) AS n,
              count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
              round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count({c}), 2) AS outlier_pct,
              round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper,
              round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr
            FROM {name}, (SELECT {FENCES.format(c)} FROM {name}) f GROUP BY f.q1, f.q3"""
        for c in columns
    )


@query("a4_iqr_outliers", _iqr_sql("events", ["value"]))
def _(spark, folder):
    return stats.outliers(table(spark, folder, "events"), ["value"])


@query(
    "a4_outlier_rows",
    f"""SELECT event_id, value FROM events, (SELECT {FENCES.format('value')} FROM events)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY event_id LIMIT 100""",
)
def _(spark, folder):
    return stats.outlier_rows(table(spark, folder, "events").select("event_id", "value"), "value", "event_id")


@query(
    "a5_zscore_outliers",
    """SELECT 'value' AS "column", 'zscore' AS method, count(value) AS n,
              count(*) FILTER (abs(value - m) / p > 3) AS outlier_count,
              round(count(*) FILTER (abs(value - m) / p > 3) * 100.0 / count(value), 2) AS outlier_pct,
              round(m - 3 * s, 4) AS lower, round(m + 3 * s, 4) AS upper
       FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS p, stddev_samp(value) AS s FROM events) GROUP BY m, p, s""",
)
def _(spark, folder):
    return stats.outliers(table(spark, folder, "events"), ["value"], "zscore")


@query("a6_all_outliers", _iqr_sql("lineitem", LINE))
def _(spark, folder):
    return stats.outliers(_line(spark, folder), LINE)


@query(
    "a6_total_outliers",
    f"SELECT CAST(sum(outlier_count) AS BIGINT) AS total_outliers, count(*) AS column_count FROM ({_iqr_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])})",
)
def _(spark, folder):
    return stats.total_outliers(stats.outliers(table(spark, folder, "part")))


QUANTILES = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q999": 0.999}


@query(
    "a4_quantiles_by_narrowing",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", """ + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for n, p in QUANTILES.items()) + " FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
    ),
)
def _(spark, folder):
    # Narrow limits, so that brackets shrink for several rounds.
    names = ["l_extendedprice", "l_quantity"]
    wide = exact_quantiles(
        table(spark, folder, "lineitem"), names, list(QUANTILES.values()), bracket_values=500, accuracy=500
    )
    return rows_of(wide, names, {n: (lambda c, i=i: F.round(F.col(c)[i], 6)) for i, n in enumerate(QUANTILES)})


# ---------------------------------------------------------------- histogram and shape


def _histogram_sql(name, column, bins):
    n_bins = str(bins) if bins else "least(20, greatest(5, count(*) // 10))"
    return f"""WITH b AS (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi, CAST({n_bins} AS INTEGER) AS bins FROM {name}),
      g AS (SELECT CAST(unnest(range(bins)) AS INTEGER) AS bin, lo, hi, (hi - lo) / bins AS w, bins FROM b),
      e AS (SELECT bin, bin * w + lo AS l, CASE WHEN bin = bins - 1 THEN hi ELSE (bin + 1) * w + lo END AS r, bin = bins - 1 AS last FROM g)
      SELECT bin, round(l, 4) AS bin_start, round(r, 4) AS bin_end,
             (SELECT count(*) FROM {name} WHERE {column} >= l AND ({column} < r OR (last AND {column} <= r))) AS count FROM e"""


@query("a7_histogram", _histogram_sql("events", "value", None))
def _(spark, folder):
    return stats.histogram(table(spark, folder, "events"), "value")


@query("a7_histogram_15", _histogram_sql("lineitem", "l_extendedprice", 15))
def _(spark, folder):
    return stats.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 15)


def _each(columns, fields, name):
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {fields.format(c)} FROM {name}""" for c in columns)


@query(
    "a8_shape",
    _each(LINE, "count({0}) AS n, round(skewness({0}), 4) + 0.0 AS skewness, round(kurtosis({0}), 4) + 0.0 AS kurtosis", "lineitem"),
)
def _(spark, folder):
    return stats.shape(_line(spark, folder), LINE)


@query(
    "a9_skew_labels",
    _each(
        ["event_id", "user_id", "value"],
        "round(skewness({0}), 4) + 0.0 AS skewness, CASE WHEN skewness({0}) > 0.5 THEN 'right-skewed' WHEN skewness({0}) < -0.5 THEN 'left-skewed' ELSE 'symmetric' END AS label",
        "events",
    ),
)
def _(spark, folder):
    return stats.skew_labels(table(spark, folder, "events").select("event_id", "user_id", "value"))


# ---------------------------------------------------------------- normality


def _horner(coefficients, x):
    out = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {float(c)!r})"
    return out


def _normality_sql(name, value, by):
    """K-squared of groups over 5000 values, Shapiro-Wilk of the smaller ones, in plain SQL."""
    n = normality
    quantile = f"""CASE WHEN abs(p - 0.5) <= 0.425
        THEN (p - 0.5) * {_horner(n.QUANTILE_CENTRE[0], '(0.180625 - (p - 0.5) * (p - 0.5))')} / {_horner(n.QUANTILE_CENTRE[1], '(0.180625 - (p - 0.5) * (p - 0.5))')}
        ELSE sign(p - 0.5) * {_horner(n.QUANTILE_TAIL[0], '(sqrt(-ln(least(p, 1 - p))) - 1.6)')} / {_horner(n.QUANTILE_TAIL[1], '(sqrt(-ln(least(p, 1 - p))) - 1.6)')} END"""
    return f"""
    WITH v AS (SELECT {by} AS k, CAST({value} AS DOUBLE) AS v FROM {name} WHERE {value} IS NOT NULL),
    s AS (SELECT k, CAST(count(*) AS DOUBLE) AS n, avg(v) AS mean, var_pop(v) AS m2 FROM v GROUP BY 1 HAVING count(*) >= 8),
    m AS (SELECT v.k, s.n, s.m2 AS var, sum((v - mean) ** 3) / s.n / s.m2 ** 1.5 AS g1, sum((v - mean) ** 4) / s.n / s.m2 ** 2 - 3 AS g2
          FROM v JOIN s ON v.k = s.k GROUP BY v.k, s.n, s.m2),
    d1 AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
             3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,
             (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
             6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM m WHERE n > 5000),
    d2 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM d1),
    d3 AS (SELECT k, n,
             1 / sqrt(0.5 * ln(w2)) * ln(y / sqrt(2 / (w2 - 1)) + sqrt((y / sqrt(2 / (w2 - 1))) ** 2 + 1)) AS z1,
             (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * ((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4)))) ** (1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM d2),
    large AS (SELECT k, n, 'D''Agostino-Pearson' AS test, z1 * z1 + z2 * z2 AS statistic, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value FROM d3),
    o AS (SELECT v.k, v.v, s.n, row_number() OVER (PARTITION BY v.k ORDER BY v.v) AS i FROM v JOIN s ON v.k = s.k WHERE s.n <= 5000),
    q AS (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM o),
    w AS (SELECT k, v, n, i, {quantile} AS m FROM q),
    t AS (SELECT k, n, sum(m * m) AS mm, max(m) AS ml, max(m) FILTER (i = n - 1) AS mn, 1 / sqrt(n) AS u FROM w GROUP BY 1, 2),
    e AS (SELECT *, ml / sqrt(mm) + {_horner(n.WEIGHT_LAST, 'u')} AS al, mn / sqrt(mm) + {_horner(n.WEIGHT_NEXT, 'u')} AS an FROM t),
    f AS (SELECT *, sqrt((mm - 2 * ml * ml - 2 * mn * mn) / (1 - 2 * al * al - 2 * an * an)) AS scale FROM e),
    x AS (SELECT w.k, w.n, sum(v * CASE WHEN i = w.n THEN al WHEN i = w.n - 1 THEN an WHEN i = 1 THEN -al WHEN i = 2 THEN -an ELSE m / scale END) ** 2
                 / (var_pop(v) * count(*)) AS stat FROM w JOIN f ON w.k = f.k GROUP BY 1, 2),
    z AS (SELECT *, CASE WHEN n <= 11 THEN (-ln({_horner(n.SMALL_GAMMA, 'n')} - ln(1 - stat)) - {_horner(n.SMALL_MEAN, 'n')}) / exp({_horner(n.SMALL_LOG_DEVIATION, 'n')})
                         ELSE (ln(1 - stat) - {_horner(n.LARGE_MEAN, 'ln(n)')}) / exp({_horner(n.LARGE_LOG_DEVIATION, 'ln(n)')}) END AS z FROM x),
    c AS (SELECT *, 1 / (1 + 0.5 * abs(z) / sqrt(2.0)) AS t FROM z),
    h AS (SELECT *, t * exp(-z * z / 2 + {_horner(n.ERFC_FIT, 't')}) / 2 AS half FROM c),
    small AS (SELECT k, n, 'Shapiro-Wilk' AS test, stat AS statistic, CASE WHEN z >= 0 THEN half ELSE 1 - half END AS p_value FROM h)
    SELECT k AS {by}, CAST(n AS BIGINT) AS n, test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, p_value > 0.05 AS is_normal
    FROM (SELECT * FROM large UNION ALL SELECT * FROM small)"""


@query("a10_normality_large_groups", _normality_sql("lineitem", "l_extendedprice", "l_returnflag"))
def _(spark, folder):
    return normality.normality(table(spark, folder, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("a11_normality_small_groups", _normality_sql("customer", "c_acctbal", "c_nationkey"))
def _(spark, folder):
    return normality.normality(table(spark, folder, "customer"), "c_acctbal", ["c_nationkey"])


# ---------------------------------------------------------------- trends

MONTHS_SQL = """
months AS (
  SELECT period, value, row_number() OVER (ORDER BY period) - 1 AS x FROM (
    SELECT strftime({time}, '%Y-%m') AS period, avg({value}) AS value FROM {name} GROUP BY 1)
)
"""


@query(
    "a12_trend",
    f"""WITH {MONTHS_SQL.format(time='o_orderdate', value='o_totalprice', name='orders')},
          f AS (SELECT count(*) AS n, regr_slope(value, x) AS s, regr_r2(value, x) AS r2, stddev_pop(value) AS d FROM months)
        SELECT 'o_totalprice' AS "column", 'o_orderdate' AS temporal_column, n AS periods,
               CASE WHEN n < 3 THEN 'insufficient_data' WHEN abs(s) < 0.01 * d THEN 'stable' WHEN r2 < 0.3 THEN 'fluctuating'
                    WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(s, 6) AS slope, round(r2, 4) AS r_squared FROM f""",
)
def _(spark, folder):
    return trend.trend(table(spark, folder, "orders"), "o_totalprice", "o_orderdate")


@query(
    "a12_trend_over_numbers",
    """WITH y AS (SELECT value, row_number() OVER (ORDER BY y) - 1 AS x FROM (SELECT year(o_orderdate) AS y, avg(o_totalprice) AS value FROM orders GROUP BY 1)),
          f AS (SELECT count(*) AS n, regr_slope(value, x) AS s, regr_r2(value, x) AS r2, stddev_pop(value) AS d FROM y)
        SELECT 'o_totalprice' AS "column", 'y' AS temporal_column, n AS periods,
               CASE WHEN n < 3 THEN 'insufficient_data' WHEN abs(s) < 0.01 * d THEN 'stable' WHEN r2 < 0.3 THEN 'fluctuating'
                    WHEN s > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(s, 6) AS slope, round(r2, 4) AS r_squared FROM f""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    return trend.trend(rows, "o_totalprice", "y")


def _report_trend_sql(value):
    return f"""SELECT '{value}' AS "column", 'l_shipdate' AS temporal_column,
         CASE WHEN s > 0 THEN 'increasing' WHEN s < 0 THEN 'decreasing' ELSE 'stable' END AS direction, round(s, 6) AS slope, round(r2, 4) AS r_squared
       FROM (WITH {MONTHS_SQL.format(time='l_shipdate', value=value, name='lineitem')} SELECT regr_slope(value, x) AS s, regr_r2(value, x) AS r2 FROM months)"""


@query("a13_report_trends", _report_trend_sql("l_quantity") + " UNION ALL " + _report_trend_sql("l_extendedprice"))
def _(spark, folder):
    return trend.report_trends(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], "l_shipdate")


@query(
    "a14_anomalies",
    f"""SELECT 'value' AS "column", count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM events), 2) AS percentage,
               round(min(q1 - 1.5 * (q3 - q1)), 2) AS lower, round(min(q3 + 1.5 * (q3 - q1)), 2) AS upper,
               array_to_string((array_agg(value ORDER BY event_id))[1:5], '|') AS sample_values
        FROM events, (SELECT {FENCES.format('value')} FROM events) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def _(spark, folder):
    rows = table(spark, folder, "events")
    found = stats.anomalies(rows, ["event_id", "user_id", "value"], "event_id")
    return found.withColumn("sample_values", F.array_join(F.col("sample_values").cast("array<string>"), "|"))


@query(
    "a15_moments",
    _each(LINE, "round(avg({0}), 4) AS mean, round(var_pop({0}), 4) AS variance, round(stddev_pop({0}), 4) AS std", "lineitem"),
)
def _(spark, folder):
    return stats.moments(_line(spark, folder), LINE)


@query(
    "a16_linear_regression",
    """SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem""",
)
def _(spark, folder):
    line = trend.fit(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return line.select("n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r_squared")])


YEARS_SQL = "years AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS value FROM orders GROUP BY 1)"


def _yearly(spark, folder):
    return aggregate.count_per_year(
        table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy").alias("y")), "y"
    )


def _forecast_sql(where):
    return f"""WITH {YEARS_SQL}, f AS (SELECT regr_slope(value, year) AS s, regr_intercept(value, year) AS i, regr_r2(value, year) AS r FROM years {where}),
      l AS (SELECT max(year) AS last FROM years)
      SELECT year, CAST(value AS DOUBLE) AS actual, CAST(NULL AS DOUBLE) AS predicted, round(r, 6) AS confidence FROM years, f
      UNION ALL SELECT CAST(last + k AS INTEGER), NULL, greatest(0.0, floor(s * (last + k) + i + 0.5)), round(r, 6) FROM f, l, range(1, 6) t(k)"""


@query("a17_forecast", _forecast_sql(""))
def _(spark, folder):
    return trend.forecast(_yearly(spark, folder))


@query("a17_forecast_complete_years", _forecast_sql("WHERE year <= 2000"))
def _(spark, folder):
    return trend.forecast(_yearly(spark, folder), complete_until=2000)


TREND_SQL = """
SELECT 'trend' AS type, 'Content ' || CASE WHEN s > 0 THEN 'increased' ELSE 'decreased' END || ' steadily over time.' AS message,
       round(least(1.0, abs(s) / mean), 6) AS confidence
FROM (SELECT (arg_max(value, year) - arg_min(value, year)) * 1.0 / greatest(max(year) - min(year), count(*) - 1, 1) AS s, avg(value) AS mean, count(*) AS k FROM {0})
WHERE k >= 3 AND abs(s) > mean * 0.1
"""
ANOMALY_SQL = """
SELECT 'anomaly' AS type, 'Sharp ' || CASE WHEN value > m THEN 'spike' ELSE 'drop' END || ' detected around ' || CAST(year AS VARCHAR) || '.' AS message,
       round(least(1.0, abs(value - m) / (2 * d)), 6) AS confidence
FROM {0}, (SELECT avg(value) AS m, stddev_pop(value) AS d, count(*) AS k FROM {0}) WHERE k >= 4 AND d > 0 AND abs(value - m) > 2 * d
"""
DOMINANCE_SQL = """
SELECT 'dominance' AS type, upper(label[1]) || label[2:] || ' dominates the dataset in {1}.' AS message, round(value * 1.0 / total, 6) AS confidence
FROM (SELECT label, value, sum(value) OVER () AS total, count(*) OVER () AS k FROM {0}) WHERE k >= 2 AND value * 1.0 / total > 0.3 ORDER BY value DESC, label LIMIT 1
"""
# All orders under a derived year whose counts rise: 1, 3, 5 ... of every 49 keys.
RISING_SQL = """rising AS (SELECT o_orderkey, CAST(1994 + CAST(floor(sqrt(o_orderkey % 49)) AS INTEGER) AS VARCHAR) AS y, o_orderpriority FROM orders)"""


def _rising(spark, folder):
    year = F.floor(F.sqrt(F.col("o_orderkey") % 49)).cast("int") + 1994
    return table(spark, folder, "orders").select("o_orderkey", year.cast("string").alias("y"), "o_orderpriority")


@query(
    "a18_yearly_trend",
    f"WITH {RISING_SQL}, years AS (SELECT CAST(y AS INTEGER) AS year, count(*) AS value FROM rising GROUP BY 1) " + TREND_SQL.format("years"),
)
def _(spark, folder):
    return trend.yearly_trend(aggregate.count_per_year(_rising(spark, folder), "y"))


@query("a19_yearly_anomalies", f"WITH {YEARS_SQL} " + ANOMALY_SQL.format("years"))
def _(spark, folder):
    return trend.yearly_anomalies(_yearly(spark, folder))


@query(
    "a20_dominance",
    "WITH c AS (SELECT o_orderstatus AS label, count(*) AS value FROM orders GROUP BY 1) " + DOMINANCE_SQL.format("c", "o_orderstatus"),
)
def _(spark, folder):
    return trend.dominance(aggregate.count_per_value(table(spark, folder, "orders"), "o_orderstatus"), "o_orderstatus")


@query(
    "a21_patterns",
    f"""WITH {RISING_SQL}, years AS (SELECT CAST(y AS INTEGER) AS year, count(*) AS value FROM rising GROUP BY 1),
          c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE o_orderpriority END AS label, count(*) AS value FROM rising GROUP BY 1)
        {TREND_SQL.format('years')} UNION ALL {ANOMALY_SQL.format('years')} UNION ALL ({DOMINANCE_SQL.format('c', 'category')})""",
)
def _(spark, folder):
    rows = _rising(spark, folder).withColumn(
        "category", F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise(F.col("o_orderpriority"))
    )
    return trend.patterns(rows, "y", "category")
