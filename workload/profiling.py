"""Column profiles, KPI and insight rows, grouped aggregates."""

from pyspark.sql import functions as F

from facetframe.functions.dates import month_of
from facetframe.operators import aggregate, profile
from facetframe.plans import report
from workload.base import DIRTY_SQL, DATES_SQL, MIXED_COLUMNS, MIXED_SQL, MIXED_TEXTS, dates, dirty, mixed, query, table

# ---------------------------------------------------------------- types

DATE_SHAPES = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"
REPORT_SHAPES = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2})"
FORMATTED = "TRY_CAST(regexp_replace(regexp_replace(nullif(trim({0}), ''), '^\\((.*)\\)$', '-\\1'), '[^0-9.\\-+]', '', 'g') AS DOUBLE)"
PLAIN = "TRY_CAST({0} AS DOUBLE)"


def _types_sql(shapes, number_probe, number_share, parse, category_share):
    parts = []
    for position, c in enumerate(MIXED_COLUMNS):
        counts = f"""SELECT {position} AS position, '{c}' AS "column", count(*) AS row_count, count({c}) AS filled,
                            count(*) - count({c}) AS missing, count(DISTINCT {c}) AS unique_count"""
        if c not in MIXED_TEXTS:
            parts.append(f"{counts}, 'numeric' AS detected_type FROM mixed")
            continue
        head = f"(SELECT {c} AS v FROM mixed WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT {{}})"
        date_share = f"(SELECT avg(CASE WHEN regexp_matches(trim(v), '{shapes}') THEN 1.0 ELSE 0.0 END) FROM {head.format(20)})"
        numbers = f"(SELECT avg(CASE WHEN {parse.format('v')} IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM {head.format(number_probe)})"
        ratio = f"count(DISTINCT {c}) * 1.0 / count({c})"
        parts.append(
            f"""{counts}, CASE WHEN {date_share} > 0.7 THEN 'datetime' WHEN {numbers} >= {number_share} THEN 'numeric'
                  WHEN {ratio} < 0.05 AND count(DISTINCT {c}) <= 2 THEN 'boolean'
                  WHEN {ratio} < {category_share} AND count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'text' END FROM mixed"""
        )
    return f"WITH {MIXED_SQL} " + " UNION ALL ".join(parts)


@query("p1_types_profiler", _types_sql(DATE_SHAPES, 200, 0.7, FORMATTED, 0.8))
def _(spark, folder):
    return profile.detected_types(mixed(spark, folder), "o_orderkey")


@query("p2_types_report", _types_sql(REPORT_SHAPES, 50, 1.0, PLAIN, 0.5))
def _(spark, folder):
    return profile.detected_types(mixed(spark, folder), "o_orderkey", profile.REPORT)


LEGACY_SQL = """
legacy AS (
  SELECT o_orderkey, o_orderkey % 2 AS bit, CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag,
         o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderpriority AS priority,
         'order ' || CAST(o_orderkey AS VARCHAR) AS note FROM orders
)
"""
LEGACY_KINDS = {
    "o_orderkey": "numeric", "bit": None, "flag": None, "o_totalprice": "numeric", "order_date": "datetime",
    "priority": "ratio", "note": "ratio",
}


def _legacy_sql():
    parts = []
    for c, kind in LEGACY_KINDS.items():
        if c == "bit":
            value = "CASE WHEN bool_and(bit IN (0, 1)) THEN 'boolean' ELSE 'numeric' END"
        elif c == "flag":
            value = "CASE WHEN bool_and(lower(flag) IN ('yes', 'no')) THEN 'boolean' ELSE 'text' END"
        elif kind == "ratio":
            value = f"CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) < 0.3 THEN 'categorical' ELSE 'text' END"
        else:
            value = f"'{kind}'"
        parts.append(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, {value} AS detected_type FROM legacy""")
    return f"WITH {LEGACY_SQL} " + " UNION ALL ".join(parts)


@query("p3_types_legacy", _legacy_sql())
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_orderkey") % 2).alias("bit"),
        F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("flag"),
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_orderpriority").alias("priority"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("note"),
    )
    return profile.legacy_types(rows)


STRICT = (
    "CASE WHEN regexp_matches(replace(trim({0}), ',', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
    "THEN TRY_CAST(replace(trim({0}), ',', '') AS DOUBLE) END"
)


def _ratio_sql(role):
    parts = []
    for position, c in enumerate(MIXED_COLUMNS):
        text = c in MIXED_TEXTS
        filled = f"count(nullif(trim({c}), ''))" if text else f"count({c})"
        unique = f"count(DISTINCT nullif(trim({c}), ''))" if text else f"count(DISTINCT {c})"
        numbers = f"count({STRICT.format(c)})" if text else f"count({c})"
        stamps = f"count(CASE WHEN regexp_matches({c}, '^\\d{{4}}$') OR try_strptime({c}, '%Y-%m-%d') IS NOT NULL THEN 1 END)" if text else "0"
        parts.append(
            f"""SELECT {position} AS position, '{c}' AS "column", count(*) AS row_count, {filled} AS filled, {unique} AS unique_count,
                  CASE WHEN {numbers} > 0 AND {numbers} >= {filled} * 0.85 THEN 'numeric'
                       WHEN {stamps} > 0 AND {stamps} >= {filled} * 0.75 THEN 'datetime'
                       WHEN {unique} <= greatest(12, ceil({filled} * 0.2)) THEN 'categorical' ELSE 'text' END AS detected_type
                FROM mixed"""
        )
    body = f"WITH {MIXED_SQL}, types AS (" + " UNION ALL ".join(parts) + ")"
    if not role:
        return body + " SELECT * FROM types"
    return body + """
      SELECT *, CASE WHEN regexp_matches("column", '(^|_)(id|uuid|code|index)(_|$)') THEN 'identifier'
                     WHEN detected_type = 'numeric' AND unique_count >= greatest(8, ceil(row_count * 0.15)) THEN 'measure'
                     WHEN detected_type = 'numeric' THEN 'dimension' WHEN detected_type = 'datetime' THEN 'time'
                     ELSE 'dimension' END AS role FROM types"""


@query("p4_types_ratio", _ratio_sql(False))
def _(spark, folder):
    return profile.ratio_types(mixed(spark, folder))


def _numeric_sql():
    parts = [
        f"""SELECT '{c}' AS "column", count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS filled,
              count(nullif(trim(CAST({c} AS VARCHAR)), '')) > 0 AND
              count({STRICT.format(f'CAST({c} AS VARCHAR)')}) = count(nullif(trim(CAST({c} AS VARCHAR)), '')) AS is_numeric FROM mixed"""
        for c in MIXED_COLUMNS
    ]
    return f"WITH {MIXED_SQL} " + " UNION ALL ".join(parts)


@query("p5_all_numeric", _numeric_sql())
def _(spark, folder):
    return profile.all_numeric(mixed(spark, folder))


@query("p6_roles", _ratio_sql(True))
def _(spark, folder):
    return profile.with_roles(profile.ratio_types(mixed(spark, folder)))


@query(
    "p6_name_roles",
    _ratio_sql(False).replace("SELECT * FROM types", "")
    + """ SELECT "column", CASE WHEN detected_type = 'numeric' THEN 'measure'
            WHEN regexp_matches(lower("column"), '(date|time|year|month)') THEN 'time' ELSE 'dimension' END AS role FROM types""",
)
def _(spark, folder):
    return profile.with_name_roles(profile.ratio_types(mixed(spark, folder))).select("column", "role")


# ---------------------------------------------------------------- counts and summaries


def _counts_sql(name, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS row_count, count({c}) AS filled, count(*) - count({c}) AS missing,
              count(DISTINCT {c}) AS unique_count FROM {name}"""
        for c in columns
    )


@query("p7_column_counts", f"WITH {MIXED_SQL} " + _counts_sql("mixed", MIXED_COLUMNS))
def _(spark, folder):
    return profile.column_counts(mixed(spark, folder))


@query("p7_long_texts", _counts_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def _(spark, folder):
    return profile.column_counts(table(spark, folder, "documents"))


@query(
    "p8_numeric_profile",
    f"""WITH {MIXED_SQL}, v AS (SELECT 'price_text' AS "column", {FORMATTED.format('price_text')} AS x FROM mixed
          UNION ALL SELECT 'o_totalprice', o_totalprice FROM mixed UNION ALL SELECT 'o_orderkey', o_orderkey FROM mixed)
        SELECT "column", round(min(x), 2) AS min, round(max(x), 2) AS max, round(avg(x), 2) AS average,
               round(quantile_cont(x, 0.5), 2) AS median, round(stddev_samp(x), 2) AS std, round(sum(x), 2) AS sum
        FROM v GROUP BY 1""",
)
def _(spark, folder):
    return profile.numeric_profile(mixed(spark, folder), ["price_text", "o_totalprice", "o_orderkey"])


def _top_sql(columns, k):
    parts = [
        f"""SELECT '{c}' AS "column", CAST(r AS INTEGER) AS rank, v AS value, n FROM (
              SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r
              FROM mixed WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= {k}"""
        for c in columns
    ]
    return f"WITH {MIXED_SQL} " + " UNION ALL ".join(parts)


@query("p9_top_values", _top_sql(["status", "date_text", "flag", "priority", "note"], 10))
def _(spark, folder):
    return profile.top_values(mixed(spark, folder), ["status", "date_text", "flag", "priority", "note"])


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "p10_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
              round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
              round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem"""
        for c in LINE_NUMBERS
    ),
)
def _(spark, folder):
    return profile.describe(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query(
    "p11_completeness",
    f"WITH {MIXED_SQL}, c AS ({_counts_sql('mixed', MIXED_COLUMNS)}) "
    """SELECT "column", round(filled * 100.0 / row_count, 2) AS completeness FROM c
       UNION ALL SELECT '*', round(sum(filled) * 100.0 / sum(row_count), 2) FROM c""",
)
def _(spark, folder):
    return profile.completeness(profile.column_counts(mixed(spark, folder)))


@query(
    "p12_duplicate_rows",
    """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem))
              AS duplicate_rows FROM lineitem""",
)
def _(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    return profile.duplicate_rows(rows)


@query(
    "p13_worst_missing",
    f"WITH {MIXED_SQL}, c AS ({_counts_sql('mixed', MIXED_COLUMNS)}) "
    """SELECT "column", missing, round(missing * 100.0 / row_count, 2) AS missing_pct FROM c
       WHERE missing > 0 ORDER BY missing DESC, "column" LIMIT 1""",
)
def _(spark, folder):
    return profile.worst_missing(profile.column_counts(mixed(spark, folder)))


def _variation_sql(signed):
    mean = "avg(x)" if signed else "abs(avg(x))"
    values = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS x FROM lineitem""" for c in LINE_NUMBERS)
    cv = f"stddev_samp(x) / {mean} * 100"
    return f"""WITH v AS ({values}) SELECT "column", round({cv}, 2) AS cv,
                 CASE WHEN {cv} > 50 THEN 'high' WHEN {cv} > 20 THEN 'moderate' ELSE 'low' END AS variability FROM v GROUP BY 1"""


@query("p14_variation", _variation_sql(False))
def _(spark, folder):
    return profile.variation(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query("p14_variation_signed", _variation_sql(True))
def _(spark, folder):
    return profile.variation(table(spark, folder, "lineitem"), LINE_NUMBERS, signed=True)


def _domain_sql(words):
    body = "replace(lower(text), '_', ' ')"
    scores = ", ".join(
        " + ".join(f"CAST(contains({body}, '{w}') AS INTEGER)" for w in listed) + f" AS s{i}"
        for i, listed in enumerate(words.values())
    )
    names = list(words)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    arms = " ".join(f"WHEN s{i} = {best} THEN '{d}'" for i, d in enumerate(names))
    return f"WITH s AS (SELECT doc_id, {scores} FROM documents) SELECT doc_id, CASE WHEN {best} < 2 THEN 'general' {arms} END AS domain FROM s"


@query("p15_domain_of_text", _domain_sql(profile.DOMAIN_WORDS))
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", profile.domain_of(F.col("text")).alias("domain"))


@query("p15_domain_of_text_report", _domain_sql(profile.REPORT_DOMAIN_WORDS))
def _(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", profile.domain_of(F.col("text"), profile.REPORT_DOMAIN_WORDS).alias("domain")
    )


def _table_domain_sql():
    words = profile.DOMAIN_WORDS
    body = "replace(lower(text), '_', ' ')"
    scores = ", ".join(
        " + ".join(f"max(CAST(contains({body}, '{w}') AS INTEGER))" for w in listed) + f" AS s{i}"
        for i, listed in enumerate(words.values())
    )
    names = list(words)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(names))) + ")"
    arms = " ".join(f"WHEN s{i} = {best} THEN '{d}'" for i, d in enumerate(names))
    return f"""WITH s AS (SELECT conv_id, {scores} FROM conversations GROUP BY 1)
               SELECT conv_id AS "table", CASE WHEN {best} < 2 THEN 'general' {arms} END AS domain FROM s"""


@query("p15_domains_of_tables", _table_domain_sql())
def _(spark, folder):
    return profile.domains_of_tables(table(spark, folder, "conversations"), "conv_id", "text")


# ---------------------------------------------------------------- KPI rows and insights

FIGURES_SQL = f"""
cells AS (
  SELECT 0 AS position, 0 AS k, 'o_orderkey' AS "column", CAST(o_orderkey AS DOUBLE) AS x FROM mixed
  UNION ALL SELECT 2, 1, 'price_text', {FORMATTED.format('price_text')} FROM mixed
  UNION ALL SELECT 5, 2, 'o_totalprice', o_totalprice FROM mixed
  UNION ALL SELECT 7, 3, 'note', {FORMATTED.format('note')} FROM mixed
),
figures AS (
  SELECT position, k, "column", round(min(x), 2) AS lo, round(max(x), 2) AS hi, round(avg(x), 2) AS mean,
         round(stddev_samp(x), 2) AS std, round(sum(x), 2) AS total
  FROM cells GROUP BY 1, 2, 3
),
whole AS (SELECT count(*) AS n, count(*) - count(status) AS gaps, count(*) * 8 AS cells FROM mixed)
"""
MONEY = "format('{{:,.2f}}', {})"


@query(
    "p16_profile_kpis",
    f"""WITH {MIXED_SQL}, {FIGURES_SQL}, kpis AS (
          SELECT 0 AS place, 'Total Records' AS label, format('{{:,}}', n) AS value FROM whole
          UNION ALL SELECT CAST(k * 2 + 1 AS INTEGER), 'Total ' || "column", {MONEY.format('total')} FROM figures WHERE k < 3 AND total > 0
          UNION ALL SELECT CAST(k * 2 + 2 AS INTEGER), 'Avg ' || "column", {MONEY.format('mean')} FROM figures WHERE k < 3
          UNION ALL SELECT 10, 'Data Completeness', format('{{:.1f}}', (cells - gaps) * 100.0 / cells) || '%' FROM whole
          UNION ALL SELECT 11, 'Unique priority', CAST(count(DISTINCT priority) AS VARCHAR) FROM mixed)
        SELECT * FROM kpis ORDER BY place LIMIT 8""",
)
def _(spark, folder):
    return report.profile_kpis(report.settled_profile(mixed(spark, folder), "o_orderkey"))


@query(
    "p16_column_kpis",
    f"""WITH {MIXED_SQL}, {FIGURES_SQL}
        SELECT CAST(k AS INTEGER) AS place, "column" AS label,
               CASE WHEN abs(total) >= 1000 THEN {MONEY.format('total')} ELSE {MONEY.format('mean')} END AS value,
               CASE WHEN abs(total) >= 1000 THEN 'sum' ELSE 'average' END AS basis FROM figures""",
)
def _(spark, folder):
    return report.column_kpis(report.settled_profile(mixed(spark, folder), "o_orderkey"))


@query(
    "p16_legacy_kpis",
    f"""WITH {MIXED_SQL}, {FIGURES_SQL}
        SELECT 0 AS place, 'Total Records' AS label, CAST(n AS VARCHAR) AS value FROM whole
        UNION ALL SELECT 1, 'Total Columns', '8' UNION ALL
        SELECT 2, 'Overall Health', format('{{:.1f}}', (cells - gaps) * 100.0 / cells) || '%' FROM whole""",
)
def _(spark, folder):
    return report.legacy_kpis(mixed(spark, folder))


EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]
EVENT_FIGURES_SQL = """
cells AS (
  SELECT 0 AS position, 0 AS k, 'event_id' AS "column", CAST(event_id AS DOUBLE) AS x FROM events
  UNION ALL SELECT 1, 1, 'user_id', user_id FROM events UNION ALL SELECT 3, 2, 'value', value FROM events
),
figures AS (
  SELECT position, k, "column", round(min(x), 2) AS lo, round(max(x), 2) AS hi, round(avg(x), 2) AS mean,
         round(stddev_samp(x), 2) AS std, round(sum(x), 2) AS total, skewness(x) AS skew, count(x) AS n,
         quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
  FROM cells GROUP BY 1, 2, 3
),
odd AS (
  SELECT f."column", f.position, f.n, count(*) AS found FROM cells c JOIN figures f ON c.position = f.position
  WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3
),
types AS (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY 1)
"""


def _events(spark, folder):
    return table(spark, folder, "events").select(*EVENT_COLUMNS)


def _titled(c):
    return f"array_to_string(list_transform(string_split({c}, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(
    "p16_report_kpis",
    f"""WITH {EVENT_FIGURES_SQL}, cv AS (SELECT *, std / abs(mean) * 100 AS cv FROM figures), kpis AS (
          SELECT 0 AS place, 'Total ' || {_titled('"column"')} AS label, {MONEY.format('total')} AS value, 'SUM(' || "column" || ')' AS formula
            FROM figures WHERE total = (SELECT max(total) FROM figures)
          UNION ALL SELECT 1, 'Total Records', format('{{:,}}', count(*)), 'COUNT(*)' FROM events
          UNION ALL SELECT CAST(k + 2 AS INTEGER), 'Average ' || {_titled('"column"')}, {MONEY.format('mean')}, 'AVG(' || "column" || ')' FROM figures
          UNION ALL SELECT 10, 'Data Completeness', '100.0%', '(Filled Cells / Total Cells) × 100'
          UNION ALL SELECT 11, 'Unique Event Type', CAST(count(*) AS VARCHAR), 'COUNT(DISTINCT event_type)' FROM types
          UNION ALL SELECT CAST(k + 13 AS INTEGER), {_titled('"column"')} || ' Variability',
                 CASE WHEN cv > 50 THEN 'High' WHEN cv > 20 THEN 'Moderate' ELSE 'Low' END || ' (CV: ' || format('{{:.1f}}', cv) || '%)',
                 '(STDDEV / MEAN) × 100' FROM cv WHERE k < 2)
        SELECT * FROM kpis ORDER BY place LIMIT 10""",
)
def _(spark, folder):
    return report.report_kpis(report.settled_profile(_events(spark, folder), "event_id", profile.REPORT))


@query(
    "p17_profile_insights",
    f"""WITH {MIXED_SQL}, {FIGURES_SQL}, cv AS (SELECT *, std / abs(mean) * 100 AS cv FROM figures), told AS (
          SELECT 0 AS place, 'overview' AS category, '*' AS "column",
                 'This general dataset contains ' || format('{{:,}}', n) || ' records across 8 columns (4 numeric, 1 categorical).' AS message,
                 'high' AS importance FROM whole
          UNION ALL SELECT position + 1, 'distribution', "column",
                 CASE WHEN cv > 50 THEN '**' || "column" || '** shows high variability (CV=' || format('{{:.0f}}', cv) || '%) — ranging from '
                        || {MONEY.format('lo')} || ' to ' || {MONEY.format('hi')} || '.'
                      ELSE '**' || "column" || '** ranges from ' || {MONEY.format('lo')} || ' to ' || {MONEY.format('hi')}
                        || ' with average ' || {MONEY.format('mean')} || '.' END, 'medium' FROM cv
          UNION ALL SELECT 10000, 'quality', 'status', '**status** has the most missing data (' || format('{{:,}}', gaps) || ' values, '
                 || format('{{:.1f}}', gaps * 100.0 / n) || '%).', 'medium' FROM whole
          UNION ALL (SELECT 20006, 'pattern', 'priority', 'The most common **priority** is "' || priority || '" ('
                 || format('{{:,}}', count(*)) || ' occurrences).', 'medium' FROM mixed GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1))
        SELECT * FROM told""",
)
def _(spark, folder):
    return report.profile_insights(report.settled_profile(mixed(spark, folder), "o_orderkey"))


@query(
    "p17_report_insights",
    f"""WITH {EVENT_FIGURES_SQL}, told AS (
          SELECT 0 AS place, 'overview' AS category, '*' AS "column",
                 'This dataset contains ' || format('{{:,}}', count(*)) || ' records with 4 attributes (3 metrics, 1 dimensions).' AS message,
                 'high' AS importance FROM events
          UNION ALL SELECT position + 1, 'distribution', "column",
                 CASE WHEN abs(skew) > 1 THEN '**' || "column" || '** is ' || CASE WHEN skew > 0 THEN 'right' ELSE 'left' END
                        || '-skewed (skewness: ' || format('{{:.2f}}', skew) || '), ranging from '
                      ELSE '**' || "column" || '** ranges from ' END
                   || {MONEY.format('lo')} || ' to ' || {MONEY.format('hi')} || ' with average ' || {MONEY.format('mean')}
                   || CASE WHEN abs(skew) > 1 THEN '.' ELSE ' and standard deviation ' || format('{{:.2f}}', std) || '.' END,
                 CASE WHEN abs(skew) > 1 THEN 'medium' ELSE 'low' END FROM figures
          UNION ALL (SELECT 10002, 'pattern', 'event_type', '**' || event_type || '** is the most common event_type with ' || format('{{:,}}', n)
                 || ' occurrences (' || format('{{:.1f}}', n * 100.0 / total) || '% of data).', 'medium'
                 FROM types ORDER BY n DESC, event_type LIMIT 1)
          UNION ALL SELECT position + 30000, 'anomaly', "column", 'Found ' || format('{{:,}}', found) || ' potential outliers ('
                 || format('{{:.1f}}', found * 100.0 / n) || '%) in **' || "column" || '** using IQR method.', 'medium'
                 FROM odd WHERE found * 1.0 / n > 0.01)
        SELECT * FROM told""",
)
def _(spark, folder):
    rows = _events(spark, folder)
    return report.report_insights(rows, report.settled_profile(rows, "event_id", profile.REPORT))


@query(
    "p17_legacy_insights",
    f"""WITH {MIXED_SQL}, told AS (
          SELECT 'o_orderkey' AS "column", 'variability' AS kind, round(stddev_samp(o_orderkey) / avg(o_orderkey) * 100, 1) AS value FROM mixed
          UNION ALL SELECT 'o_totalprice', 'variability', round(stddev_samp(o_totalprice) / avg(o_totalprice) * 100, 1) FROM mixed)
        SELECT * FROM told WHERE value > 50
        UNION ALL SELECT 'status', 'missing', round(count(status) * 100.0 / count(*), 1) FROM mixed HAVING count(status) * 100.0 / count(*) < 80""",
)
def _(spark, folder):
    return report.legacy_insights(mixed(spark, folder))


@query(
    "p18_type_counts",
    f"WITH t AS ({_types_sql(DATE_SHAPES, 200, 0.7, FORMATTED, 0.8)}) "
    """SELECT count(*) AS column_count, count(*) FILTER (detected_type = 'numeric') AS numeric_count,
              count(*) FILTER (detected_type = 'categorical') AS categorical_count,
              count(*) FILTER (detected_type = 'datetime') AS datetime_count,
              count(*) FILTER (detected_type = 'text') AS text_count, count(*) FILTER (detected_type = 'boolean') AS boolean_count FROM t""",
)
def _(spark, folder):
    return report.type_counts(profile.detected_types(mixed(spark, folder), "o_orderkey"))


@query(
    "p18_key_fields",
    f"""WITH {MIXED_SQL}, {FIGURES_SQL} SELECT position, "column", 'metric' AS type FROM figures WHERE total > 0
        UNION ALL SELECT 3, 'date_text', 'temporal' UNION ALL SELECT 6, 'priority', 'dimension' ORDER BY 1""",
)
def _(spark, folder):
    return report.key_fields(report.settled_profile(mixed(spark, folder), "o_orderkey"))


@query(
    "p18_data_quality",
    f"""WITH {MIXED_SQL}, {FIGURES_SQL} SELECT n AS row_count, CAST(8 AS BIGINT) AS column_count,
          round((cells - gaps) * 100.0 / cells, 2) AS completeness,
          n - (SELECT count(*) FROM (SELECT DISTINCT * FROM mixed)) AS duplicate_rows,
          'status' AS worst_column, gaps AS worst_missing FROM whole""",
)
def _(spark, folder):
    rows = mixed(spark, folder)
    return report.data_quality(rows, report.settled_profile(rows, "o_orderkey"))


@query(
    "p19_role_patterns",
    f"""WITH {MIXED_SQL} SELECT 'measure' AS type, 'o_orderkey averages ' || format('{{:.2f}}', avg(o_orderkey)) || ' across '
               || CAST(count(*) AS VARCHAR) || ' rows.' AS message, CAST(0.72 AS DOUBLE) AS confidence FROM mixed
        UNION ALL (SELECT 'distribution', 'status is led by ' || status || ' with ' || CAST(count(*) AS VARCHAR) || ' rows.', CAST(0.68 AS DOUBLE)
               FROM mixed WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)
        UNION ALL SELECT 'trend', 'date_text can be used to chart o_orderkey over time.', CAST(0.74 AS DOUBLE)""",
)
def _(spark, folder):
    rows = mixed(spark, folder)
    roles = profile.with_roles(profile.ratio_types(rows))
    averages = profile.numeric_aggregates(rows, profile.numeric_values(rows), ["mean"]).select("column", F.col("mean").alias("average"))
    return report.role_patterns(roles, averages, profile.top_values(rows, MIXED_TEXTS, 6))


# ---------------------------------------------------------------- grouped aggregates

STATUS = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderstatus END"


def _grouped(spark, folder):
    turn = F.col("o_orderkey") % 4
    status = F.when(turn == 1, "  ").when(turn > 1, F.col("o_orderstatus"))
    return table(spark, folder, "orders").select(
        "o_orderkey", status.alias("status"), F.when(turn != 2, F.col("o_totalprice")).alias("price"), "o_orderpriority", "o_orderdate"
    )


GROUPED_SQL = f"""
grouped AS (
  SELECT o_orderkey, {STATUS} AS status, CASE WHEN o_orderkey % 4 <> 2 THEN o_totalprice END AS price, o_orderpriority, o_orderdate FROM orders
)
"""
KNOWN = "coalesce(nullif(trim(status), ''), 'Unknown')"
METRICS = {
    "count": "CAST(count(*) AS DOUBLE)",
    "sum": "round(coalesce(sum(price), 0.0), 2)",
    "average": "round(coalesce(sum(price), 0.0) / count(*), 2)",
    "min": "coalesce(min(price), count(*))",
    "max": "coalesce(max(price), count(*))",
}
for _metric, _value in METRICS.items():

    @query(f"g1_group_{_metric}", f"WITH {GROUPED_SQL} SELECT {KNOWN} AS label, {_value} AS value FROM grouped GROUP BY 1")
    def _(spark, folder, metric=_metric):
        return aggregate.group_metric(_grouped(spark, folder), "status", "price", metric)


@query(
    "g1_group_average_of_numbers",
    f"WITH {GROUPED_SQL} SELECT {KNOWN} AS label, round(avg(price), 2) AS value FROM grouped GROUP BY 1",
)
def _(spark, folder):
    return aggregate.group_metric(_grouped(spark, folder), "status", "price", "average", average_all=False)


@query(
    "g1_smallest_groups",
    "SELECT CAST(l_suppkey AS VARCHAR) AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
)
def _(spark, folder):
    return aggregate.group_metric(table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice", "sum", direction="asc")


@query("g1_no_dimension", "SELECT 'Result' AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem")
def _(spark, folder):
    return aggregate.group_metric(table(spark, folder, "lineitem"), None, "l_extendedprice", "sum")


@query(
    "g2_group_labels",
    f"""WITH {GROUPED_SQL} SELECT trim(status) AS label, round(coalesce(sum(price), 0.0) / count(*), 2) AS value
        FROM grouped WHERE trim(status) <> '' GROUP BY 1""",
)
def _(spark, folder):
    return aggregate.group_labels(_grouped(spark, folder), "status", "price", "average")


@query("g3_count_per_value", f"WITH {GROUPED_SQL} SELECT trim(status) AS label, count(*) AS value FROM grouped WHERE trim(status) <> '' GROUP BY 1")
def _(spark, folder):
    return aggregate.count_per_value(_grouped(spark, folder), "status")


@query(
    "g4_count_per_year",
    f"WITH {DATES_SQL} SELECT CAST(raw AS INTEGER) AS year, count(*) AS value FROM dates WHERE regexp_matches(raw, '^\\d{{4}}$') GROUP BY 1",
)
def _(spark, folder):
    return aggregate.count_per_year(dates(spark, folder), "raw")


@query(
    "g5_mean_per_month",
    """SELECT strftime(o_orderdate, '%Y-%m') AS period, round(avg(o_totalprice), 2) AS value FROM orders
       GROUP BY 1 ORDER BY 1 LIMIT 24""",
)
def _(spark, folder):
    return aggregate.mean_per_month(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")


PARSED = "coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%Y/%m/%d'))"


@query(
    "g6_sum_per_month",
    f"""WITH {DATES_SQL}, t AS (SELECT CASE WHEN regexp_matches(raw, '^\\d{{4}}$') THEN raw || '-01' ELSE strftime({PARSED}, '%Y-%m') END AS period,
              o_totalprice FROM dates)
        SELECT period, round(sum(o_totalprice), 2) AS value FROM t WHERE period IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 12""",
)
def _(spark, folder):
    return aggregate.sum_per_month(dates(spark, folder), "raw", "o_totalprice")


@query("g7_mean_per_number", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def _(spark, folder):
    rows = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate"))
    return aggregate.mean_per_number(rows, "y", "o_totalprice").withColumn("value", F.round("value", 4))


@query(
    "g8_mean_per_category",
    "SELECT p_brand AS label, round(avg(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 10",
)
def _(spark, folder):
    return aggregate.mean_per_category(table(spark, folder, "part"), "p_brand", "p_retailprice")


@query(
    "g9_sum_per_category",
    f"WITH {GROUPED_SQL} SELECT {KNOWN} AS label, round(sum(coalesce(price, 0)), 2) AS value FROM grouped GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
)
def _(spark, folder):
    return aggregate.sum_per_category(_grouped(spark, folder), "status", "price")


@query(
    "g9_sum_in_order_of_appearance",
    """SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY min(p_partkey), 1 LIMIT 8""",
)
def _(spark, folder):
    return aggregate.sum_per_category(table(spark, folder, "part"), "p_brand", "p_retailprice", 8, first_seen_by="p_partkey")


def _segments_sql():
    parts = [
        f"""SELECT '{d}' AS dimension, '{m}' AS metric, * FROM (
              SELECT CAST({d} AS VARCHAR) AS segment, round(avg({m}), 2) AS mean, count({m}) AS count,
                     coalesce(round(stddev_samp({m}), 2), 0.0) AS std FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 10)"""
        for d in ("l_returnflag", "l_linestatus", "l_suppkey")
        for m in ("l_quantity", "l_extendedprice")
    ]
    return " UNION ALL ".join(parts)


@query("g10_segmentation", _segments_sql())
def _(spark, folder):
    return aggregate.segmentation(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_suppkey"], ["l_quantity", "l_extendedprice"]
    )


@query(
    "g11_result_summary",
    """WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
       SELECT count(*) AS row_count, round(min(value), 2) AS min, round(max(value), 2) AS max, round(avg(value), 2) AS mean,
              round(max(value) - min(value), 2) AS spread FROM r""",
)
def _(spark, folder):
    result = table(spark, folder, "orders").groupBy(month_of(F.col("o_orderdate")).alias("m")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value")
    )
    return aggregate.result_summary(result, "value")


@query(
    "g12_card_figures",
    f"""WITH {DIRTY_SQL}, t AS (SELECT {STRICT.format('raw')} AS x FROM dirty)
        SELECT round(avg(x), 2) AS average, round(min(x), 2) AS min, round(max(x), 2) AS max FROM t WHERE x < CAST('inf' AS DOUBLE)""",
)
def _(spark, folder):
    return aggregate.card_figures(dirty(spark, folder), "raw")
