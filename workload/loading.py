"""Sources, sinks, cleaning, scalar functions and filters."""

from pyspark.sql import functions as F

from facetframe.functions import dates as D, numbers as N, text as X
from facetframe.operators import charts, cleaning, filters
from facetframe.operators.aggregate import group_metric
from facetframe.plans import report
from facetframe.session import scratch_path
from facetframe.sources import store, tables
from workload.base import DATES_SQL, DIRTY_SQL, MIXED_SQL, dates, dirty, mixed, query, table

# ---------------------------------------------------------------- sources and sinks

QUOTED = "c_name || ', \"' || c_mktsegment || '\"'"


def _quoted(spark, folder):
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    return table(spark, folder, "customer").select("c_custkey", "c_acctbal", label.alias("label"))


@query("s1_csv_inferred", f"SELECT c_custkey, c_acctbal, {QUOTED} AS label FROM customer")
def _(spark, folder):
    path = scratch_path(spark, "csv")
    tables.write_csv(_quoted(spark, folder), path)
    return tables.read_csv(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_acctbal", "label")


@query(
    "s1_csv_text_cells",
    f"SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, {QUOTED} AS label FROM customer",
)
def _(spark, folder):
    path = scratch_path(spark, "csv")
    tables.write_csv(_quoted(spark, folder), path)
    return tables.read_csv_text(spark, path)


@query("s2_validated", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, folder):
    orders = tables.validated(table(spark, folder, "orders"), ["o_orderkey", "o_totalprice"])
    return orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "s3_preview",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
              CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment
       FROM customer ORDER BY customer.c_custkey LIMIT 100""",
)
def _(spark, folder):
    return tables.preview(table(spark, folder, "customer"), "c_custkey")


@query("s4_csv_export", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def _(spark, folder):
    path = scratch_path(spark, "export")
    lineitem = table(spark, folder, "lineitem")
    tables.write_csv(lineitem, path)
    again = tables.read_csv(spark, path, lineitem.schema, multi_line=False)
    return again.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "s5_statistics_report",
    """WITH q AS (
         SELECT quantile_cont(l_quantity, 0.25) a1, quantile_cont(l_quantity, 0.75) a3,
                quantile_cont(l_extendedprice, 0.25) b1, quantile_cont(l_extendedprice, 0.75) b3,
                quantile_cont(l_discount, 0.25) c1, quantile_cont(l_discount, 0.75) c3,
                quantile_cont(l_tax, 0.25) d1, quantile_cont(l_tax, 0.75) d3 FROM lineitem)
       SELECT 'lineitem' AS dataset_name, (SELECT count(*) FROM lineitem) AS total_rows,
              CAST(4 AS BIGINT) AS total_columns, CAST(16 AS BIGINT) AS correlation_cells,
              (SELECT count(*) FILTER (l_quantity < a1 - 1.5 * (a3 - a1) OR l_quantity > a3 + 1.5 * (a3 - a1))
                    + count(*) FILTER (l_extendedprice < b1 - 1.5 * (b3 - b1) OR l_extendedprice > b3 + 1.5 * (b3 - b1))
                    + count(*) FILTER (l_discount < c1 - 1.5 * (c3 - c1) OR l_discount > c3 + 1.5 * (c3 - c1))
                    + count(*) FILTER (l_tax < d1 - 1.5 * (d3 - d1) OR l_tax > d3 + 1.5 * (d3 - d1))
               FROM lineitem, q) AS outlier_total""",
)
def _(spark, folder):
    measures = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    document = report.statistics_report(measures, "lineitem")
    parsed = F.from_json(
        "report",
        "metadata struct<dataset_name string, total_rows bigint, total_columns bigint>, "
        "analysis struct<correlations array<struct<r double>>, outliers array<struct<outlier_count bigint>>>",
    )
    return document.select(parsed.alias("d")).select(
        "d.metadata.*",
        F.size("d.analysis.correlations").cast("bigint").alias("correlation_cells"),
        F.aggregate("d.analysis.outliers", F.lit(0).cast("bigint"), lambda a, o: a + o["outlier_count"]).alias(
            "outlier_total"
        ),
    )


@query(
    "s6_save_and_load",
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def _(spark, folder):
    path = scratch_path(spark, "dataset")
    tables.save(table(spark, folder, "orders"), path, ["o_orderstatus"])
    return tables.load(spark, path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "s7_latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
       WHERE r = 1""",
)
def _(spark, folder):
    latest = store.latest_per_key(table(spark, folder, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "s7_upsert",
    """WITH versions AS (
         SELECT o_orderkey, o_orderstatus, 1 AS version FROM orders
         UNION ALL SELECT o_orderkey, 'X', 2 FROM orders WHERE o_totalprice > 400000)
       SELECT o_orderkey, arg_max(o_orderstatus, version) AS o_orderstatus, max(version) AS version
       FROM versions GROUP BY 1""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    current = orders.select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    changes = orders.where("o_totalprice > 400000").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(2).alias("version"))
    return store.upsert(current, changes, ["o_orderkey"], ["version"])


@query(
    "s8_current_record",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_totalprice DESC, o_orderkey DESC LIMIT 1",
)
def _(spark, folder):
    newest = store.current_record(table(spark, folder, "orders"), ["o_orderdate", "o_totalprice", "o_orderkey"])
    return newest.select("o_orderkey", "o_custkey")


@query(
    "s9_recent_messages",
    "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 200",
)
def _(spark, folder):
    path = scratch_path(spark, "log")
    messages = table(spark, folder, "conversations")
    store.append_log(messages.where("role = 'user'"), path)
    store.append_log(messages.where("role <> 'user'"), path)
    return store.recent(tables.load(spark, path), ["conv_id", "turn"], 500).select("conv_id", "turn", "role")


@query("s10_history", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def _(spark, folder):
    return store.history(table(spark, folder, "conversations"), "conv_id", 3, "turn").select("conv_id", "turn", "role", "text")


@query(
    "s11_store_status",
    """SELECT 'orders' AS "table", count(*) AS row_count, CAST(max(o_orderdate) AS VARCHAR) AS last_update FROM orders
       UNION ALL SELECT 'conversations', count(*), NULL FROM conversations""",
)
def _(spark, folder):
    return store.status(
        {
            "orders": (table(spark, folder, "orders"), F.col("o_orderdate")),
            "conversations": (table(spark, folder, "conversations"), None),
        }
    )


# ---------------------------------------------------------------- cleaning


@query("c1_clean_headers", "SELECT o_orderkey AS Order_Key, o_totalprice AS Total_Price FROM orders")
def _(spark, folder):
    named = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias(" Order Key"), F.col("o_totalprice").alias("Total-Price ")
    )
    return cleaning.clean_headers(named)


@query("c1_clean_headers_legacy", "SELECT o_orderkey AS order_key, o_totalprice AS total_price FROM orders")
def _(spark, folder):
    named = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("Order - Key"), F.col("o_totalprice").alias("_Total  Price_")
    )
    return cleaning.clean_headers(named, legacy=True)


@query(
    "c2_coerce_numeric",
    """SELECT round(sum(c_acctbal), 2) AS balance, count(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 END) AS filled,
              count(DISTINCT CASE WHEN c_custkey % 100 = 1 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END) AS keys
       FROM customer""",
)
def _(spark, folder):
    texts = table(spark, folder, "customer").select(
        F.col("c_acctbal").cast("string").alias("balance"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(F.col("c_custkey") % 100 == 1, "n/a").otherwise(F.col("c_custkey").cast("string")).alias("key"),
    )
    coerced = cleaning.coerce_numeric_columns(texts)
    kinds = dict(coerced.dtypes)
    assert (kinds["balance"], kinds["nation"], kinds["key"]) == ("double", "double", "string")
    return coerced.agg(
        F.round(F.sum("balance"), 2).alias("balance"),
        F.count("nation").alias("filled"),
        F.count_distinct("key").alias("keys"),
    )


@query(
    "c3_formatted_number",
    f"""WITH {DIRTY_SQL}, t AS (
          SELECT o_orderkey, CASE WHEN trim(raw) IN ('', 'nan', 'None', 'null') THEN NULL ELSE trim(raw) END AS x FROM dirty)
        SELECT o_orderkey,
               TRY_CAST(regexp_replace(regexp_replace(x, '^\\((.*)\\)$', '-\\1'), '[^0-9.\\-+]', '', 'g') AS DOUBLE) AS number
        FROM t""",
)
def _(spark, folder):
    return dirty(spark, folder).select("o_orderkey", N.formatted_number(F.col("raw")).alias("number"))


STRICT_SQL = (
    "CASE WHEN regexp_matches(replace(trim({0}), ',', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') "
    "AND abs(TRY_CAST(replace(trim({0}), ',', '') AS DOUBLE)) < CAST('inf' AS DOUBLE) "
    "THEN TRY_CAST(replace(trim({0}), ',', '') AS DOUBLE) END"
)


@query("c4_strict_number", f"WITH {DIRTY_SQL} SELECT o_orderkey, {STRICT_SQL.format('raw')} AS number FROM dirty")
def _(spark, folder):
    return dirty(spark, folder).select("o_orderkey", N.strict_number(F.col("raw")).alias("number"))


LENIENT_SQL = """
lenient AS (
  SELECT o_orderkey, trim(raw) AS x, trim(raw) LIKE '(%)' AS b,
         regexp_replace(trim(raw), '[^0-9.\\-+]', '', 'g') AS kept FROM dirty
)
"""
LENIENT_VALUE = "TRY_CAST(CASE WHEN b AND kept <> '' AND kept NOT LIKE '-%' THEN '-' || kept ELSE kept END AS DOUBLE)"


@query("c5_lenient_number", f"WITH {DIRTY_SQL}, {LENIENT_SQL} SELECT o_orderkey, {LENIENT_VALUE} AS number FROM lenient")
def _(spark, folder):
    return dirty(spark, folder).select("o_orderkey", N.lenient_number(F.col("raw")).alias("number"))


@query(
    "c5_chart_number",
    f"WITH {DIRTY_SQL}, {LENIENT_SQL} SELECT o_orderkey, coalesce({LENIENT_VALUE}, 0.0) AS number FROM lenient",
)
def _(spark, folder):
    return dirty(spark, folder).select("o_orderkey", N.chart_number(F.col("raw")).alias("number"))


DAY = "strftime({}, '%Y-%m-%d')"
PARSED_SQL = """coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%Y/%m/%d'),
 CASE WHEN regexp_matches(raw, '^[0-9][0-9][0-9][0-9]$') THEN strptime(raw || '-01-01', '%Y-%m-%d') END, try_strptime(raw, '%d/%m/%Y'))"""


@query(
    "c6_lenient_timestamp",
    f"""WITH {DATES_SQL} SELECT o_orderkey,
          CASE WHEN regexp_matches(raw, '^\\d{{4}}$') THEN raw || '-01-01' ELSE {DAY.format(PARSED_SQL)} END AS day FROM dates""",
)
def _(spark, folder):
    at = D.lenient_timestamp(F.col("raw"))
    return dates(spark, folder).select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("day"))


@query(
    "c7_looks_like_date",
    f"""WITH {DATES_SQL} SELECT o_orderkey,
          regexp_matches(raw, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{2}}-\\d{{2}}-\\d{{4}})') AS profiler,
          regexp_matches(raw, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{2}}-\\d{{2}}-\\d{{4}}|\\d{{4}}/\\d{{2}}/\\d{{2}})') AS report
        FROM dates""",
)
def _(spark, folder):
    return dates(spark, folder).select(
        "o_orderkey",
        D.looks_like_date(F.col("raw")).alias("profiler"),
        D.looks_like_date(F.col("raw"), D.REPORT_DATE_SHAPES).alias("report"),
    )


@query(
    "c8_parse_date",
    f"WITH {DATES_SQL} SELECT o_orderkey, {DAY.format(PARSED_SQL)} AS day FROM dates WHERE {PARSED_SQL} IS NOT NULL",
)
def _(spark, folder):
    at = D.parse_date(F.col("raw"))
    return dates(spark, folder).select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("day")).dropna()


@query(
    "c9_key_form",
    "SELECT doc_id, md5(trim(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '_', 'g'), '_')) AS key FROM documents",
)
def _(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(X.key_form(F.col("text"))).alias("key"))


QUESTION_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[_-]+', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query("c10_question_form", f"SELECT conv_id, turn, {QUESTION_SQL.format('text')} AS question FROM conversations")
def _(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.question_form(F.col("text")).alias("question")
    )


@query(
    "c11_value_form",
    """SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS normal,
              upper(p_name[1]) || p_name[2:] AS capital FROM part""",
)
def _(spark, folder):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, folder, "part").select(
        "p_partkey", X.value_form(padded).alias("normal"), X.capitalised(F.col("p_name")).alias("capital")
    )


@query(
    "c12_title_label",
    """SELECT p_partkey,
              array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label
       FROM part""",
)
def _(spark, folder):
    joined = F.replace(F.concat("p_name", F.lit("_"), "p_type"), F.lit(" "), F.lit("_"))
    return table(spark, folder, "part").select("p_partkey", X.title_label(joined).alias("label"))


@query(
    "c13_known_label",
    """SELECT coalesce(nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE o_orderstatus END), ''), 'Unknown') AS label,
              count(*) AS n FROM orders GROUP BY 1""",
)
def _(spark, folder):
    turn = F.col("o_orderkey") % 4
    raw = F.when(turn == 1, "  ").when(turn > 1, F.col("o_orderstatus"))
    return table(spark, folder, "orders").groupBy(X.known_label(raw).alias("label")).agg(F.count("*").alias("n"))


@query("c14_month", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, folder):
    return table(spark, folder, "lineitem").groupBy(D.month_of(F.col("l_shipdate")).alias("month")).agg(
        F.count("*").alias("n")
    )


@query(
    "c15_meaningful_rows",
    """WITH t AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'null' ELSE o_orderstatus END AS a,
                         CASE o_orderkey % 3 WHEN 0 THEN 'undefined' WHEN 1 THEN NULL ELSE o_orderpriority END AS b FROM orders)
       SELECT a, b, count(*) AS n FROM t
       WHERE (a IS NOT NULL AND a NOT IN ('', 'null', 'undefined')) OR (b IS NOT NULL AND b NOT IN ('', 'null', 'undefined'))
       GROUP BY 1, 2""",
)
def _(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.when(k % 5 == 0, "").when(k % 5 == 2, "null").when(k % 5 > 2, F.col("o_orderstatus")).alias("a"),
        F.when(k % 3 == 0, "undefined").when(k % 3 == 2, F.col("o_orderpriority")).alias("b"),
    )
    return cleaning.meaningful_rows(rows).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "c16_complete_rows",
    """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
       WHERE o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0""",
)
def _(spark, folder):
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"),
    )
    return cleaning.complete_rows(rows, ["price", "status"]).agg(
        F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")
    )


@query(
    "c17_safe_float",
    f"""WITH {DIRTY_SQL}, t AS (SELECT o_orderkey, TRY_CAST(trim(raw) AS DOUBLE) AS x FROM dirty)
        SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 5 THEN CAST('inf' AS DOUBLE) WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE x END AS number FROM t""",
)
def _(spark, folder):
    return dirty(spark, folder).select("o_orderkey", N.safe_float(F.trim("raw")).alias("number"))


@query(
    "c18_display",
    """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS amount,
              format('{:.1f}', o_orderkey % 1000 / 8.0) || '%' AS share FROM orders""",
)
def _(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        X.grouped_number(F.col("o_totalprice")).alias("amount"),
        X.percent(F.col("o_orderkey") % 1000 / 8.0).alias("share"),
    )


@query(
    "c19_item_labels",
    """WITH t AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n,
                    CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS a,
                    CASE c_custkey % 2 WHEN 0 THEN NULL ELSE c_mktsegment END AS b FROM customer)
       SELECT c_custkey, coalesce(nullif(coalesce(a, b, CAST(n AS VARCHAR)), ''), 'Item ' || CAST(n AS VARCHAR)) AS name FROM t""",
)
def _(spark, folder):
    k = F.col("c_custkey")
    rows = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("c_name")).alias("a"),
        F.when(k % 2 == 1, F.col("c_mktsegment")).alias("b"),
    )
    return charts.labelled_rows(rows, ["a", "b"], "c_custkey").select("c_custkey", "name")


def _samples_sql(columns, k, order):
    parts = [
        f"""SELECT '{c}' AS "column", string_agg({c}, '|' ORDER BY r) AS samples FROM (
              SELECT {c}, row_number() OVER (ORDER BY {f'min({order}), {c}' if order else c}) AS r
              FROM mixed WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= {k}"""
        for c in columns
    ]
    return f"WITH {MIXED_SQL} " + " UNION ALL ".join(parts)


@query("c20_first_samples", _samples_sql(["status", "flag", "priority", "note", "date_text"], 5, "o_orderkey"))
def _(spark, folder):
    found = cleaning.sample_values(
        mixed(spark, folder), ["status", "flag", "priority", "note", "date_text"], 5, order_by="o_orderkey"
    )
    return found.select("column", F.concat_ws("|", "samples").alias("samples"))


@query("c20_smallest_samples", _samples_sql(["status", "flag", "priority", "note"], 3, None))
def _(spark, folder):
    found = cleaning.sample_values(mixed(spark, folder), ["status", "flag", "priority", "note"], 3)
    return found.select("column", F.concat_ws("|", "samples").alias("samples"))


# ---------------------------------------------------------------- filters


@query("f1_equals", "SELECT o_orderkey FROM orders WHERE lower(trim(o_orderpriority)) = '1-urgent'")
def _(spark, folder):
    return table(spark, folder, "orders").where(filters.equals("o_orderpriority", " 1-Urgent ")).select("o_orderkey")


@query(
    "f2_numeric_compare",
    f"WITH {DIRTY_SQL} SELECT o_orderkey FROM dirty WHERE {STRICT_SQL.format('raw')} > 200000",
)
def _(spark, folder):
    rows = dirty(spark, folder)
    return rows.where(filters.compares(rows, "raw", "gt", 200000)).select("o_orderkey")


@query(
    "f3_conjunction",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE lower(trim(l_returnflag)) = 'r' AND l_quantity >= 10 AND l_quantity < 40 AND l_discount <= 0.05""",
)
def _(spark, folder):
    rows = filters.apply_filters(
        table(spark, folder, "lineitem"),
        [("l_returnflag", "eq", "R"), ("l_quantity", "gte", 10), ("l_quantity", "lt", 40), ("l_discount", "lte", 0.05)],
    )
    return rows.select("l_orderkey", "l_linenumber")


@query(
    "f4_year_range",
    """WITH t AS (SELECT year(o_orderdate) AS y FROM orders)
       SELECT 'after' AS word, count(*) AS n FROM t WHERE y > 1997 UNION ALL
       SELECT 'since', count(*) FROM t WHERE y >= 1997 UNION ALL SELECT 'before', count(*) FROM t WHERE y < 1997""",
)
def _(spark, folder):
    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("y"))
    counted = [
        filters.year_range(years, "y", w, 1997).agg(F.count("*").alias("n")).select(F.lit(w).alias("word"), "n")
        for w in ("after", "since", "before")
    ]
    return counted[0].union(counted[1]).union(counted[2])


@query(
    "f5_membership",
    "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')",
)
def _(spark, folder):
    return table(spark, folder, "customer").where(filters.among("c_mktsegment", ["Building", "MACHINERY "])).select("c_custkey")


@query("f6_outside_bounds", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def _(spark, folder):
    customer = table(spark, folder, "customer")
    return customer.where(filters.outside(F.col("c_acctbal"), F.lit(0.0), F.lit(9000.0))).select("c_custkey", "c_acctbal")


@query("f7_four_digit_years", f"WITH {DATES_SQL} SELECT o_orderkey, raw FROM dates WHERE regexp_matches(raw, '^\\d{{4}}$')")
def _(spark, folder):
    return filters.four_digit_years(dates(spark, folder), "raw").select("o_orderkey", "raw")


@query(
    "f8_positive_slices",
    """SELECT * FROM (SELECT c_mktsegment AS label, round(sum(CASE WHEN c_nationkey < 12 THEN c_acctbal ELSE -c_acctbal END), 2) AS value
       FROM customer GROUP BY 1) WHERE value > 0""",
)
def _(spark, folder):
    signed = table(spark, folder, "customer").withColumn(
        "v", F.when(F.col("c_nationkey") < 12, F.col("c_acctbal")).otherwise(-F.col("c_acctbal"))
    )
    return filters.positive_slices(group_metric(signed, "c_mktsegment", "v", "sum", limit=None))
