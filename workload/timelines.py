"""Queries along time and over groups, sketches, samples and plans of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetframe.operators import profile
from facetframe.operators.intervals import overlap_join, points_in_spans
from facetframe.operators.lattice import cube_sets, grouping_sets, rollup_sets
from facetframe.operators.samples import stratified
from facetframe.operators.sketches import daily_sketches, estimates, merged
from facetframe.operators.timeline import asof_join, sliding
from facetframe.plans.question_plan import question_plans
from facetframe.session import scratch_path
from facetframe.streaming import events
from workload.base import ASKED_SQL, asked, query, table
from workload.mining import SESSION_SQL

HOUR = 3_600_000_000
DAY = 24 * HOUR


def shifted_orders(spark, folder):
    """Orders with dates 25 years later, around the events."""
    return table(spark, folder, "orders").withColumn("placed", F.add_months("o_orderdate", 300).cast("timestamp"))


SHIFTED_SQL = "shifted AS (SELECT *, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 300 MONTH AS placed FROM orders)"


@query(
    "n1_asof_order",
    f"""WITH {SHIFTED_SQL},
         found AS (SELECT event_id, max(row(placed, o_orderkey, o_totalprice)) AS o FROM events JOIN shifted ON o_custkey = user_id AND placed <= ts GROUP BY event_id)
       SELECT e.event_id, o[2] AS o_orderkey, o[3] AS o_totalprice FROM events e LEFT JOIN found f USING (event_id)""",
)
def _(spark, folder):
    found = asof_join(
        table(spark, folder, "events").select("event_id", "user_id", "ts"),
        shifted_orders(spark, folder).select("o_custkey", "placed", "o_orderkey", "o_totalprice"),
        [("user_id", "o_custkey")],
        "ts",
        "placed",
        ["o_orderkey", "o_totalprice"],
    )
    return found.select("event_id", "o_orderkey", "o_totalprice")


@query(
    "n1_asof_next_error",
    """SELECT event_id, epoch_us(min(CASE WHEN event_type = 'error' THEN ts END) OVER (
              ORDER BY ts RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 15 MINUTE FOLLOWING)) - epoch_us(ts) AS micros
       FROM events""",
)
def _(spark, folder):
    # No key: one time line over all rows, spread over its ranges.
    rows = table(spark, folder, "events").select("event_id", "ts", "event_type")
    errors = rows.where("event_type = 'error'").select(F.col("ts").alias("error_at"))
    found = asof_join(rows, errors, [], "ts", "error_at", ["error_at"], forward=True, exact=False, within=HOUR // 4)
    return found.select("event_id", (F.unix_micros(F.col("error_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


@query(
    "n2_events_after_error",
    """SELECT a.event_id AS error_id, b.event_id AS event_id FROM events a JOIN events b
       ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY WHERE a.event_type = 'error'""",
)
def _(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts")
    spans = rows.where("event_type = 'error'").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("until"))
    columns = {"error_id": "l.event_id", "event_id": "r.event_id"}
    return points_in_spans(spans, rows.select("event_id", "user_id", "ts"), [("user_id", "user_id")], ("ts", "until"), "ts", columns)


@query(
    "n2_orders_before_event",
    f"""WITH {SHIFTED_SQL}, spans AS (
         SELECT event_id, user_id, ts - to_days(CAST(3 ** (event_id % 7) AS INT)) AS since, ts FROM events)
       SELECT event_id, count(*) AS orders, sum(o_orderkey)::BIGINT AS keys FROM spans JOIN shifted
       ON o_custkey = user_id AND placed BETWEEN since AND ts GROUP BY event_id""",
)
def _(spark, folder):
    # Spans from a day to two years: levels of cells from fine to coarse.
    days = F.pow(F.lit(3), F.col("event_id") % 7).cast("int")
    spans = table(spark, folder, "events").select("event_id", "user_id", "ts", days.alias("days"))
    spans = spans.withColumn("since", F.col("ts") - F.make_interval(days="days")).drop("days")
    points = shifted_orders(spark, folder).select("o_custkey", "o_orderkey", "placed")
    met = points_in_spans(
        spans, points, [("user_id", "o_custkey")], ("since", "ts"), "placed", {"event_id": "l.event_id", "o_orderkey": "r.o_orderkey"}
    )
    return met.groupBy("event_id").agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys"))


@query(
    "n2_overlapping_sessions",
    f"""WITH s AS ({SESSION_SQL.strip().replace("count(*) AS events,", "min(ts) AS a, max(ts) AS b,")})
       SELECT p.user_id, p.session_no, q.user_id AS other, q.session_no AS other_no FROM s p JOIN s q
       ON p.user_id // 10 = q.user_id // 10 AND p.user_id < q.user_id AND p.a <= q.b AND q.a <= p.b""",
)
def _(spark, folder):
    found = events.sessions(table(spark, folder, "events"), "user_id", "ts", 43_200)
    some = found.select("user_id", "session_no", "first_at", "last_at", F.floor(F.col("user_id") / 10).alias("team"))
    columns = {"user_id": "l.user_id", "session_no": "l.session_no", "other": "r.user_id", "other_no": "r.session_no"}
    span = ("first_at", "last_at")
    return overlap_join(some, some, [("team", "team")], span, span, columns).where("user_id < other")


def _sliding_sql(key: str, interval: str, counted: str) -> str:
    return f"""
SELECT DISTINCT {key}, epoch_us(ts) AS at, count(*) OVER w AS n, round(sum(value) OVER w, 2) AS total, min(value) OVER w AS least,
       max(value) OVER w AS most, count(DISTINCT {counted}) OVER w AS n_distinct
FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)
"""


def _sliding(spark, folder, key, span, counted):
    found = sliding(table(spark, folder, "events").select(key, "ts", "value", counted), [key], "ts", "value", span, counted)
    return found.select(
        key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "n", F.round("total", 2).alias("total"), "least", "most", "n_distinct"
    )


@query("n3_sliding_week", _sliding_sql("user_id", "7 DAY", "event_type"))
def _(spark, folder):
    return _sliding(spark, folder, "user_id", 7 * DAY, "event_type")


@query("n3_sliding_hot_keys", _sliding_sql("event_type", "1 DAY", "user_id"))
def _(spark, folder):
    # Five keys hold all rows.
    return _sliding(spark, folder, "event_type", DAY, "user_id")


def _sets_sql(sets: str) -> str:
    return f"""
SELECT l_returnflag, l_linestatus, month, CAST(grouping(l_returnflag, l_linestatus, month) AS INT) AS grouping_id,
       CAST(round(sum(l_quantity)) AS BIGINT) AS quantity, count(*) AS lines, min(l_discount) AS least, max(l_extendedprice) AS most,
       count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate) AS days
FROM (SELECT *, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem) GROUP BY {sets}
"""


def _lineitem_sets(spark, folder, sets):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        "l_quantity",
        "l_discount",
        "l_extendedprice",
        "l_suppkey",
        F.unix_date(F.col("l_shipdate").cast("date")).alias("day"),
    )
    measures = {"quantity": ("sum", "l_quantity"), "lines": ("count", "*"), "least": ("min", "l_discount"), "most": ("max", "l_extendedprice")}
    found = grouping_sets(rows, sets, measures, {"suppliers": "l_suppkey", "days": "day"})
    return found.withColumn("quantity", F.round("quantity").cast("long"))


LINE_DIMENSIONS = ["l_returnflag", "l_linestatus", "month"]


@query("n4_cube", _sets_sql("CUBE (l_returnflag, l_linestatus, month)"))
def _(spark, folder):
    return _lineitem_sets(spark, folder, cube_sets(LINE_DIMENSIONS))


@query("n4_rollup", _sets_sql("ROLLUP (l_returnflag, l_linestatus, month)"))
def _(spark, folder):
    return _lineitem_sets(spark, folder, rollup_sets(LINE_DIMENSIONS))


@query(
    "n4_grouping_sets_of_texts",
    """SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS grouping_id, count(*) AS orders,
              count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS days
       FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
)
def _(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )
    return grouping_sets(rows, [["o_orderstatus"], ["o_orderpriority"], []], {"orders": ("count", "*")}, {"days": "day"})


@query(
    "n6_sketches_by_week",
    """SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near,
              true AS median_near, true AS labels_near
       FROM events GROUP BY ALL""",
)
def _(spark, folder):
    """Weeks merged from daily sketches that were written, held against exact values."""
    rows = table(spark, folder, "events").select("event_type", "ts", "value", "user_id", "props")
    path = scratch_path(spark, "daily-sketches")
    daily_sketches(rows, ["event_type"], "ts", "value", "user_id", "props").write.parquet(path)
    stored = spark.read.parquet(path)
    week = F.date_trunc("week", F.col("day")).cast("date")
    known = estimates(merged(stored, ["event_type"], week, "week"), [0.5], 1)
    exact = rows.withColumn("week", F.date_trunc("week", "ts").cast("date"))
    users = exact.groupBy("event_type", "week").agg(F.count_distinct("user_id").alias("users"))
    labels = exact.groupBy("event_type", "week", "props").agg(F.count("*").alias("c")).groupBy("event_type", "week").agg(F.max("c").alias("most"))
    # The share of values up to the estimated median.
    middle = known.select("event_type", "week", F.col("quantiles")[0].alias("median"))
    ranks = exact.join(middle, ["event_type", "week"]).groupBy("event_type", "week").agg(
        F.avg((F.col("value") <= F.col("median")).cast("int")).alias("rank")
    )
    whole = known.join(users, ["event_type", "week"]).join(labels, ["event_type", "week"]).join(ranks, ["event_type", "week"])
    return whole.select(
        "event_type",
        "week",
        "n",
        "users",
        (F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.08)).alias("users_near"),
        F.col("rank").between(0.45, 0.55).alias("median_near"),
        (F.col("frequent")[0]["n"] == F.col("most")).alias("labels_near"),
    )


@query(
    "n7_stratified_documents",
    """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (
         PARTITION BY lang, source ORDER BY substr(md5('s1' || doc_id), 1, 15)) AS place FROM documents) WHERE place <= 7""",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return stratified(rows, ["lang", "source"], "doc_id", 7, seed="s1")


@query(
    "n7_weighted_documents",
    """SELECT doc_id, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY
         ln(-ln((CAST('0x' || substr(md5('s2' || doc_id), 1, 15) AS BIGINT) // 256 + 0.5) / 4503599627370496.0)) - ln(n_chars)) AS place
       FROM documents WHERE n_chars > 0) WHERE place <= 40""",
)
def _(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return stratified(rows, ["lang"], "doc_id", 40, weight="n_chars", seed="s2")


def _plan_sql() -> str:
    """Plans of the asked messages over the columns of orders, whose roles are the same at every scale."""
    columns = (
        ("o_orderkey", "measure", True),
        ("o_custkey", "dimension", True),
        ("o_orderstatus", "dimension", False),
        ("o_totalprice", "measure", True),
        ("o_orderdate", "time", False),
        ("o_orderpriority", "dimension", False),
    )
    listed = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, '{role}' AS role, {str(number).lower()} AS number, "
        f"count(DISTINCT {c}) AS uniques, count(*) AS n FROM orders"
        for i, (c, role, number) in enumerate(columns)
    )
    named = "contains(key, name)"
    said = "contains(form, replace(name, '_', ' '))"
    return f"""
WITH {ASKED_SQL}, cat AS MATERIALIZED ({listed}),
texts AS (SELECT conv_id, turn, lower(question) AS low,
                 trim(regexp_replace(lower(question), '[^a-z0-9]+', '_', 'g'), '_') AS key,
                 trim(regexp_replace(regexp_replace(regexp_replace(lower(question), '[_-]+', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS form
          FROM asked),
met AS (
  SELECT t.*, position, name,
         CASE WHEN role = 'measure' THEN CASE WHEN {named} THEN 0 ELSE 1 END END AS r1,
         CASE WHEN role = 'dimension' THEN CASE WHEN {named} THEN 0 ELSE 2 END
              WHEN role = 'time' THEN CASE WHEN {named} THEN 1 ELSE 3 END END AS r2,
         CASE WHEN regexp_matches(name, '(year|date|month|day|time)') THEN CASE WHEN {said} THEN 0 ELSE 1 END END AS r3,
         CASE WHEN {said} THEN 0
              WHEN regexp_matches(form, '\\b(country|type|rating)\\b') THEN CASE WHEN NOT number AND NOT regexp_matches(name, '(id|index)') THEN 2 END
              WHEN NOT number AND uniques <= greatest(12, ceil(n * 0.5)) THEN 3 + uniques END AS r4
  FROM texts t CROSS JOIN cat)
SELECT conv_id, turn,
       CASE WHEN regexp_matches(any_value(low), '\\b(avg|average|mean)\\b') THEN 'average'
            WHEN regexp_matches(any_value(low), '\\b(min|lowest|smallest|least)\\b') THEN 'min'
            WHEN regexp_matches(any_value(low), '\\b(max|highest|largest|top|most)\\b') THEN 'max'
            WHEN regexp_matches(any_value(low), '\\b(sum|total|revenue|sales|amount)\\b') THEN 'sum' ELSE 'count' END AS metric,
       arg_min(name, r1 * 1000 + position) AS measure, arg_min(name, r2 * 1000 + position) AS dimension,
       arg_min(name, r3 * 1000 + position) AS "time", arg_min(name, r4 * 1000 + position) AS grouped_by
FROM met GROUP BY conv_id, turn
"""


@query("m12_question_plan", _plan_sql())
def _(spark, folder):
    catalog = profile.with_roles(profile.ratio_types(table(spark, folder, "orders")))
    return question_plans(asked(spark, folder), "question", catalog, ["conv_id", "turn"])
