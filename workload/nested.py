"""Queries over JSON cells and funnels of event steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetframe.operators.cleaning import parse_dates
from facetframe.operators.funnel import funnel
from facetframe.operators.json_paths import json_paths, path_failures, read_paths
from facetframe.plans.summary import summary_insights
from workload.base import query, table

HOUR = 3_600_000_000
DAY = 24 * HOUR

# JSON of several shapes out of every event, by the same expressions on both sides.
CELLS_SQL = """
cells AS (
  SELECT event_id, CASE event_id % 6
      WHEN 0 THEN props
      WHEN 1 THEN '{"k": ' || CAST(value AS VARCHAR) || ', "user": {"id": ' || user_id || ', "tags": ["' || event_type || '", ' || event_id % 7 || ']}}'
      WHEN 2 THEN '{"k": "' || event_type || '", "user": null}'
      WHEN 3 THEN '{"k": '
      WHEN 4 THEN '[{"id": ' || user_id || '}, {"id": true}, {}]'
      ELSE NULL END AS props
  FROM events
)
"""


def cells(spark, folder):
    turn, kind = F.col("event_id") % 6, F.col("event_type")
    user = F.col("user_id").cast("string")
    nested = ('{"k": ', F.col("value").cast("string"), ', "user": {"id": ', user, ', "tags": ["', kind, '", ', (F.col("event_id") % 7).cast("string"), "]}}")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shaped = (
        F.when(turn == 0, F.col("props"))
        .when(turn == 1, text(*nested))
        .when(turn == 2, text('{"k": "', kind, '", "user": null}'))
        .when(turn == 3, '{"k": ')
        .when(turn == 4, text('[{"id": ', user, '}, {"id": true}, {}]'))
    )
    return table(spark, folder, "events").select("event_id", shaped.alias("props"))


def _paths_sql(source: str) -> str:
    return f"""
, valid AS (SELECT event_id, CAST(props AS JSON) AS j FROM {source} WHERE json_valid(props)),
nodes AS (
  SELECT event_id, regexp_replace(t.fullkey, '\\[\\d+\\]', '[*]', 'g') AS path, t.type AS kind FROM valid v, json_tree(v.j) t
),
counted AS (
  SELECT path, count(DISTINCT event_id) AS cells, count(*) FILTER (kind = 'NULL') AS nulls, count(*) FILTER (kind = 'BOOLEAN') AS booleans,
         count(*) FILTER (kind IN ('BIGINT', 'UBIGINT')) AS integers, count(*) FILTER (kind = 'DOUBLE') AS doubles,
         count(*) FILTER (kind = 'VARCHAR') AS strings, count(*) FILTER (kind = 'OBJECT') AS objects, count(*) FILTER (kind = 'ARRAY') AS arrays
  FROM nodes GROUP BY path
),
unread AS (SELECT count(*) AS n FROM {source} WHERE props IS NOT NULL AND NOT json_valid(props))
SELECT path,
       CASE WHEN booleans + integers + doubles + strings + objects + arrays = 0 THEN 'void'
            WHEN booleans + strings + objects + arrays = 0 THEN CASE WHEN doubles > 0 THEN 'double' ELSE 'bigint' END
            WHEN integers + doubles + strings + objects + arrays = 0 THEN 'boolean'
            WHEN booleans + integers + doubles + objects + arrays = 0 THEN 'string'
            WHEN booleans + integers + doubles + strings + arrays = 0 THEN 'object'
            WHEN booleans + integers + doubles + strings + objects = 0 THEN 'array'
            ELSE 'variant' END AS type,
       cells + CASE WHEN path = '$' THEN n ELSE 0 END AS cells, CASE WHEN path = '$' THEN n ELSE 0 END AS broken,
       nulls, booleans, integers, doubles, strings, objects, arrays
FROM counted, unread
"""


@query("n8_json_paths", "WITH props AS (SELECT event_id, props FROM events)" + _paths_sql("props"))
def _(spark, folder):
    return json_paths(table(spark, folder, "events"), "props")


@query("n8_json_paths_mixed", f"WITH {CELLS_SQL}" + _paths_sql("cells"))
def _(spark, folder):
    return json_paths(cells(spark, folder), "props")


TYPED = {
    "k": ("$.k", "bigint"),
    "user_id": ("$.user.id", "bigint"),
    "tag": ("$.user.tags[0]", "string"),
    "first_id": ("$[0].id", "bigint"),
}
_TYPED_SQL = f"""
WITH {CELLS_SQL},
read AS (
  SELECT event_id, props, json_valid(props) AS ok,
         CASE WHEN json_valid(props) THEN json_type(props, '$.k') END AS k_kind, CASE WHEN json_valid(props) THEN props ->> '$.k' END AS k_text,
         CASE WHEN json_valid(props) THEN CAST(props ->> '$.user.id' AS BIGINT) END AS user_id,
         CASE WHEN json_valid(props) THEN props ->> '$.user.tags[0]' END AS tag,
         CASE WHEN json_valid(props) THEN CAST(props ->> '$[0].id' AS BIGINT) END AS first_id
  FROM cells
),
typed AS (
  SELECT *, CASE WHEN k_kind IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(k_text AS DOUBLE) = floor(CAST(k_text AS DOUBLE))
                 THEN CAST(CAST(k_text AS DOUBLE) AS BIGINT) END AS k FROM read
)
"""


@query(
    "n8_json_read",
    _TYPED_SQL
    + """SELECT event_id, k, user_id, tag, first_id,
                CASE WHEN props IS NOT NULL AND NOT ok THEN '*' WHEN k_kind IS NOT NULL AND k IS NULL THEN 'k' ELSE '' END AS failures
         FROM typed""",
)
def _(spark, folder):
    rows = read_paths(cells(spark, folder), "props", TYPED)
    return rows.select("event_id", *TYPED, F.array_join(F.coalesce("failures", F.array()), ",").alias("failures"))


@query(
    "n8_json_failures",
    _TYPED_SQL
    + """, held AS (SELECT * FROM typed WHERE props IS NOT NULL),
         named AS (
           SELECT 'k' AS name, ok, k_kind IS NOT NULL AS here, k IS NOT NULL AS good FROM held
           UNION ALL SELECT 'user_id', ok, user_id IS NOT NULL, user_id IS NOT NULL FROM held
           UNION ALL SELECT 'tag', ok, tag IS NOT NULL, tag IS NOT NULL FROM held
           UNION ALL SELECT 'first_id', ok, first_id IS NOT NULL, first_id IS NOT NULL FROM held)
         SELECT name, count(*) AS cells, count(*) FILTER (NOT ok) AS broken, count(*) FILTER (ok AND NOT here) AS missing, 0::BIGINT AS nulls,
                count(*) FILTER (good) AS typed, count(*) FILTER (here AND NOT good) AS failed FROM named GROUP BY name""",
)
def _(spark, folder):
    return path_failures(cells(spark, folder), "props", TYPED)


def _funnel_sql(key: str, steps: list[str], interval: str) -> str:
    ctes = [f"l1 AS (SELECT event_id, {key}, ts, event_type, value, CASE WHEN {steps[0]} THEN ts END AS s1 FROM events)"]
    for m, step in enumerate(steps[1:], start=2):
        ctes.append(
            f"p{m} AS (SELECT *, max(s{m - 1}) OVER (PARTITION BY {key} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b{m} FROM l{m - 1}),"
            f" l{m} AS (SELECT *, CASE WHEN {step} AND ts - b{m} <= INTERVAL {interval} THEN b{m} END AS s{m} FROM p{m})"
        )
    deepest = range(len(steps), 0, -1)
    reached = " ".join(f"WHEN count(s{m}) > 0 THEN {m}" for m in deepest)
    at = " ".join(f"WHEN count(s{m}) > 0 THEN min(CASE WHEN s{m} IS NOT NULL THEN epoch_us(ts) END)" for m in deepest)
    return f"WITH {', '.join(ctes)} SELECT {key}, CASE {reached} ELSE 0 END AS reached, CASE {at} END AS micros FROM l{len(steps)} GROUP BY {key}"


def _funnel(spark, folder, key, steps, within):
    found = funnel(table(spark, folder, "events"), [key], "ts", [F.expr(s) for s in steps], within, order=["event_id"])
    return found.select(key, "reached", F.unix_micros("reached_at").alias("micros"))


_BUYING = ["event_type = 'signup'", "event_type = 'view'", "event_type = 'click'", "event_type = 'purchase'"]


@query("n9_funnel_users", _funnel_sql("user_id", _BUYING, "2 DAY"))
def _(spark, folder):
    return _funnel(spark, folder, "user_id", _BUYING, 2 * DAY)


# Seven groups hold all events, and a step comes back twice.
_AGAIN = ["event_type = 'error'", "event_type = 'view' AND value > 50", "event_type = 'error' AND value > 50", "event_type = 'error'", "value > 190"]


@query("n9_funnel_hot_groups", _funnel_sql("event_group", _AGAIN, "3 HOUR").replace("event_group, ts", "user_id % 7 AS event_group, ts"))
def _(spark, folder):
    rows = table(spark, folder, "events").withColumn("event_group", F.col("user_id") % 7)
    found = funnel(rows, ["event_group"], "ts", [F.expr(s) for s in _AGAIN], 3 * HOUR, order=["event_id"])
    return found.select("event_group", "reached", F.unix_micros("reached_at").alias("micros"))


_SUMMARY_SQL = """
, figures AS (SELECT count(*) AS n, avg({measure}) AS mean, CAST(min({measure}) AS DOUBLE) AS lo, CAST(max({measure}) AS DOUBLE) AS hi FROM {source}),
most AS (SELECT coalesce(nullif({category}, ''), 'Unknown') AS v, count(*) AS c FROM {source} GROUP BY 1 ORDER BY c DESC, v LIMIT 3)
SELECT 0 AS place, '{name} has an average value of ' || format('{{:.2f}}', mean) || ' across ' || n || ' rows.' AS message FROM figures
UNION ALL SELECT 1, '{name} ranges from ' || format('{{:.2f}}', lo) || ' to ' || format('{{:.2f}}', hi) || '.' FROM figures
UNION ALL SELECT 2, 'Top {category} values: ' || string_agg(v || ' (' || c || ')', ', ' ORDER BY c DESC, v) || '.' FROM most
"""
_ORDER_CELLS_SQL = """WITH cells AS (
  SELECT CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END AS price,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE nullif(o_orderstatus, 'F') END AS status FROM orders)"""


@query(
    "p17_summary_insights",
    _ORDER_CELLS_SQL + _SUMMARY_SQL.format(measure="TRY_CAST(nullif(price, '') AS DOUBLE)", name="price", category="status", source="cells"),
)
def _(spark, folder):
    key = F.col("o_orderkey")
    price = F.when(key % 5 == 0, "").when(key % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice").cast("string"))
    status = F.when(key % 3 == 0, "").otherwise(F.nullif("o_orderstatus", F.lit("F")))
    return summary_insights(table(spark, folder, "orders").select(price.alias("price"), status.alias("status")))


@query(
    "p17_summary_insights_events",
    "WITH cells AS (SELECT * FROM events)" + _SUMMARY_SQL.format(measure="event_id", name="event_id", category="event_type", source="cells"),
)
def _(spark, folder):
    return summary_insights(table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props"))


@query(
    "c8_parse_date_columns",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS european, strftime(o_orderdate, '%Y-%m-%d') AS american,
              CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dashed FROM orders""",
)
def _(spark, folder):
    at = F.col("o_orderdate").cast("timestamp")
    dashed = F.when(F.col("o_orderkey") % 9 > 0, F.date_format(at, "dd-MM-yyyy")).otherwise("unknown")
    columns = {"european": F.date_format(at, "dd/MM/yyyy"), "american": F.date_format(at, "MM/dd/yyyy"), "dashed": dashed}
    rows = table(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in columns.items()])
    return parse_dates(rows, list(columns)).select("o_orderkey", *[F.date_format(n, "yyyy-MM-dd").alias(n) for n in columns])
