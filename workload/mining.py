"""Message mining and events."""

from pyspark.sql import functions as F

from facetframe.operators import messages
from facetframe.streaming import events
from facetframe.streaming.throttle import throttle
from workload.base import ASKED_SQL, asked, query, table

# ---------------------------------------------------------------- messages

VALUE = "lower(trim(long_text))"
SPACED = f"regexp_replace({VALUE}, '\\s+', ' ', 'g')"
QUESTION = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(long_text), '[_-]+', ' ', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


def _rules_sql(text, rules, otherwise):
    arms = " ".join(f"WHEN regexp_matches({text}, '\\b({words})\\b') THEN '{label}'" for label, words in rules)
    return f"CASE {arms} ELSE {otherwise} END"


INTENTS = {
    "server": _rules_sql(VALUE, messages.SERVER_INTENTS, "'overview'"),
    "browser": _rules_sql(
        SPACED, messages.BROWSER_INTENTS, f"CASE WHEN contains({SPACED}, '?') THEN 'question' ELSE 'overview' END"
    ),
    "local": _rules_sql(
        QUESTION, [*messages.LOCAL_INTENTS[:2], ("filter", "after|before|since|only|where|with|in ")], "'aggregation'"
    ),
}
METRICS = {
    "server": _rules_sql(VALUE, messages.SERVER_METRICS, "'count'"),
    "browser": _rules_sql(SPACED, messages.BROWSER_METRICS, "'count'"),
    "local": _rules_sql(QUESTION, messages.LOCAL_METRICS, "'count'"),
}


def _all(rules):
    return f"WITH {ASKED_SQL} SELECT conv_id, turn, " + ", ".join(f"{v} AS {k}" for k, v in rules.items()) + " FROM asked"


@query("m1_intent", _all(INTENTS))
def _(spark, folder):
    text = F.col("long_text")
    return asked(spark, folder).select("conv_id", "turn", *[messages.intent(text, r).alias(r) for r in INTENTS])


@query("m2_metric", _all(METRICS))
def _(spark, folder):
    text = F.col("long_text")
    return asked(spark, folder).select("conv_id", "turn", *[messages.metric(text, r).alias(r) for r in METRICS])


def _hint_sql(text, order):
    return "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in order) + " END"


@query(
    "m3_chart_hint",
    _all({"browser": _hint_sql(SPACED, ("scatter", "pie", "line", "area", "bar")), "server": _hint_sql(VALUE, ("pie", "line", "scatter", "area"))}),
)
def _(spark, folder):
    text = F.col("long_text")
    return asked(spark, folder).select("conv_id", "turn", *[messages.chart_hint(text, r).alias(r) for r in ("browser", "server")])


@query("m4_sql_shape", _all({"shape": _rules_sql(VALUE, messages.SQL_SHAPES, "'default'")}))
def _(spark, folder):
    return asked(spark, folder).select("conv_id", "turn", messages.sql_shape(F.col("long_text")).alias("shape"))


FIRST_NUMBER = f"TRY_CAST(regexp_extract({VALUE}, '\\b(\\d+)\\b', 1) AS INTEGER)"


@query("m5_asked_limit", _all({"n": f"CASE WHEN {FIRST_NUMBER} BETWEEN 1 AND 100 THEN {FIRST_NUMBER} ELSE 5 END"}))
def _(spark, folder):
    return asked(spark, folder).select("conv_id", "turn", messages.asked_limit(F.col("long_text")).alias("n"))


AFTER = f"'\\b(after|since)\\s+(\\d{{4}})\\b'"


@query(
    "m6_year_conditions",
    _all(
        {
            "operator": f"CASE regexp_extract({QUESTION}, {AFTER}, 1) WHEN 'since' THEN 'gte' WHEN 'after' THEN 'gt' END",
            "year": f"TRY_CAST(regexp_extract({QUESTION}, {AFTER}, 2) AS INTEGER)",
            "before": f"TRY_CAST(regexp_extract({QUESTION}, '\\bbefore\\s+(\\d{{4}})\\b', 1) AS INTEGER)",
        }
    ),
)
def _(spark, folder):
    text = F.col("long_text")
    operator, year = messages.year_after(text)
    return asked(spark, folder).select(
        "conv_id", "turn", operator.alias("operator"), year.alias("year"), messages.year_before(text).alias("before")
    )


PAIR = "'\\b(.+?)\\s+(?:vs|versus)\\s+(.+)\\b'"


def _side(group):
    raw = f"regexp_extract({QUESTION}, {PAIR}, {group})"
    return f"nullif(trim(regexp_replace({raw}, '\\b(compare|show|between)\\b', '', 'g')), '')"


@query("m7_compared_pair", _all({"first_side": _side(1), "second_side": _side(2)}))
def _(spark, folder):
    first, second = messages.compared_pair(F.col("long_text"))
    return asked(spark, folder).select("conv_id", "turn", first.alias("first_side"), second.alias("second_side"))


COLUMNS = ["order_total", "price", "role", "status", "l_quantity", "release year", "type"]
KEY = "trim(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '_')"
LINK = "trim(regexp_replace(lower({0}), '[^a-z0-9]', ' ', 'g'))"


def _mentions_sql(form, test):
    arms = " UNION ALL ".join(
        f"""SELECT conv_id, turn, '{c}' AS "column" FROM texts WHERE {test(c)}""" for c in COLUMNS
    )
    return f"WITH {ASKED_SQL}, texts AS (SELECT conv_id, turn, {form} AS t FROM asked) {arms}"


def _server_test(c):
    name = c.replace(" ", "_")
    return f"contains(t, '{name}') OR contains(t, '{name.replace('_', '')}')"


def _linker_test(c):
    name = c.replace("_", " ")
    words = " AND ".join(f"contains(t, '{w}')" for w in name.split())
    return f"contains(t, '{name}') OR ({words})"


@query("m8_column_mentions", _mentions_sql(KEY.format("long_text"), _server_test))
def _(spark, folder):
    return messages.column_mentions(asked(spark, folder), "long_text", COLUMNS, ["conv_id", "turn"])


@query("m8_column_mentions_by_words", _mentions_sql(LINK.format("long_text"), _linker_test))
def _(spark, folder):
    return messages.column_mentions(asked(spark, folder), "long_text", COLUMNS, ["conv_id", "turn"], "linker")


@query("m8_column_mentions_as_written", _mentions_sql(SPACED, lambda c: f"contains(t, '{c}')"))
def _(spark, folder):
    return messages.column_mentions(asked(spark, folder), "long_text", COLUMNS, ["conv_id", "turn"], "browser")


def _alias_sql(groups, form, plain, linked):
    arms = []
    for c in COLUMNS:
        chain = []
        for group, words in groups.items():
            triggers = [w for w in words if linked(w, plain(c))] if linked else (words if any(w in plain(c) for w in words) else [])
            if triggers:
                hit = " OR ".join(f"contains(t, '{w}')" for w in triggers)
                chain.append(f"WHEN {hit} THEN '{group}'")
        if chain:
            arms.append(f"""SELECT conv_id, turn, '{c}' AS "column", CASE {' '.join(chain)} END AS alias FROM texts""")
    body = " UNION ALL ".join(arms)
    return f"WITH {ASKED_SQL}, texts AS (SELECT conv_id, turn, {form} AS t FROM asked) SELECT * FROM ({body}) WHERE alias IS NOT NULL"


@query(
    "m9_alias_mentions",
    _alias_sql(messages.ALIASES, LINK.format("long_text"), lambda c: c.replace("_", " "), None),
)
def _(spark, folder):
    return messages.alias_mentions(asked(spark, folder), "long_text", COLUMNS, ["conv_id", "turn"])


@query(
    "m9_alias_mentions_local",
    _alias_sql(messages.LOCAL_ALIASES, QUESTION, lambda c: c.replace("_", " "), lambda w, c: w in c or c in w),
)
def _(spark, folder):
    return messages.alias_mentions(asked(spark, folder), "long_text", COLUMNS, ["conv_id", "turn"], "local")


def _values_sql(form, other, ranked, left_out="false"):
    return f"""WITH {ASKED_SQL}, v AS (
        SELECT 'role' AS "column", role AS value FROM conversations GROUP BY 2
        UNION ALL SELECT 'lang', lang FROM documents GROUP BY 2),
      hits AS (SELECT conv_id, turn, v."column", v.value, row_number() OVER (PARTITION BY conv_id, turn, v."column" ORDER BY {ranked} v.value) AS r
               FROM asked, v WHERE contains({form}, {other}))
      SELECT conv_id, turn, "column", value FROM hits JOIN asked USING (conv_id, turn) WHERE r = 1 AND NOT ({left_out})"""


def _values(spark, folder, at_most=24):
    few = lambda name, columns: messages.low_cardinality_values(table(spark, folder, name), columns, at_most)
    return few("conversations", ["role", "text"]).unionByName(few("documents", ["lang", "text", *(["doc_id"] if at_most == 24 else [])]))


@query("m10_value_mentions", _values_sql(VALUE, "lower(trim(v.value))", ""))
def _(spark, folder):
    return messages.value_mentions(asked(spark, folder), "long_text", _values(spark, folder), ["conv_id", "turn"])


@query(
    "m10_longest_value_mentions",
    _values_sql(
        QUESTION,
        "lower(v.value)",
        "length(v.value) DESC,",
        f"coalesce({_side(1)} = lower(value), false) OR coalesce({_side(2)} = lower(value), false)",
    ),
)
def _(spark, folder):
    return messages.value_mentions(
        asked(spark, folder), "long_text", _values(spark, folder, 20), ["conv_id", "turn"], "browser"
    )


@query(
    "m11_recent_topics",
    """WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role = 'user'),
            w AS (SELECT conv_id, -b AS m, unnest(regexp_split_to_array(text, '\\s+')) AS raw,
                         unnest(range(len(regexp_split_to_array(text, '\\s+')))) AS p FROM r WHERE b <= 4),
            k AS (SELECT conv_id, lower(regexp_replace(raw, '[^\\w]', '', 'g')) AS word, min((m + 100) * 10000000 + p) AS seen FROM w GROUP BY 1, 2),
            f AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY seen) AS n FROM k WHERE length(word) > 3)
       SELECT conv_id, string_agg(word, ' ' ORDER BY n) AS topics FROM f WHERE n <= 6 GROUP BY 1""",
)
def _(spark, folder):
    found = messages.recent_topics(table(spark, folder, "conversations"), "conv_id", "turn")
    return found.select("conv_id", F.concat_ws(" ", "topics").alias("topics"))


# ---------------------------------------------------------------- events

HOUR_MS = 3_600_000


def _throttle_sql(keys, gap_seconds):
    """A recursive chain per key: the next kept event is the first one a gap after the last."""
    same = " AND ".join(f"e.{k} = c.{k}" for k in keys)
    cols = ", ".join(keys)
    return f"""WITH RECURSIVE o AS (
        SELECT {cols}, epoch_us(ts) AS t, min(event_id) AS event_id FROM events GROUP BY {cols}, epoch_us(ts)),
      chain AS (
        SELECT {cols}, min(t) AS t FROM o GROUP BY {cols}
        UNION ALL
        SELECT {', '.join('c.' + k for k in keys)}, (SELECT min(e.t) FROM o e WHERE {same} AND e.t >= c.t + {gap_seconds * 1_000_000}) FROM chain c WHERE c.t IS NOT NULL)
      SELECT o.event_id FROM o JOIN chain c ON {' AND '.join(f'o.{k} = c.{k}' for k in keys)} AND o.t = c.t"""


@query("e1_throttle_per_user", _throttle_sql(["user_id", "event_type"], 21600))
def _(spark, folder):
    kept = throttle(table(spark, folder, "events"), ["user_id", "event_type"], "ts", "event_id", 6 * HOUR_MS)
    return kept.select("event_id")


@query("e1_throttle_hot_keys", _throttle_sql(["event_type"], 1800))
def _(spark, folder):
    # Five keys hold all rows: each is spread over its chunks.
    kept = throttle(
        table(spark, folder, "events"), ["event_type"], "ts", "event_id", HOUR_MS // 2, 4 * HOUR_MS
    )
    return kept.select("event_id")


SESSION_SQL = """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 43200000000 THEN 1 ELSE 0 END AS n FROM events),
     s AS (SELECT user_id, ts, 1 + sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS events,
       greatest(1, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 + 0.5) AS BIGINT)) AS duration
FROM s GROUP BY 1, 2
"""


@query("e2_sessions", SESSION_SQL)
def _(spark, folder):
    found = events.sessions(table(spark, folder, "events"), "user_id", "ts", 43_200)
    return found.select("user_id", "session_no", "events", "duration")


@query("e3_delivery_batches", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 20 AS delivery FROM events")
def _(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "ts")
    return events.delivery_batches(rows, ["ts", "event_id"]).select("event_id", "delivery")


@query(
    "e4_envelope",
    """SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type || '_button' AS label,
              '/user/' || CAST(user_id AS VARCHAR) AS page, CAST(round(value) AS BIGINT) AS duration, json_extract_string(props, '$.k') AS k FROM events""",
)
def _(spark, folder):
    sent = events.envelope(
        table(spark, folder, "events"),
        "event_type",
        "ts",
        label=F.concat("event_type", F.lit("_button")),
        page=F.concat(F.lit("/user/"), F.col("user_id").cast("string")),
        extra="props",
        duration=F.round("value"),
        keep=["event_id"],
    )
    return sent.select(
        "event_id",
        "event_type",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "metadata.label",
        "metadata.page",
        "metadata.duration",
        F.col("metadata.extra")["k"].alias("k"),
    )
