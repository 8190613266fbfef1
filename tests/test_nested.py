"""JSON paths and funnels against brute force: nulls, ties, repeats, hot groups, broken cells, empty tables."""

import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetframe.operators.cleaning import parse_dates
from facetframe.operators.funnel import funnel
from facetframe.operators.json_paths import json_paths, path_failures, read_paths
from facetframe.operators.table_functions import folded, register
from facetframe.plans.summary import column_figures, summary_insights

CELLS = [
    '{"a": 1, "b": {"c": [1, 2.5, null]}, "x y": "t"}',
    '{"a": "q", "b": {}}',
    '{"a": null}',
    '{"a": 9223372036854775808}',
    '{"a": 2.5}',
    '{"a": 3.0, "a.b": 1}',
    "[]",
    "7",
    "null",
    "{bad",
    "",
    '{"a": 1, "a": 2}',
    '{"a": NaN}',
    "[" * 5000 + "]" * 5000,
    '{"a": "' + "long " * 50_000 + '"}',
    None,
]


def test_json_paths(spark):
    df = spark.createDataFrame([(c, 1) for c in CELLS * 2], "`j.s` string, path int").repartition(5)
    got = {r["path"]: r.asDict() for r in json_paths(df, "j.s").collect()}
    # The repeated key, NaN and the deep nest are broken beside the two plain ones.
    assert (got["$"]["cells"], got["$"]["broken"]) == (2 * 15, 2 * 5)
    assert got["$"]["type"] == "variant" and got["$"]["nulls"] == 2 and got["$"]["integers"] == 2
    a = got["$.a"]
    assert {k: a[k] for k in ("type", "cells", "nulls", "integers", "doubles", "strings")} == {
        "type": "variant", "cells": 14, "nulls": 2, "integers": 2, "doubles": 6, "strings": 4,
    }
    assert got["$.b.c[*]"]["type"] == "double" and got["$.b.c[*]"]["cells"] == 2 and got["$.b.c[*]"]["nulls"] == 2
    assert got['$["x y"]']["type"] == "string" and got['$["a.b"]']["type"] == "bigint"
    assert json_paths(df.limit(0), "j.s").count() == 0


def test_json_merge_of_random_cells(spark):
    r = random.Random(3)

    def value(depth):
        pick = r.randrange(8 if depth < 3 else 5)
        if pick < 5:
            return (None, True, r.randrange(5), 0.5, "s")[pick]
        return [value(depth + 1) for _ in range(r.randrange(4))] if pick < 6 else {k: value(depth + 1) for k in r.sample("abcd", r.randrange(4))}

    held = [value(0) for _ in range(300)]
    values, cells = Counter(), Counter()

    def walk(path, v, met):
        values[path] += 1
        met.add(path)
        for inner, w in v.items() if isinstance(v, dict) else []:
            walk(f"{path}.{inner}", w, met)
        for w in v if isinstance(v, list) else []:
            walk(f"{path}[*]", w, met)

    for v in held:
        met = set()
        walk("$", v, met)
        cells.update(met)
    df = spark.createDataFrame([(json.dumps(v),) for v in held], "j string")
    kinds = ("nulls", "booleans", "integers", "doubles", "strings", "objects", "arrays")
    for parts in (1, 7):
        got = json_paths(df.repartition(parts), "j").collect()
        assert {r["path"]: r["cells"] for r in got} == dict(cells)
        assert {r["path"]: sum(r[k] for k in kinds) for r in got} == dict(values)


def test_read_paths(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id int, j string").withColumn("a", F.lit("old"))
    paths = {"a": ("$.a", "bigint"), "c": ("$.b.c[1]", "double"), "x": ('$["x y"]', "string")}
    got = {r["id"]: r for r in read_paths(df, "j", paths).collect()}
    assert tuple(got[0])[2:] == (1, 2.5, "t", []) and read_paths(df, "j", paths).columns == ["id", "j", "a", "c", "x", "failures"]
    assert [got[i]["failures"] for i in (1, 2, 3, 4, 5, 15)] == [["a"], [], ["a"], ["a"], [], []]
    assert got[5]["a"] == 3 and got[4]["a"] is None and got[9]["failures"] == ["*"]
    counts = {r["name"]: r for r in path_failures(df, "j", paths).collect()}
    for row in counts.values():
        assert row["cells"] == 15 == row["broken"] + row["missing"] + row["nulls"] + row["typed"] + row["failed"]
    assert (counts["a"]["nulls"], counts["a"]["typed"], counts["a"]["failed"]) == (1, 2, 4)
    assert path_failures(df.limit(0), "j", paths).where("cells = 0").count() == 3


def brute_funnel(rows, matches, within):
    """Deepest step and its first time, by trying every start and taking the next row of each step."""
    rows = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
    best, first = 0, None
    for i, begin in enumerate(rows):
        if not matches[0](begin):
            continue
        place, done, at = i, 1, begin[1]
        while True:
            if done > best or (done == best and (first is None or at < first)):
                best, first = done, at
            following = [p for p in range(place + 1, len(rows)) if done < len(matches) and matches[done](rows[p])]
            if not following or rows[following[0]][1] - begin[1] > within:
                break
            place, done = following[0], done + 1
            at = rows[place][1]
    return best, first


@pytest.mark.parametrize("chunk", [1, 10, 10_000])
def test_funnel(spark, chunk):
    r = random.Random(11)
    kinds = "abcd"
    rows = [
        (i, r.choice((None, *range(100))), r.choice(("hot", "hot", "hot", "u", "v", None)), r.choice((None, *kinds)))
        for i in range(300)
    ]
    rows += [(900, 5, "never", "d"), (901, None, "timeless", "a"), (902, 7, "x", "a"), (902, 7, "x", "a")]
    df = spark.createDataFrame(rows, "id int, t long, reached string, kind string").withColumn("ts", F.timestamp_micros("t"))
    # The second and fourth steps are alike, and the third takes two kinds.
    steps = ["kind = 'a'", "kind = 'b'", "kind IN ('c', 'a')", "kind = 'b'", "kind = 'd'"]
    matches = [lambda x: x[3] == "a", lambda x: x[3] == "b", lambda x: x[3] in ("c", "a"), lambda x: x[3] == "b", lambda x: x[3] == "d"]
    for within in (0, 6, 30):
        wanted = {u: brute_funnel([x for x in rows if x[2] == u], matches, within) for u in {x[2] for x in rows}}
        got = funnel(df.withColumnRenamed("reached", "user"), ["user"], "ts", [F.expr(s) for s in steps], within, ["id"], chunk)
        found = {x["user"]: (x["reached"], x["micros"]) for x in got.withColumn("micros", F.unix_micros("reached_at")).collect()}
        assert found == wanted
    assert funnel(df.limit(0), ["kind"], "ts", [F.expr("id > 0")], 5).count() == 0
    with pytest.raises(ValueError):
        funnel(df, ["kind"], "ts", [], 5)


class Longest:
    """Most rows in a row that rise."""

    def __init__(self):
        self.k, self.last, self.run, self.best = None, None, 0, 0

    def add(self, batch):
        self.k = batch.column("k").slice(0, 1)
        for v in batch.column("v").to_pylist():
            self.run = self.run + 1 if self.last is not None and v > self.last else 1
            self.last, self.best = v, max(self.best, self.run)

    def result(self):
        return pa.table([self.k, pa.array([self.best], pa.int32())], names=["k", "best"])


def test_own_fold(spark):
    rows = [("a", 1, 5), ("a", 2, 6), ("a", 3, 1), ("b", 1, 1), (None, 1, 1), (None, 2, 2), (None, 3, 3)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(4)
    wanted = {("a", 2), ("b", 1), (None, 3)}
    assert {tuple(r) for r in folded(df, Longest, "k string, best int", ["k"], ["o"]).collect()} == wanted
    register(spark, "longest_rise", Longest, "k string, best int")
    df.createOrReplaceTempView("rises")
    assert {tuple(r) for r in spark.sql("SELECT * FROM longest_rise(TABLE(rises) PARTITION BY k ORDER BY o)").collect()} == wanted
    assert folded(df.limit(0), Longest, "k string, best int", ["k"], ["o"]).count() == 0


def test_summary_insights(spark):
    rows = [("", "x", None), ("1.5", "", "12d"), (None, None, "3"), ("-2", "x", "4"), ("1e3", "y", "4"), ("7", "a", "5")]
    df = spark.createDataFrame(rows, "`a.b` string, cat string, bad string")
    said = [r["message"] for r in summary_insights(df).collect()]
    # (1.5 - 2 + 1000 + 7) / 4; `12d` is no number, so the third column is a category too.
    assert said == [
        "a.b has an average value of 251.63 across 6 rows.",
        "a.b ranges from -2.00 to 1000.00.",
        "Top cat values: Unknown (2), x (2), a (1).",
    ]
    assert [r["place"] for r in summary_insights(df.select("cat")).collect()] == [2]
    assert [r["place"] for r in summary_insights(df.select("a.b".join("``"))).collect()] == [0, 1]
    figures = {r["column"]: r for r in column_figures(df).collect()}
    assert (figures["bad"]["filled"], figures["bad"]["numbers"]) == (5, 4)
    assert summary_insights(df.limit(0)).count() == 0


def test_one_date_order_per_column(spark):
    rows = [("05/01/2020", "05/01/2020", "31/01/2020"), ("31/01/2020", "12/12/2020", "01/31/2020"), (None, "bad", "05/01/2020"), ("2020-02-03", "", "")]
    df = spark.createDataFrame(rows, "`day.first` string, open string, both string")
    got = [[str(v)[:10] for v in r] for r in parse_dates(df, df.columns).collect()]
    assert got == [
        ["2020-01-05", "2020-05-01", "2020-01-31"],
        ["2020-01-31", "2020-12-12", "2020-01-31"],
        ["None", "None", "2020-05-01"],
        ["2020-02-03", "None", "None"],
    ]
    assert parse_dates(df.limit(0), ["open"]).count() == 0 and parse_dates(df, []).columns == df.columns
