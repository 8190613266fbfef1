"""As-of joins, spans, sliding frames and grouping sets against brute force.

Every case holds null keys and times, ties, repeated rows, one key with most rows,
and is run over few and many ranges.
"""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from facetframe.operators.intervals import overlap_join, points_in_spans
from facetframe.operators.lattice import cube_sets, grouping_sets, rollup_sets
from facetframe.operators.scan import running
from facetframe.operators.timeline import asof_join, sliding

ORDERED = lambda rows: sorted(map(tuple, rows), key=str)


def key(r):
    return r.choice(("hot", "hot", "hot", "a", "b", None))


def test_running_folds(spark):
    r = random.Random(1)
    rows = [(key(r), i, r.choice((None, r.randrange(100)))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, v long").repartition(6)
    folds = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "v2": ("last", "v")}
    for before in (False, True):
        wanted, seen = [], defaultdict(list)
        for k, t, v in rows:
            mine = seen[k] + ([] if before else [v])
            known = [x for x in mine if x is not None]
            wanted.append((k, t, v, sum(known) if known else None, min(known, default=None), max(known, default=None), known[-1] if known else None))
            seen[k].append(v)
        for parts in (1, 3, 23):
            got = running(df, ["k"], [F.col("t")], folds, strictly_before=before, partitions=parts)
            assert ORDERED(got.collect()) == ORDERED(wanted)
    assert running(df.limit(0), ["k"], [F.col("t")], folds).count() == 0


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("within", [None, 5])
def test_asof(spark, forward, exact, within):
    r = random.Random(7)
    left = [(key(r), r.choice((None, *range(60))), i) for i in range(200)]
    left += left[:4]
    right = [(key(r), r.choice((None, *range(0, 60, 3))), r.choice((None, r.randrange(9))), "x") for _ in range(120)]

    def found(k, t):
        if k is None or t is None:
            return None
        sign = -1 if forward else 1
        fits = [
            x for x in right
            if x[0] == k and x[1] is not None and sign * x[1] <= sign * t and (exact or x[1] != t)
        ]
        if not fits:
            return None
        best = max(fits, key=lambda x: (sign * x[1], x[2] is not None, x[2] or 0))
        return None if within is not None and abs(t - best[1]) > within else best[2]

    a = spark.createDataFrame(left, "k string, t long, i long").repartition(5)
    b = spark.createDataFrame(right, "q string, u long, v long, k string").repartition(4)
    wanted = [(k, t, i, found(k, t)) for k, t, i in left]
    for parts in (1, 19):
        got = asof_join(a, b, [("k", "q")], "t", "u", ["v"], "r_", forward, exact, within, partitions=parts)
        assert got.columns == ["k", "t", "i", "r_v"]
        assert ORDERED(got.collect()) == ORDERED(wanted)
    assert asof_join(a.limit(0), b, [("k", "q")], "t", "u", ["v"], "r_", forward, exact, within).count() == 0
    assert {x["r_v"] for x in asof_join(a, b.limit(0), [("k", "q")], "t", "u", ["v"], "r_").collect()} == {None}


def test_spans_of_all_lengths(spark):
    r = random.Random(3)

    def spans(n):
        out = []
        for i in range(n):
            start = r.randrange(-500, 500)
            length = r.choice((0, 0, 1, 3, 15, 16, 17, 200, 3000))
            out.append((r.choice(("hot", "hot", "a", None)), r.choice((None, start, start, start, start)), start + r.choice((length, length, length, -1)), i))
        return out + out[:2]

    left, right = spans(120), spans(110)
    a, b = spark.createDataFrame(left, "k string, s long, e long, i long"), spark.createDataFrame(right, "k string, s long, e long, i long")
    good = lambda x: x[0] is not None and x[1] is not None and x[1] <= x[2]
    wanted = [
        (x[3], y[3]) for x in left for y in right
        if good(x) and good(y) and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]
    ]
    columns = {"a": "l.i", "b": "r.i"}
    got = overlap_join(a, b, [("k", "k")], ("s", "e"), ("s", "e"), columns)
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    points = [(x[3], y[3]) for x in left for y in right if good(x) and y[0] == x[0] and y[1] is not None and x[1] <= y[1] <= x[2]]
    got = points_in_spans(a, b, [("k", "k")], ("s", "e"), "s", columns)
    assert sorted(map(tuple, got.collect())) == sorted(points)
    assert overlap_join(a.limit(0), b, [("k", "k")], ("s", "e"), ("s", "e")).count() == 0
    assert overlap_join(a, b.limit(0), [], ("s", "e"), ("s", "e")).count() == 0


@pytest.mark.parametrize("span", [0, 1, 9, 1000])
def test_sliding(spark, span):
    r = random.Random(span)
    rows = [(key(r), r.choice((None, *range(-40, 80))), r.choice((None, float(r.randrange(9)))), r.choice((None, "x", "y", "z"))) for _ in range(250)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "k string, t long, v double, x string").repartition(5)
    wanted = []
    for k, t in {(k, t) for k, t, _, _ in rows if t is not None}:
        mine = [x for x in rows if x[0] == k and x[1] is not None and t - span <= x[1] <= t]
        values = [x[2] for x in mine if x[2] is not None]
        wanted.append((k, t, len(mine), sum(values) if values else None, min(values, default=None), max(values, default=None), len({x[3] for x in mine} - {None})))
    for parts in (1, 17):
        got = sliding(df, ["k"], "t", "v", span, "x", partitions=parts)
        assert ORDERED(got.collect()) == ORDERED(wanted)
    assert sliding(df.limit(0), ["k"], "t", "v", span, "x").count() == 0
    assert sliding(df, ["k"], "t", "v", span).columns == ["k", "t", "n", "total", "least", "most"]


def test_sliding_over_timestamps(spark):
    start = datetime(2024, 1, 1)
    rows = [("k", start + timedelta(hours=6 * i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    got = {x["ts"]: (x["n"], x["total"]) for x in sliding(df, ["k"], "ts", "v", 24 * 3_600_000_000).collect()}
    assert got == {t: (min(i, 4) + 1, sum(range(max(0, i - 4), i + 1))) for i, (_, t, _) in enumerate(rows)}


def test_grouping_sets(spark):
    r = random.Random(9)
    rows = [(r.choice(("x", "y", None)), r.choice((1, 2)), r.choice(("p", "q", "r")), r.choice((None, r.randrange(100_000))), r.choice((None, "s", "t"))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, c string, v long, w string")
    measures = {"n": ("count", "*"), "held": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}

    def brute(sets):
        out = []
        for s in sets:
            groups = defaultdict(list)
            for x in rows:
                groups[tuple(x["abc".index(d)] if d in s else None for d in "abc")].append(x)
            code = sum(4 >> i for i, d in enumerate("abc") if d not in s)
            for g, xs in groups.items():
                vs = [x[3] for x in xs if x[3] is not None]
                out.append((*g, code, len(xs), len(vs), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None), len(set(vs)), len({x[4] for x in xs} - {None})))
        return ORDERED(out)

    for sets in (cube_sets("abc"), rollup_sets("abc"), [("a", "c"), ("b",), ("c", "a")]):
        got = grouping_sets(df, sets, measures, {"dv": "v", "dw": "w"})
        wanted = brute([tuple(s) for s in {frozenset(s) for s in sets}])
        rows_got = ORDERED(got.collect())
        if sets[0] == ("a", "c"):
            assert got.columns[:3] == ["a", "b", "c"]
        assert rows_got == wanted
    empty = grouping_sets(df.limit(0), cube_sets("ab"), measures, {"dv": "v"}).collect()
    assert [tuple(x) for x in empty] == [(None, None, 3, 0, 0, None, None, None, 0)]
