"""Samples against a sort, sketches against exact values."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from facetframe.operators.samples import priority, stratified
from facetframe.operators.sketches import daily_sketches, estimates, merged


def rows(n=3000):
    r = random.Random(4)
    out = [(i, r.choice(("hot", "hot", "hot", "a", None)), r.choice((None, 0.0, -1.0, 1.0, 5.0, 100.0, float("nan")))) for i in range(n)]
    return out + out[:5] + [(None, "a", 1.0), (9999, "few", 2.0)]


@pytest.mark.parametrize("size", [1, 3, 100, 10_000])
@pytest.mark.parametrize("weight", [None, "w"])
def test_stratified_takes_the_least_priorities(spark, size, weight):
    df = spark.createDataFrame(rows(), "k long, s string, w double")
    own = priority(F.col("k"), "x", None if weight is None else F.when(~F.isnan("w"), F.col("w")))
    ranked = {}
    for x in df.select("k", "s", "w", own.alias("p")).distinct().collect():
        if x["p"] is not None:
            ranked.setdefault(x["s"], set()).add(x["p"])
    limit = {s: sorted(ps)[:size][-1] for s, ps in ranked.items()}
    wanted = sorted(((x["k"], x["s"], str(x["w"])) for x in df.select("*", own.alias("p")).collect() if x["p"] is not None and x["p"] <= limit[x["s"]]), key=str)
    for parts in (1, 7):
        got = stratified(df.repartition(parts), ["s"], "k", size, weight, "x")
        assert got.columns == df.columns
        assert sorted(((x["k"], x["s"], str(x["w"])) for x in got.collect()), key=str) == wanted
    keys = {(x[0], x[1]) for x in wanted}
    assert sum(s == "hot" for _, s in keys) == min(size, len(ranked["hot"]))


def test_whole_table_empty_table_and_weights(spark):
    df = spark.createDataFrame(rows(), "k long, s string, w double")
    assert stratified(df.where("k >= 100"), [], "k", 50).select("k").distinct().count() == 50
    assert stratified(df, ["s"], "k", 0).count() == 0
    assert stratified(df.limit(0), ["s"], "k", 5).count() == 0
    # A key of weight 100 is drawn about 20 times as often as one of weight 5 while samples are small.
    heavy = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 100.0).otherwise(5.0).alias("w"))
    drawn = [x["w"] for x in stratified(heavy, [], "k", 200, "w", "seed").collect()]
    share = drawn.count(100.0) / len(drawn)
    assert len(drawn) == 200 and abs(share - 100 / 105) < 4 * math.sqrt(share * (1 - share) / 200) + 0.02


def test_sketches_merge_over_days(spark):
    r = random.Random(6)
    start = datetime(2024, 1, 1)
    data = [("hot" if i % 3 else None, start + timedelta(minutes=r.randrange(10 * 1440)), r.random(), r.randrange(900), f"l{min(r.randrange(30), r.randrange(30))}") for i in range(20_000)]
    data += [("hot", None, 1.0, 1, "x"), ("gaps", start, None, None, None)]
    df = spark.createDataFrame(data, "k string, ts timestamp, v double, item long, label string")
    daily = daily_sketches(df, ["k"], "ts", "v", "item", "label")
    assert daily.count() == 21
    for first, last in ((1, 10), (3, 5)):
        some = daily.where(F.dayofmonth("day").between(first, last))
        for x in estimates(merged(some, ["k"]), [0.1, 0.5, 0.99], 3).collect():
            mine = [d for d in data if d[0] == x["k"] and d[1] is not None and first <= d[1].day <= last]
            assert x["n"] == len(mine)
            if x["k"] == "gaps":
                assert x["quantiles"] is None and x["distinct"] == 0 and x["frequent"] == []
                continue
            values = sorted(d[2] for d in mine)
            for p, q in zip((0.1, 0.5, 0.99), x["quantiles"]):
                assert abs(sum(v <= q for v in values) / len(values) - p) < 0.03
            users = len({d[3] for d in mine})
            assert abs(x["distinct"] - users) <= 0.06 * users
            labels = [d[4] for d in mine]
            counts = sorted((labels.count(v) for v in set(labels)), reverse=True)
            assert [f["n"] for f in x["frequent"]] == counts[:3]
    assert estimates(merged(daily.limit(0), ["k"]), [0.5], 1).count() == 0
