"""The routes meant for large data, against brute force on small data."""

import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from facetframe.operators import cleaning, profile
from facetframe.operators.normality import normal_quantile, normal_upper_tail, normality
from facetframe.operators.ordering import numbered, running_total
from facetframe.operators.quantiles import exact_quantiles
from facetframe.operators.stats import correlations
from facetframe.sources import store
from facetframe.streaming.events import sessions
from facetframe.streaming.throttle import _ChunkMap, throttle


def chain(times, gap):
    last, kept = None, []
    for t in sorted(times):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60, unique=True), st.integers(1, 60), st.integers(0, 3))
def test_chunk_maps_compose_to_the_chain(times, gap, factor):
    size = gap * (factor + 1)
    kept, allowed = [], None
    for number in sorted({t // size for t in times}):
        chunk = sorted(t for t in times if t // size == number)
        held = _ChunkMap(number * size, gap)
        for t in chunk:
            held.add(t)
        exits = [e for s, e in held.rows() if allowed is None or s >= allowed]
        inner = allowed
        for t in chunk:
            if inner is None or t >= inner:
                kept.append(t)
                inner = t + gap
        if exits:
            assert exits[0] == inner
            allowed = exits[0]
        else:
            assert inner == allowed
    assert kept == chain(times, gap)


@pytest.mark.parametrize("chunk_ms", [None, 750, 1000, 5000])
def test_throttle(spark, chunk_ms):
    rng = random.Random(7)
    rows, number = [], 0
    for key, n, span in (("hot", 3000, 400_000), ("cold", 40, 90_000), ("once", 1, 10), (None, 50, 20_000)):
        for _ in range(n):
            rows.append((number, key, rng.randrange(span)))
            number += 1
    df = spark.createDataFrame(rows, "id long, page string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    kept = throttle(df, ["page"], "ts", "id", 750, chunk_ms).collect()
    for key in {r[1] for r in rows}:
        wanted = chain({r[2] for r in rows if r[1] == key}, 750)
        assert sorted(r["ms"] for r in kept if r["page"] == key) == wanted
    first = {}
    for i, key, ms in rows:
        first[key, ms] = min(i, first.get((key, ms), i))
    assert all(first[r["page"], r["ms"]] == r["id"] for r in kept)


def test_throttle_fixture(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 500, 800, 1200, 1600)], "u long, ms long").withColumn(
        "ts", F.timestamp_millis("ms")
    )
    assert sorted(r["ms"] for r in throttle(df, ["u"], "ts", "ms", 750).collect()) == [0, 800, 1600]


def test_throttle_null_tie_breaks(spark):
    df = spark.createDataFrame(
        [(1, 0, None), (1, 0, None), (1, 500, None), (1, 900, None), (None, 0, 5), (None, 0, None)],
        "u long, ms long, id long",
    ).withColumn("ts", F.timestamp_millis("ms"))
    kept = [(r["u"], r["ms"], r["id"]) for r in throttle(df, ["u"], "ts", "id", 750).collect()]
    assert sorted(kept, key=str) == sorted([(1, 0, None), (1, 900, None), (None, 0, 5)], key=str)


def test_sessions(spark):
    rng = random.Random(3)
    rows = [(u, rng.randrange(0, 20 * 86_400)) for u in (1, 1, 1, 2) for _ in range(150)]
    df = spark.createDataFrame(rows, "u long, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = sorted(
        (r["u"], r["events"], r["duration"]) for r in sessions(df, "u", "ts", 7200).collect()
    )
    wanted = []
    for u in (1, 2):
        times = sorted(s for k, s in rows if k == u)
        run = [times[0]]
        for t in times[1:] + [None]:
            if t is not None and t - run[-1] <= 7200:
                run.append(t)
            else:
                wanted.append((u, len(run), max(1, run[-1] - run[0])))
                run = [t]
    assert found == sorted(wanted)


QUANTILE_CASES = {
    "ties": [5.0] * 3000 + [7.0] * 2999 + list(range(50)),
    "spread": [float(np.float64(x)) for x in np.random.default_rng(1).lognormal(0, 8, 5000)],
    "whole": [float(i) for i in range(4001)],
    "wide": [-1e308, 1e308, 0.0, 1.0, 2.0] * 400,
    "single": [3.5],
}


@pytest.mark.parametrize("name", QUANTILE_CASES)
@pytest.mark.parametrize("accuracy", [20, 1000])
def test_exact_quantiles(spark, name, accuracy):
    values = QUANTILE_CASES[name]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    row = exact_quantiles(df, ["v"], probabilities, bracket_values=10, accuracy=accuracy).first()
    ordered = sorted(float(v) for v in values)
    for p, got in zip(probabilities, row["v"]):
        place = p * (len(ordered) - 1)
        low, high = ordered[int(np.floor(place))], ordered[int(np.ceil(place))]
        assert got == pytest.approx(low + (high - low) * (place - np.floor(place)), rel=1e-12, abs=1e-300)


def test_exact_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, None), (3.0, None)], "v double, e double")
    row = exact_quantiles(df, ["v", "e"], [0.5]).first()
    assert row["v"] == [2.0] and row["e"] is None
    assert exact_quantiles(df.limit(0), ["v"], [0.5]).first()["v"] is None


def test_exact_quantiles_with_infinities(spark):
    values = [float("-inf")] * 3 + [float(i) for i in range(40)] + [float("inf")] * 2
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probabilities = [k / 44 for k in (0, 2, 3, 20, 42, 43, 44)]
    assert exact_quantiles(df, ["v"], probabilities, bracket_values=4, accuracy=20).first()["v"] == [
        values[k] for k in (0, 2, 3, 20, 42, 43, 44)
    ]


def test_order_without_one_task(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), i, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, id int, v double").repartition(5)
    ordered = sorted(rows)
    got = {r["id"]: r["row_no"] for r in numbered(df, ["k", "id"], partitions=7).collect()}
    assert got == {r[1]: n + 1 for n, r in enumerate(ordered)}
    totals = {r["id"]: r["cumulative"] for r in running_total(df, "v", ["k", "id"], partitions=7).collect()}
    run = 0.0
    for _, i, v in ordered:
        run += v
        assert totals[i] == pytest.approx(run)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_samples_of_long_texts(spark, k):
    rng = random.Random(11)
    starts = ["", "a" * 64, "a" * 63 + "b", "é" * 70, "b"]
    values = [s + t for s in starts for t in ("", "x", "y" * 80, "z")]
    rows = [(i, rng.choice(values + [None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v string").repartition(3)
    seen = [v for v in dict.fromkeys(v for _, v in rows) if v is not None]
    got = cleaning.sample_values(df, ["v"], k, order_by="id").first()["samples"]
    assert got == seen[:k]
    smallest = sorted(set(seen), key=lambda v: v.encode("utf8"))[:k]
    assert cleaning.sample_values(df, ["v"], k).first()["samples"] == smallest


def test_latest_per_key(spark):
    rows = [(i % 5, i, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    assert sorted(r["at"] for r in store.latest_per_key(df, ["k"], ["at"]).collect()) == [195, 196, 197, 198, 199]


def test_normal_functions(spark):
    points = [(p,) for p in (0.0003, 0.01, 0.07, 0.2, 0.5, 0.8, 0.95, 0.9997)]
    rows = spark.createDataFrame(points, "p double").select("p", normal_quantile(F.col("p")).alias("q")).collect()
    normal = statistics.NormalDist()
    for r in rows:
        assert r["q"] == pytest.approx(normal.inv_cdf(r["p"]), abs=1e-12)
    tails = spark.createDataFrame([(z,) for z in (-3.0, -0.5, 0.0, 1.96, 4.0)], "z double")
    for r in tails.select("z", normal_upper_tail(F.col("z")).alias("t")).collect():
        assert r["t"] == pytest.approx(1 - normal.cdf(r["z"]), rel=1e-5)


# Published example (weights of eleven men) with its published result.
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def test_shapiro_published(spark):
    df = spark.createDataFrame([(float(v),) for v in WEIGHTS], "v double")
    row = normality(df, "v").first()
    assert row["test"] == "Shapiro-Wilk"
    assert row["statistic"] == pytest.approx(0.78881, abs=2e-5)
    assert row["p_value"] == pytest.approx(0.006704, abs=2e-6)
    moved = df.select((F.col("v") * 3 - 1000).alias("v"))
    assert normality(moved, "v").first()["statistic"] == pytest.approx(row["statistic"], abs=1e-6)


def test_k_squared_published(spark):
    # Kurtosis score of 0..19 is published as -1.70581; its skewness score is 0.
    from facetframe.operators.normality import _k_squared

    df = spark.range(20).agg(F.count("*").cast("double").alias("n"), F.skewness("id").alias("g1"), F.kurtosis("id").alias("g2"))
    got = df.select(_k_squared(F.col("n"), F.col("g1"), F.col("g2")).alias("k")).first()["k"]
    assert got == pytest.approx(1.7058104152122062**2, rel=1e-9)
    uniform = spark.range(6000).select(F.rand(1).alias("v"))
    row = normality(uniform, "v").first()
    assert row["test"] == "D'Agostino-Pearson" and not row["is_normal"]


def test_small_groups_are_left_out(spark):
    df = spark.createDataFrame([(0, float(i)) for i in range(7)] + [(1, float(i)) for i in range(8)], "g int, v double")
    assert [r["g"] for r in normality(df, "v", ["g"]).collect()] == [1]


def test_correlations_scan_once(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.RandomState(3)
    data = pd.DataFrame({f"c{k}": rng.randn(500) * 10 ** (k % 4) + 1e5 * (k % 3) for k in range(120)})
    data = data.mask(rng.rand(*data.shape) < 0.1)
    data["same"], data["empty"], data["far"] = 0.1, np.nan, 1e12
    data.loc[0, "far"] = 1.0
    df = spark.createDataFrame(data).repartition(5)
    result = correlations(df, list(data.columns), digits=12)
    assert result._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = result.toPandas().pivot(index="a", columns="b", values="r").loc[data.columns, data.columns]
    want = data.corr().fillna(0.0)
    want.loc["same", :] = want.loc[:, "same"] = 0.0
    assert float((got - want).abs().to_numpy().max()) < 1e-8
    assert {r["r"] for r in correlations(df.limit(0), ["c0", "same"]).collect()} == {0.0}


def _jobs(spark, run) -> int:
    """Jobs that a call costs."""
    listener = spark.sparkContext.statusTracker()
    group = f"scans-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    jobs = listener.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(jobs)


def test_jobs_do_not_grow_with_columns(spark, tmp_path):
    """Types, profiles and quantiles of 200 columns take as many jobs as those of eight."""
    made = {}
    for width in (8, 200):
        texts = [F.concat(F.lit(f"t{i} "), (F.col("id") % (i + 2)).cast("string")).alias(f"t{i}") for i in range(width // 2)]
        numbers = [(F.col("id") * (i + 1) % 97).cast("double").alias(f"n{i}") for i in range(width // 2)]
        path = f"{tmp_path}/w{width}"
        spark.range(1500).select("id", *texts, *numbers).write.parquet(path)
        made[width] = spark.read.parquet(path)
    runs = {
        "types": lambda df: profile.detected_types(df, "id").collect(),
        "ratio": lambda df: profile.ratio_types(df).collect(),
        "describe": lambda df: profile.describe(df).collect(),
    }
    for name, run in runs.items():
        assert _jobs(spark, lambda: run(made[200])) <= _jobs(spark, lambda: run(made[8])) + 1, name


def test_first_cells_of_sparse_columns(spark):
    """Columns with their first cells far down are typed by those, whatever the order of the rows."""
    rows = [(i, "2024-01-02" if i >= 5000 else None, f"w{i}" if i % 40 == 0 else None, str(i), None) for i in range(6000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, late string, rare string, every string, none string").repartition(6)
    got = {r["column"]: r["detected_type"] for r in profile.detected_types(df, "k").collect()}
    assert got["k"] == got["every"] == "numeric" and got["late"] == "datetime" and got["none"] == "text"
    for rules in (profile.PROFILER, profile.REPORT):
        shares = {r["column"]: (r["date_share"], r["number_share"]) for r in profile._probes(df, ["late", "rare", "every", "none"], "k", rules).collect()}
        assert shares["late"][0] == 1.0 and shares["every"] == (0.0, 1.0) and "none" not in shares and shares["rare"][0] == 0.0


@pytest.mark.parametrize("accuracy", [30, 10_000])
def test_quantiles_of_many_columns_and_ranks(spark, accuracy):
    r = random.Random(accuracy)
    columns = {"a": [r.gauss(0, 1) for _ in range(3000)], "b": [float(r.randrange(4)) for _ in range(3000)], "c": [None] * 2990 + [1.0] * 10}
    columns["d"] = [r.choice((float("nan"), None, 1e300, -1e300, 0.5)) for _ in range(3000)]
    df = spark.createDataFrame(list(zip(*columns.values())), "a double, b double, c double, d double").repartition(5)
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.51, 0.75, 0.9, 1.0]
    row = exact_quantiles(df, list(columns), probabilities, bracket_values=50, accuracy=accuracy).first()
    for name, values in columns.items():
        clean = sorted(v for v in values if v is not None and v == v)
        for p, got in zip(probabilities, row[name]):
            place = p * (len(clean) - 1)
            low, high = clean[int(np.floor(place))], clean[int(np.ceil(place))]
            assert got == pytest.approx(low + (high - low) * (place - np.floor(place)), rel=1e-12)
