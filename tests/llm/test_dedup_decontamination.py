"""Similarity join and multi-pattern search against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from facetframe.llm import decontaminate, near_dup
from facetframe.llm.base import kept
from facetframe.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_groups(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    rows = []
    for base in range(6):
        text = [word() for _ in range(r.choice((8, 40, 90)))]
        for _ in range(r.choice((2, 12, 45))):
            new = list(text)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                new[r.randrange(len(new))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(new)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "One TWO"), (2005, "one two three four five")]
    rows += [(None, rows[0][1]), (None, "null only text of seven words here"), (None, "null only text of seven words here"), (2006, "é É")]
    rows += [rows[1], (3000, " ".join(word() for _ in range(30_000)))]
    return rows


def test_near_duplicates(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).repartition(5)
    got = [tuple(r) for r in near_dup.near_duplicates(df).collect()]
    wanted = [(i, n, c, i == c) for i, n, c in brute_groups(rows)]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    stay = near_dup.survivors(df).collect()
    assert near_dup.survivors(df).columns == df.columns
    groups = {(c, n > 0) if n else ("empty", i) for i, n, c in brute_groups(rows)}
    assert len(stay) == len(groups)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    r = random.Random(3)
    text = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        new = list(text)
        for _ in range(r.randrange(3)):
            new[r.randrange(80)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(new)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()}
    assert got == {(i, c) for i, _, c in brute_groups(rows)}


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (100, 300), (7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {tuple(r) for r in components(df, "a", "b").collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in (100, 200, 300)}


def brute_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = cut(text), set(), set()
    for item, body in items:
        words = cut(body)
        n = min(10, len(words))
        windows = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words and item is not None else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    names = sorted(found)
    return len(w), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [16_000_000, 400])
def test_benchmark_hits(spark, block_bytes):
    r = random.Random(1)
    word = lambda: r.choice(("the", "a", "of", "é1", "x9")) if r.random() < 0.6 else f"w{r.randrange(30)}"
    items = [(i, " ".join(word() for _ in range(r.choice((1, 2, 5, 9, 10, 11, 30))))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "...,"), (None, "null id words"), (93, items[3][1]), (93, items[4][1])]
    docs = [(i, " ".join(word() for _ in range(r.choice((3, 40, 300))))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "Before: " + items[6][1].upper().replace(" ", " -- ") + "\nafter"), (None, items[6][1]), docs[0]]
    docs += [(103, " ".join(word() for _ in range(20_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_hits(df, table, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "doc_n_hit", "n_words", "n_hit", "hit_spans", "items", "items_sha256"]
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["items_sha256"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(i, *brute_hits(t, items)) for i, t in docs], key=str)
    clean = decontaminate.clean(df, table, block_bytes=block_bytes)
    assert clean.columns == df.columns
    assert clean.count() == sum(brute_hits(t, items)[1] == 0 for _, t in docs)
    assert decontaminate.benchmark_hits(df.limit(0), table).count() == 0
    assert {r["n_hit"] for r in decontaminate.benchmark_hits(df, table.limit(0)).collect()} == {0}


def test_clean_hands_python_small_batches_of_texts(spark, monkeypatch):
    """One Python worker a task, given the texts alone and at most 2,000 at once."""
    items = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five six")], "item_id long, text string")
    docs = [(i, "x" * 50 + (" ONE, two-three" if i % 3 == 0 else " five  six" if i % 3 == 1 else " six five"), None) for i in range(30)]
    docs += [(None, None, None), (40, "", None), (41, "a four b", None), docs[2]]
    df = spark.createDataFrame(docs, "`a.b` long, text string, `A` string").withColumn("nothing", F.lit(None))
    written = []

    def spied(rows, label):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        written.append((label, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), plan))
        return kept(rows, label)

    monkeypatch.setattr(decontaminate, "kept", spied)
    clean = decontaminate.clean(df, items, block_bytes=1)
    assert clean.dtypes == df.dtypes
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in df.collect() if brute_hits(r["text"], items.collect())[1] == 0)
    (rows, plan), *more = [(n, p) for label, n, p in written if label == "decontaminated"]
    assert not more and rows <= 2000
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert "Python" not in clean._jdf.queryExecution().executedPlan().toString()
