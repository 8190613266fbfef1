"""Line dedup against a plain recount, over few and many partitions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from facetframe.llm import line_dedup
from facetframe.llm.queries import QUERIES

LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
NONE = -(1 << 63)


def brute(docs, points=20, least=3):
    key = lambda line: line.strip(line_dedup.STRIPPED).translate(LOWER)
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= points:
                holders.setdefault(key(line), set()).add(NONE if doc is None else doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        own = NONE if doc is None else doc
        left = [x for x in lines if len(key(x)) < points or len(holders[key(x)]) < least or max(holders[key(x)]) == own]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def corpus():
    r = random.Random(8)
    shared = [f"shared line number {i:02d} of the corpus" for i in range(12)]
    hot = "A LINE that a third of all documents hold"
    docs = []
    for i in range(120):
        lines = []
        for _ in range(r.randrange(1, 9)):
            kind = r.random()
            lines.append(
                r.choice(shared) if kind < 0.3 else f"\t {r.choice(shared).upper()} \r" if kind < 0.4
                else "short" if kind < 0.5 else "" if kind < 0.55 else f"own line {i} {r.random()} of this document" if kind < 0.9 else "é" * 20
            )
        if i % 3 == 0:
            lines += [hot] * r.randrange(1, 4)
        docs.append((i * 37 % 1000, "\n".join(lines)))
    docs += [(2000, None), (2001, ""), (2002, "\n"), (2003, "\n".join([hot, "x", hot])), (None, hot + "\n" + shared[0]), (None, None)]
    docs += [docs[0], docs[0], docs[3], (docs[4][0], docs[5][1])]
    docs += [(3000, "\n".join([hot, *(f"line {i} of a very long text of many lines" for i in range(20_000)), shared[1]]))]
    return docs


@pytest.mark.parametrize("partitions", [1, 40])
def test_against_recount(spark, tmp_path, partitions):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, keep int, row string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        wanted = brute(docs)
        df.write.parquet(f"{tmp_path}/documents.parquet")
        got = [tuple(r) for r in QUERIES["op12_line_dedup"](spark, str(tmp_path)).collect()]
        hashed = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in wanted]
        assert sorted(got, key=str) == sorted(hashed, key=str)
        left = line_dedup.deduplicated(df)
        assert left.columns == df.columns
        texts = [(d, None if t is None else k) for (d, t), (_, _, _, k) in zip(docs, wanted)]
        assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(texts, key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table_and_bitmap(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.keep_bitmaps(df).count() == 0
    packed = line_dedup._packed(11, np.array([0, 9]))
    assert zlib.decompress(packed) == bytes([0b01111111, 0b10100000])
    assert line_dedup.kept_lines(11, packed).tolist() == [False, *[True] * 8, False, True]


@pytest.mark.parametrize("least", [2, 3, 5])
def test_stream_over_batches_of_any_size(least):
    """Cut anywhere, a sorted stream gives what whole groups give, with edges settled from the summaries."""
    r = random.Random(least)
    rows = []
    for h in range(30):
        for doc in sorted(r.sample(range(50), r.choice((1, 2, 3, 9))), reverse=True):
            rows += [(h // 3, h % 3, doc, 0, line, 9) for line in range(r.choice((1, 1, 4)))]
    rows = np.array(rows)
    groups = {}
    for row in rows.tolist():
        groups.setdefault((row[0], row[1]), set()).add(row[2])
    wanted = {tuple(x) for x in rows.tolist() if len(groups[x[0], x[1]]) >= least and x[2] != max(groups[x[0], x[1]])}
    for _ in range(40):
        cuts = sorted(r.sample(range(1, len(rows)), r.choice((0, 1, 4, 20))))
        marks = []
        for part in np.split(rows, cuts):
            stream = line_dedup._Stream(least)
            inner = sorted(r.sample(range(1, len(part)), min(len(part) - 1, r.choice((0, 1, 5)))))
            for batch in np.split(part, inner):
                marks += stream.feed(batch)
            marks += stream.end()
        dropped = {tuple(x) for kind, found in marks if kind == line_dedup.DROPPED for x in found.tolist()}
        edges = {}
        for kind, found in marks:
            if kind == line_dedup.EDGE:
                for x in found.tolist():
                    edges.setdefault((x[0], x[1]), set()).add(x[2])
        for kind, found in marks:
            if kind == line_dedup.OPEN:
                for x in found.tolist():
                    docs = edges[x[0], x[1]]
                    if len(docs) >= least and x[2] != max(docs):
                        dropped.add(tuple(x))
        assert dropped == wanted
