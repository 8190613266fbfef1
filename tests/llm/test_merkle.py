"""The manifest against a tree built row by row."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from facetframe.llm import merkle
from facetframe.llm.queries import QUERIES

H = lambda text: hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(nodes):
    """(root, siblings of every leaf) of one tree."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, p in enumerate(at):
            run = p // 8 * 8
            paths[leaf].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 8])))
        nodes = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [p // 8 for p in at]
    return nodes[0], paths


def brute(rows):
    """rows (doc_id, lang, leaf) -> sorted (doc_id, leaf, subroot, root, path)."""
    groups = {}
    for doc, lang, leaf in rows:
        groups.setdefault(lang, []).append((doc, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = (leaves, *climb([x[1] for x in leaves]))
    root, upper = climb([trees[g][1] for g in order])
    out = []
    for g, above in zip(order, upper):
        leaves, subroot, paths = trees[g]
        out += [(doc, leaf, subroot, root, tuple(p + above)) for (doc, leaf), p in zip(leaves, paths)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [1, 2, 8, 64, 65, 513], [600, 4200], [1] * 70])
def test_proofs_against_brute_force(spark, sizes):
    rows = [(i, None if g == 0 else f"g{g}é" if g % 2 else f"G{g}", H(f"{g} {i}")) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").withColumn("digest", F.lit(1)).repartition(5)
    found = merkle.proofs(df, "lang", "doc_id", "leaf").withColumn("again", merkle.folded(F.col("digest"), F.col("path"))).collect()
    got = [(r["row"]["doc_id"], r["digest"], r["subroot"], r["root"], tuple(map(tuple, r["path"]))) for r in found]
    assert sorted(got, key=str) == brute(rows)
    assert all(r["again"] == r["root"] and r["row"]["digest"] == 1 for r in found)


def test_query_on_nulls_ties_and_long_texts(spark, tmp_path):
    r = random.Random(2)
    docs = [(i, r.choice(("Big Text", "small", "É", None, "", "LONG " * 50_000)), r.choice((None, "en", "de", "")), r.choice((None, "s")), r.choice((None, i))) for i in range(90)]
    docs += [docs[0], docs[0], (docs[1][0], "other", *docs[1][2:]), (None, "x", "en", None, 1), (None, "x", "en", None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("root", F.lit(0))
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    leaf = lambda d, text: H("".join(map(field, (d[0], d[3], d[2], d[4], text))))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = {}
    for d in docs:
        hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        tampered[leaf(d, d[1])] = leaf(d, d[1].translate(lower)) if hit and d[1] is not None else leaf(d, d[1])
    wanted = []
    for doc, own, subroot, root, path in brute([(d[0], d[2], leaf(d, d[1])) for d in docs]):
        node = tampered[own]
        for left, right in path:
            node = H(left + node + right)
        wanted.append((doc, own, subroot, root, H("".join(a + b for a, b in path)), node, node == root))
    got = [tuple(x) for x in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(not x[-1] for x in got) and any(x[-1] for x in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert merkle.proofs(df, "lang", "doc_id", "leaf").count() == 0
