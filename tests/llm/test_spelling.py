"""Spelling variants against brute force over all pairs."""

import random

import numpy as np
import pytest
from facetframe.llm import spelling
from facetframe.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=2):
    near = {w: [v for v in counts if len(w) >= 4 and len(v) >= 4 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        if vs:
            top = min(vs, key=lambda v: (-counts[v], v))
            if counts[top] >= ratio * counts[w]:
                form[w] = top

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items())


def vocabulary(alphabet, seed, size=60):
    r = random.Random(seed)
    words = {}
    for _ in range(size):
        word = "".join(r.choice(alphabet) for _ in range(r.randrange(4, 14)))
        words[word] = r.randrange(1, 300)
        for _ in range(r.randrange(6)):
            at = r.randrange(len(word))
            word = r.choice((word[:at] + word[at + 1 :], word[:at] + r.choice(alphabet) + word[at:], word[:at] + r.choice(alphabet) + word[at + 1 :]))
            if len(word) >= 3:
                words[word] = r.choice((1, 2, 4, 8, 16, 40))
    return words


@pytest.mark.parametrize("alphabet,seed", [("ab", 1), ("abcdefgh", 2), ("aé日😀z", 3)])
def test_grouped_against_all_pairs(spark, alphabet, seed):
    words = vocabulary(alphabet, seed)
    words |= {"aaaaaaaa": 5, "aaaaaaa": 11, "aaaaaaaaa": 5, "b" * 3000: 2, "b" * 2999: 9, "abc": 7}
    rows = [(w, n, "clash") for w, n in words.items()] + [(None, 4, "clash")]
    # A word given twice is added up.
    first = next(iter(words))
    rows.append((first, 3, "clash"))
    words[first] += 3
    df = spark.createDataFrame(rows, "word string, n long, near string").repartition(3)
    got = [tuple(r) for r in spelling.grouped(df).collect()]
    assert sorted(got) == brute(words)


def test_empty_and_ratio(spark):
    df = spark.createDataFrame([], "word string, n long")
    assert spelling.grouped(df).count() == 0
    with pytest.raises(ValueError):
        spelling.grouped(df, ratio=1)


def test_pivots_are_the_cheapest_disjoint_pair():
    r = np.random.RandomState(4)
    for width in (4, 5, 9):
        frequency = r.randint(1, 9, (50, width))
        order = np.argsort(np.argsort(frequency, axis=1, kind="stable"), axis=1).astype(np.int64)
        prefix, last, chosen = spelling.pivots(order, frequency.astype(np.int64))
        for row in range(50):
            places = np.flatnonzero(prefix[row])
            assert set(places) == set(np.flatnonzero(order[row] < 3)) and last[row] == 2
            sums = {frequency[row, i] + frequency[row, j] for i in places for j in places if j - i >= 2}
            a, b = chosen[row]
            assert b - a >= 2 and prefix[row, a] and prefix[row, b] and frequency[row, a] + frequency[row, b] == min(sums)


def test_query_on_null_and_empty_texts(spark, tmp_path):
    docs = [(1, "Color colour COLOR colour"), (2, "colour color colour"), (3, None), (None, ""), (4, "colour ÀÉÎÕü ÀÉÎÕü àÉÎÕü ÀÉÎÕü")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["word"]: tuple(r) for r in QUERIES["op11_spelling_variants"](spark, str(tmp_path)).collect()}
    assert got["colour"] == ("colour", None, "colour", 5, 1, None)
    assert got["color"] == ("color", None, "color", 3, 1, None)
    assert got["ÀÉÎÕü"] == ("ÀÉÎÕü", None, "ÀÉÎÕü", 3, 1, None) or got["ÀÉÎÕü"][3] == 3
