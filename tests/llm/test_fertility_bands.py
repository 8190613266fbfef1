"""Texts of few distinct words are rejected, and those of the usual entropy kept."""

import math
import random

import pytest

from facetframe.llm import fertility


def test_low_entropy_is_rejected(spark):
    r = random.Random(8)
    words = [a + b for a in ("stone", "river", "cloud", "green", "light", "north", "water", "house", "paper") for b in ("", "s", "ly", "er", "ing")]

    def text(some):
        return " ".join(r.choice(some) for _ in range(90))

    rows = [(i, text(words)) for i in range(300)] + [(1000 + i, text(words[:17])) for i in range(6)]
    got = {x["doc_id"]: x for x in fertility.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(x["base_failed"] for x in got.values())
    assert not any(got[1000 + i]["kept"] for i in range(6)), [(got[1000 + i]["token_entropy"], got[i]["token_entropy"]) for i in range(6)]
    assert sum(got[i]["kept"] for i in range(300)) >= 295


def brute_bands(rows):
    """Quartiles by sorting, then the same blend of group and script."""

    def quartiles(held, c):
        values = sorted(math.floor(r[c] * 1000) / 1000 for r in held)
        q1, q2, q3 = (values[math.ceil(len(values) * k / 4) - 1] for k in (1, 2, 3))
        return q2, max((q3 - q1) / 1.349, fertility.LEAST_SPREAD[c]), len(values)

    out = {}
    for script, size in {(r["script"], r["length_class"]) for r in rows}:
        for c, k in fertility.BAND.items():
            whole, wide, n = quartiles([r for r in rows if r["script"] == script], c)
            median, spread, m = quartiles([r for r in rows if (r["script"], r["length_class"]) == (script, size)], c)
            own, wide = m / (m + 20), wide * (1 + 20 / n)
            middle = own * median + (1 - own) * whole
            around = own * spread + (1 - own) * (wide + abs(median - whole))
            out[script, size, c] = (middle - k * around, middle + k * around)
    return out


def test_bands_against_sorting(spark):
    r = random.Random(8)
    rows = [
        {"script": r.choice(("latin", "latin", "greek", "han")), "length_class": r.choice((5, 6, 6, 6, 9)), "chars_per_token": r.gauss(4, 1),
         "byte_share": r.choice((0.0, r.random())), "token_entropy": round(r.gauss(7, 2), 1)}
        for _ in range(400)
    ]
    rows.append({"script": "kana", "length_class": 3, "chars_per_token": 1.0, "byte_share": 0.0, "token_entropy": 2.0})
    schema = "script string, length_class int, chars_per_token double, byte_share double, token_entropy double"
    table = spark.createDataFrame([tuple(x.values()) for x in rows], schema)
    wanted = brute_bands(rows)
    for parts in (1, 7):
        got = fertility.bands(table.repartition(parts)).collect()
        assert len(got) == len({k[:2] for k in wanted})
        for x in got:
            for c in fertility.BAND:
                assert (x[f"low_{c}"], x[f"high_{c}"]) == pytest.approx(wanted[x["script"], x["length_class"], c], abs=1e-9)
    assert fertility.bands(table.limit(0)).count() == 0
