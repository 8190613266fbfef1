"""Packing, sharding, quality rules, language and toxicity on small cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from facetframe.llm import base, fertility, language, packing, queries, sharding, toxicity
from facetframe.llm.tokens import ByteEncoder, vocabulary_path

FOLDER = "/root/testdata/sf0.001"
ODD = ["", " ", "a  b", " lead", "tail ", "<|endoftext|> x", "a\n b", "tab\there", "nb sp “q” — é", "it's  they'll", "x" * 3000, "日本 語 text", "\x1c a"]


def reference_ids(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    return [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_the_tokenizer(spark):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    ids, sizes = ByteEncoder("byte_bpe_50k").encode([t.encode() for t in texts])
    ends = np.cumsum(sizes)
    for t, wanted, n, e in zip(texts, reference_ids(texts), sizes, ends):
        assert ids[e - n : e].tolist() == wanted, t[:40]


def test_encoder_loads_the_tokenizer_for_special_tokens_alone():
    encoder = ByteEncoder("byte_bpe_50k")
    plain, special = ["some  words", "more"], ["<|endoftext|> x", "some words"]
    assert encoder.encode([t.encode() for t in plain])[0].tolist() == sum(reference_ids(plain), [])
    assert encoder.model is None
    assert encoder.encode([t.encode() for t in special])[0].tolist() == sum(reference_ids(special), [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=14))
def test_best_fit_and_its_bound(lengths):
    array = np.array(lengths, dtype=np.int64)
    bins = packing.best_fit(array, 24)
    assert all(v <= 24 for v in Counter({b: int(array[bins == b].sum()) for b in set(bins.tolist())}).values())
    used = len(set(bins.tolist()))
    bound = packing.lower_bound(array, 24)
    assert bound <= least_bins(sorted(lengths, reverse=True), 24) <= used


def least_bins(lengths, room):
    """Exact, by trying every placement."""
    best = [len(lengths)]

    def go(i, left):
        if len(left) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(left)
            return
        for k in sorted({(x, j) for j, x in enumerate(left)}):
            if k[0] >= lengths[i] and (k[1] == 0 or left[k[1]] not in left[: k[1]]):
                go(i + 1, [*left[: k[1]], left[k[1]] - lengths[i], *left[k[1] + 1 :]])
        go(i + 1, [*left, room - lengths[i]])

    go(0, [])
    return best[0] if lengths else 0


def test_packing(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "null id"), (51, "word " * 5000), (51, "word " * 5000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.packed(packing.pieces(df, capacity=64), capacity=64, part_pieces=20).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    ids = dict(zip([i for i, _ in texts], reference_ids([t or "" for _, t in texts])))
    for doc, rows in by_doc.items():
        whole = [*ids[doc], 2]
        copies = 2 if doc == 51 else 1
        first = len(whole) % 64 or 64
        wanted = [(0, 0, first)] + [(k + 1, first + 64 * k, 64) for k in range((len(whole) - first) // 64)]
        assert sorted((r["piece"], r["start"], r["length"]) for r in rows) == sorted(wanted * copies)
        for r in rows:
            part = np.array(whole[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, None)], "doc_id long, text string")
    got = packing.sequences(df, capacity=16).collect()
    parts = [[*ids, 2] for ids in reference_ids(["one two three", "four", ""])]
    assert sum(len(r["ids"]) for r in got) == sum(map(len, parts))
    assert Counter(i for r in got for i in r["ids"]) == Counter(i for p in parts for i in p)


def ring_by_rows(counts, shards, bounds, nodes):
    """One row after the other: the first shard clockwise with room."""
    points = sharding.ring(shards, nodes)
    taken, out = [0] * shards, defaultdict(list)
    for cell in sorted(counts):
        start = next((i for i, p in enumerate(points) if p[0] >= cell), 0)
        for _ in range(counts[cell]):
            step = next(s for s in range(len(points)) if taken[points[(start + s) % len(points)][1]] < bounds[points[(start + s) % len(points)][1]])
            shard = points[(start + step) % len(points)][1]
            out[cell].append((shard, taken[shard]))
            taken[shard] += 1
    return out


def test_ring_places_like_one_row_after_the_other():
    r = random.Random(2)
    counts = {r.randrange(1 << 16): r.randrange(1, 30) for _ in range(40)}
    n = sum(counts.values())
    bounds = [n // 7 + (s < n % 7) for s in range(7)]
    wanted = ring_by_rows(counts, 7, bounds, 5)
    got = sharding.place(counts, 7, bounds, 5)
    for cell, flows in got.items():
        flat = [(s, slot + k) for s, low, high, slot in flows for k in range(high - low)]
        assert flat == wanted[cell]
    with pytest.raises(ValueError):
        sharding.place({1: 5}, 2, [2, 2])


@pytest.mark.parametrize("repeated", [0, 9000])
def test_sharding(spark, repeated):
    rows = [(i, i % 5) for i in range(3000)] + [(None, 1)] * 3 + [(7, 7)] * repeated
    df = spark.createDataFrame(rows, "doc_id long, v int").withColumn("slot", F.lit("clash")).repartition(6)
    got = sharding.sharded(df, ["doc_id"], 24, carry=["doc_id", "v"]).collect()
    assert Counter((r["doc_id"], r["v"]) for r in got) == Counter(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.sharded(df.limit(0), ["doc_id"], 24).count() == 0
    if not repeated:
        more = {r["doc_id"]: r["shard"] for r in sharding.sharded(df, ["doc_id"], 25).collect()}
        moved = sum(more[r["doc_id"]] != r["shard"] for r in got)
        assert moved < 0.35 * len(got)


def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_fertility(spark):
    import sentencepiece

    r = random.Random(4)
    plain = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(60, 90))) for _ in range(150)]
    texts = [*plain, None, "", "a b c a b c\na b c\n\n a b c\na b c", "# * $ | <é> 日本", " ".join("ሴስ" + chr(0x1236 + i) for i in range(80))]
    texts.append(" ".join(f"w{i % 40}" for i in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: r for r in fertility.judged(df).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    for i, text in enumerate(texts):
        g, wanted = got[i], brute_rules(text)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == wanted
        assert g["base_failed"] == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])
        if i < 160:
            ids = [t for w in (text or "").split() for t in model.encode(w)]
            assert g["n_tokens"] == len(ids)
            assert abs(g["byte_share"] - (sum(map(model.is_byte, ids)) / len(ids) if ids else 0)) < 1e-12
    assert all(got[i]["kept"] for i in range(150))
    assert not got[150]["kept"] and not got[151]["kept"] and not got[len(texts) - 1]["kept"]
    assert fertility.judged(df.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    got = queries.op3(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in got.collect() if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)
    learn = spark.createDataFrame([("the cat", "en"), ("le chat", "fr"), (None, "en"), ("1 2", "fr"), ("x", None)], "text string, lang string")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ..."), (4, "the cat sat"), (4, "the cat sat")], "doc_id long, text string")
    named = [(r["doc_id"], r["lang_pred"]) for r in language.predicted(odd, learn, ["doc_id"]).collect()]
    assert sorted(named) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    nothing = language.predicted(odd, learn.limit(0), ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert language.predicted(odd.limit(0), learn, ["doc_id"]).count() == 0


def test_network_gradient():
    batch = toxicity.Batch([b"one two three", b"four five six seven one"])
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        x = net.forward(net.inputs(batch).astype(np.float64), batch.windows)
        return float((weight * (np.log1p(np.exp(x)) - target * x)).sum() / weight.sum())

    g = net.gradients(batch, batch.windows, target, weight)
    for name, at in (("out", (3,)), ("attend", (2, 1)), ("h_f", (1, 5)), ("h_b", (2, 40)), ("x_f", (20, 9)), ("bias_b", (3,)), ("words", (int(batch.word_rows[0]), 2))):
        base = net.p[name][at]
        net.p[name][at] = base + 1e-3
        up = loss()
        net.p[name][at] = base - 1e-3
        down = loss()
        net.p[name][at] = base
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), name


def test_toxicity(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(240):
        words = [word() for _ in range(r.choice((20, 60, 150)))]
        if i % 3 == 0:
            for _ in range(max(1, len(words) // 20)):
                words[r.randrange(len(words))] = r.choice(("zzbad", "zzworse", "zzugly"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    df = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "abcd")], "doc_id long, text string").withColumn("score", F.lit(1))
    table = spark.createDataFrame([*labels[:160], (None, 1), (1, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(df, table)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 243
    right = sum((got[i] >= 0.5) == bool(y) for i, y in labels[160:])
    assert right >= 72
    clean = toxicity.clean(df, model)
    assert clean.columns == df.columns and clean.count() == sum(s < 0.5 for s in got.values())
    assert toxicity.scored(df.limit(0), model, ["doc_id"]).count() == 0
    constant = toxicity.fitted(df, table.limit(0))
    assert {r["score"] for r in toxicity.scored(df, constant, ["doc_id"]).collect()} == {0.0}


class FewTexts:
    """In place of a model: texts are toxic if too many are handed over at once, or if they say so."""

    def texts(self, texts):
        return np.array([1.0 if len(texts) > 2000 or b"bad" in t else 0.0 for t in texts])


def test_clean_hands_python_small_batches_of_texts(spark, monkeypatch):
    text = F.when(F.col("id") == 9, "bad").when(F.col("id") % 7 > 0, F.concat(F.lit("good "), F.col("id") % 4000))
    df = spark.range(5000, numPartitions=1).select(text.alias("text"), (F.col("id") % 4000).alias("A.b"), F.lit(None).alias("nothing"))
    written = []

    def spied(rows, label):
        written.append(rows._jdf.queryExecution().executedPlan().toString())
        return base.kept(rows, label)

    monkeypatch.setattr(toxicity, "kept", spied, raising=False)
    clean = toxicity.clean(df, FewTexts())
    assert clean.dtypes == df.dtypes
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in df.collect() if r["text"] != "bad")
    assert [(p.count("ArrowEvalPython"), "MapInArrow" in p) for p in written] == [(1, False)]
    assert "Python" not in clean._jdf.queryExecution().executedPlan().toString()


def test_windows_overlap_and_cover():
    for n in (0, 1, 48, 49, 84, 85, 500):
        starts = toxicity.window_starts(n)
        covered = {k for s in starts for k in range(s, s + toxicity.WINDOW)}
        assert set(range(n)) <= covered
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.withColumn("n_hit", F.lit(1)).unionByName(docs.limit(3).withColumn("n_hit", F.lit(1)))
    odd = [(None, None, None, None, None, None), (9999, "", None, None, 0, 2)]
    extra = extra.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, n_hit int"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, extra, FOLDER)
        assert kept.columns == extra.columns and kept.dtypes == extra.dtypes, name
        assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 9999").count() == 1
        extra = kept.checkpoint()
    ids = [r["doc_id"] for r in extra.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    last = corpus_pipeline.STAGES[-1][1](spark, extra, FOLDER)
    assert {r["doc_id"] for r in last.collect()} == set(ids)
