"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is a hashed word vector beside the mean of its hashed character n-gram
vectors. A window of words runs through a gated recurrent layer in each direction;
attention pools the states, and a logistic unit scores the window. Windows overlap
and cover the whole text; a text's score comes from its highest window.

Training is numpy on the driver over a sample of labelled texts whose size is a
parameter. Labels are of whole texts: after the first passes only those windows of
toxic texts that the network itself finds toxic, and the highest of each text,
stay positive. Scoring is one pass over all texts with no shuffle: a slice's
distinct words are projected once, and all its windows step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetframe.llm.base import for_files, kept, small_batches
from facetframe.llm.words import LETTERED, Words, forget_powers, mixed, slices

WINDOW = 48
STRIDE = 36
#: Bounds of the labelled sample, in texts, and of the windows that one text gives to a pass.
SAMPLE_TOXIC = 800
SAMPLE_CLEAN = 1_200
TEXT_WINDOWS = 16
_WORD_ROWS, _GRAM_ROWS, _DIM, _HIDDEN = 1 << 13, 1 << 13, 16, 16
_PASSES, _BATCH, _RATE = 4, 96, 4e-3
#: Share of words left out of a training window, and every how manieth text sets the level instead of training.
_LEFT_OUT, _LEVEL_EVERY = 0.2, 5
#: A small sample is passed over more often, for about so many steps.
_LEAST_STEPS, _MOST_PASSES = 160, 16
_CHUNK = 1_024
#: Bytes of texts that are scored at once.
_SLICE = 1_000_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def scatter(rows: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of each index, as that many rows."""
    out = np.zeros((rows, values.shape[1]), dtype=np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        lead = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        out[index[lead]] = np.add.reduceat(values[order], lead, axis=0)
    return out


def gram_table(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram rows of the chosen words one after the other, number for each word).

    Grams are three and four bytes of the word between two marks.
    """
    start, size = words.starts[chosen], words.ends[chosen] - words.starts[chosen]
    data = words.data.astype(np.uint64)
    out_rows, out_owner = [], []
    for n in (3, 4):
        count = np.maximum(size + 2 - n + 1, 1)
        owner = np.repeat(np.arange(len(chosen)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        value = np.full(len(owner), n, dtype=np.uint64)
        for k in range(n):
            place = at + k - 1
            inside = (place >= 0) & (place < size[owner])
            byte = data[np.minimum(start[owner] + np.maximum(place, 0), len(data) - 1)]
            value = value * np.uint64(257) + np.where(inside, byte, np.uint64(1))
        out_rows.append((mixed(value) % np.uint64(_GRAM_ROWS)).astype(np.int64))
        out_owner.append(owner)
    rows, owner = np.concatenate(out_rows), np.concatenate(out_owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(chosen))


def window_starts(count: int) -> list[int]:
    """First words of the overlapping windows that cover so many words."""
    if count <= WINDOW:
        return [0]
    starts = list(range(0, count - WINDOW, STRIDE))
    return starts + [count - WINDOW]


class Batch:
    """Windows of texts as rows of distinct words; row 0 is the empty place."""

    def __init__(self, texts: list[bytes], most: int | None = None):
        words = Words(texts, LETTERED)
        _, where, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.word_rows = (words.hashes[where] % np.uint64(_WORD_ROWS)).astype(np.int64)
        self.gram_rows, self.gram_count = gram_table(words, where)
        owner, start = [], []
        for t, n in enumerate(words.count.tolist()):
            own = window_starts(n)
            if most and len(own) > most:
                own = [own[i * len(own) // most] for i in range(most)]
            owner += [t] * len(own)
            start += own
        self.owner = np.array(owner, dtype=np.int64)
        place = np.array(start, dtype=np.int64)[:, None] + np.arange(WINDOW)
        inside = place < words.count[self.owner][:, None]
        at = np.minimum(words.first[self.owner][:, None] + place, max(len(which) - 1, 0))
        self.windows = np.where(inside, which[at] + 1, 0) if len(which) else np.zeros_like(place)


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 7):
        r = np.random.RandomState(seed)
        normal = lambda *shape: (r.randn(*shape) / np.sqrt(shape[0])).astype(np.float32)
        h, d = _HIDDEN, 2 * _DIM
        self.p = {
            "words": (0.3 * r.randn(_WORD_ROWS, _DIM)).astype(np.float32),
            "grams": (0.3 * r.randn(_GRAM_ROWS, _DIM)).astype(np.float32),
            "attend": normal(2 * h, h),
            "attend_v": normal(h),
            "out": normal(2 * h),
            "out_b": np.zeros(1, dtype=np.float32),
        }
        for side in "fb":
            self.p[f"x_{side}"], self.p[f"h_{side}"] = normal(d, 3 * h), normal(h, 3 * h)
            self.p[f"bias_{side}"] = np.zeros(3 * h, dtype=np.float32)

    def inputs(self, batch: Batch) -> np.ndarray:
        """Vectors of the distinct words, after a row of zeros for the empty place."""
        n = len(batch.word_rows)
        x = np.zeros((n + 1, 2 * _DIM), dtype=np.float32)
        if n:
            x[1:, :_DIM] = self.p["words"][batch.word_rows]
            ends = np.cumsum(batch.gram_count)
            sums = np.add.reduceat(self.p["grams"][batch.gram_rows], ends - batch.gram_count, axis=0)
            x[1:, _DIM:] = sums / np.sqrt(batch.gram_count)[:, None]
        return x

    def _run(self, side: str, projected: np.ndarray, windows: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, in the order of the places."""
        h = _HIDDEN
        u = self.p[f"h_{side}"]
        state = np.zeros((len(windows), h), dtype=np.float32)
        out = np.empty((WINDOW, len(windows), h), dtype=np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            x = projected[windows[:, t]]
            hu = state @ u
            gates = _sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, hu[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def forward(self, x: np.ndarray, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of every window."""
        states = []
        for side in "fb":
            trace: list | None = [] if keep is not None else None
            states.append(self._run(side, x @ self.p[f"x_{side}"] + self.p[f"bias_{side}"], windows, trace))
            if keep is not None:
                keep[side] = trace
        both = np.concatenate(states, axis=2)
        hidden = np.tanh(both @ self.p["attend"])
        weight = hidden @ self.p["attend_v"]
        weight = np.where(windows.T > 0, weight, np.float32(-30.0))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        if keep is not None:
            keep.update(both=both, hidden=hidden, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def scores(self, batch: Batch) -> np.ndarray:
        """Logit of every window of a batch, some at a time."""
        x = self.inputs(batch)
        parts = [self.forward(x, batch.windows[i : i + _CHUNK]) for i in range(0, len(batch.windows), _CHUNK)]
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.float32)

    def gradients(self, batch: Batch, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Gradient of the weighted logistic loss over some windows."""
        h, p = _HIDDEN, self.p
        keep: dict = {}
        x = self.inputs(batch)
        logit = self.forward(x, windows, keep)
        g: dict[str, np.ndarray] = {}
        d_logit = ((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32)
        g["out"], g["out_b"] = keep["pooled"].T @ d_logit, np.array([d_logit.sum()], dtype=np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        d_both = keep["weight"][:, :, None] * d_pooled[None]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, keep["both"])
        d_weight = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(axis=0))
        d_weight = np.where(windows.T > 0, d_weight, 0).astype(np.float32)
        g["attend_v"] = np.einsum("tb,tbh->h", d_weight, keep["hidden"])
        d_hidden = d_weight[:, :, None] * p["attend_v"] * (1 - keep["hidden"] ** 2)
        g["attend"] = keep["both"].reshape(-1, 2 * h).T @ d_hidden.reshape(-1, h)
        d_both += d_hidden @ p["attend"].T
        d_x = np.zeros_like(x)
        for i, side in enumerate("fb"):
            places, changes = [], []
            g_u, g_bias = np.zeros_like(p[f"h_{side}"]), np.zeros(3 * h, dtype=np.float32)
            d_state = np.zeros((len(windows), h), dtype=np.float32)
            for t, state, z, r, new, hn in reversed(keep[side]):
                d_state = d_state + d_both[t][:, i * h : (i + 1) * h]
                d_new = d_state * (1 - z) * (1 - new * new)
                d_z = d_state * (state - new) * z * (1 - z)
                d_r = d_new * hn * r * (1 - r)
                d_u = np.concatenate((d_z, d_r, d_new * r), axis=1)
                d_in = np.concatenate((d_z, d_r, d_new), axis=1)
                g_u += state.T @ d_u
                g_bias += d_in.sum(axis=0)
                places.append(windows[:, t])
                changes.append(d_in)
                d_state = d_state * z + d_u @ p[f"h_{side}"].T
            g[f"h_{side}"], g[f"bias_{side}"] = g_u, g_bias
            d_projected = scatter(len(x), np.concatenate(places), np.concatenate(changes))
            g[f"x_{side}"] = x.T @ d_projected
            d_x += d_projected @ p[f"x_{side}"].T
        g["words"] = scatter(_WORD_ROWS, batch.word_rows, d_x[1:, :_DIM])
        spread = d_x[1:, _DIM:] / np.sqrt(np.maximum(batch.gram_count, 1))[:, None]
        g["grams"] = scatter(_GRAM_ROWS, batch.gram_rows, np.repeat(spread, batch.gram_count, axis=0))
        return g


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, grad in g.items():
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            self.p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


class Model:
    """A network and the logit from which a text's highest window makes it toxic."""

    def __init__(self, network: Network | None, level: float):
        self.network, self.level = network, level

    def texts(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.level)
        batch = Batch(texts)
        logits = self.network.scores(batch)
        highest = np.full(len(texts), -np.inf)
        np.maximum.at(highest, batch.owner, logits)
        return 1 / (1 + np.exp(-np.clip(highest - self.level, -40, 40)))


def _batches(texts: list[bytes], labels: np.ndarray, order: np.ndarray, network: Network | None) -> Iterator[tuple]:
    """Groups of texts with windows, targets and weights for one pass."""
    for at in range(0, len(order), 16):
        own = order[at : at + 16]
        batch = Batch([texts[i] for i in own], TEXT_WINDOWS)
        toxic = labels[own][batch.owner] == 1
        target = toxic.astype(np.float32)
        weight = np.ones(len(target), dtype=np.float32)
        if network is not None:
            # Only windows found toxic, and the highest of each text, stay positive.
            logits = network.scores(batch)
            highest = np.full(len(own), -np.inf)
            np.maximum.at(highest, batch.owner, logits)
            target = (toxic & ((logits > 0) | (logits >= highest[batch.owner]))).astype(np.float32)
            weight[toxic & (target == 0)] = 0.3
        yield batch, target, weight


def fit(texts: list[bytes], labels: list[int], passes: int = _PASSES, seed: int = 7) -> Model:
    """Train on labelled texts; with labels of one kind only, the score is constant."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(None, float(y[0]) if len(y) else 0.0)
    r = np.random.RandomState(seed)
    # Texts of both kinds in turn, so that the level is set by both.
    rank = np.empty(len(y), dtype=np.int64)
    for kind in (0, 1):
        rank[y == kind] = np.arange((y == kind).sum())
    level_set = np.flatnonzero(rank % _LEVEL_EVERY == _LEVEL_EVERY - 1)
    if len(set(y[level_set].tolist())) < 2:
        level_set = np.arange(len(y))
    train = np.flatnonzero(rank % _LEVEL_EVERY != _LEVEL_EVERY - 1)
    network = Network(seed)
    adam = Adam(network.p, _RATE)
    number = 0
    while number < passes:
        adam.rate = _RATE * (1.0 if number < passes - 2 else 0.3)
        for batch, target, weight in _batches(texts, y, r.permutation(train), network if number >= passes // 2 else None):
            picks = r.permutation(len(batch.windows))
            for i in range(0, len(picks), _BATCH):
                own = picks[i : i + _BATCH]
                # Words left out at random, so that no window is known by its rare words.
                windows = batch.windows[own] * (r.random_sample((len(own), WINDOW)) >= _LEFT_OUT)
                adam.step(network.gradients(batch, windows, target[own], weight[own]))
        number += 1
        if number == 1:
            passes = max(passes, min(_MOST_PASSES, -(-_LEAST_STEPS // adam.t)))
    highest = np.full(len(level_set), -np.inf)
    for at in range(0, len(level_set), 32):
        batch = Batch([texts[i] for i in level_set[at : at + 32]])
        np.maximum.at(highest, at + batch.owner, network.scores(batch))
    return Model(network, _level(highest, y[level_set]))


def _level(highest: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between highest logits where fewest texts of the sample are told wrongly."""
    order = np.argsort(highest, kind="stable")
    toxic = y[order]
    # wrong[i]: the first i texts are called clean, the others toxic.
    wrong = np.concatenate(([0], np.cumsum(toxic))) + np.concatenate(([0], np.cumsum((toxic == 0)[::-1])))[::-1]
    at = np.concatenate(([highest[order][0] - 1], highest[order], [highest[order][-1] + 1]))
    gap = np.diff(at)
    best = np.flatnonzero(wrong == wrong.min())
    i = best[gap[best].argmax()]
    return float((at[i] + at[i + 1]) / 2)


def sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> list[tuple[bytes, int]]:
    """Labelled texts by a hash of their key, a bounded number of each kind."""
    told = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("y"))
    drawn = F.xxhash64(key)
    few = [
        told.where(F.col("y") == kind).orderBy(drawn, key).limit(most).select(key, "y")
        for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    # At most SAMPLE_TOXIC + SAMPLE_CLEAN keys.
    picked = few[0].unionByName(few[1])
    rows = documents.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key)
    texts = sorted(((r[0] or "").encode("utf-8"), r[1]) for r in rows.select("text", "y").collect())
    return texts


def _scores(model: Model, texts: pa.Array) -> pa.Array:
    scores = [model.texts(held) for _, held in slices(texts, _SLICE)]
    return pa.array(np.concatenate(scores) if scores else [], pa.float64())


def scored(documents: DataFrame, model: Model, carry: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """Carried columns and a score (0 to 1) of every whole text, under a name that no carried column has.

    Null and empty texts are one empty window and get its score.
    """
    columns = carry if text in carry else [*carry, text]
    at = columns.index(text)
    wanted = documents.select(*columns)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[: len(carry)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(i) for i in range(len(carry))]
            arrays.append(_scores(model, batch.column(at)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, name])

    return wanted.mapInArrow(run, ", ".join([*kinds, f"`{name}` double"]))


def clean(documents: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, with their own columns, whose score is under the least toxic one.

    They are written in this call, so that Python gets small batches, of texts alone, and gives back the scores.
    """
    score = F.arrow_udf(lambda texts: _scores(model, texts), "double")
    rows, own = for_files(documents.where(score(F.col(text)) < least))
    with small_batches(documents.sparkSession):
        rows = kept(rows, "clean")
    return own(rows)


def fitted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model learned from the labels of some documents.

    Labels other than 0 and 1, null keys and labels of unknown documents are not
    learned; several labels of one key count as toxic if any is.
    """
    rows = sample(documents, labels, key, text, label)
    model = fit([t for t, _ in rows], [y for _, y in rows])
    forget_powers()
    return model
