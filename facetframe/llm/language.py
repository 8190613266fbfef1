"""Language identification by a blended-spectrum string kernel.

The kernel of two texts adds, for n-grams of one, two and three symbols, the number
of n-grams present in both over the geometric mean of the numbers present in each.
Landmark texts approximate it (Nystrom), and kernel ridge regression gives one score
per language against the rest. The product of the landmark n-grams, the whitening
and the regression weights is one matrix, so texts are scored in blocks by a product
of their presence matrix with it.

Symbols are the most frequent lower-cased letters of the sample; rarer letters share
symbols by code block; anything else is a gap, and runs of gaps are one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Bounds of the sample that the classifier is fitted on: rows in all, shared by the languages, the least share
#: of a language however many there are, and texts taken first. Every language is learned.
SAMPLE_ROWS = 1_600
LEAST_EACH = 8
SAMPLE_CHARS = 20_000
LANDMARKS = 160
RIDGE = 1e-2
ORDERS = (1, 2, 3)
_SYMBOLS = 64
_FREQUENT = 48
_WIDTH = sum(_SYMBOLS**n for n in ORDERS)
_AT_ONCE = 24
UNKNOWN = "und"


class Alphabet:
    """Symbol of every code point; 0 for what is no letter."""

    def __init__(self, letters: list[str]):
        self.letters = letters
        self.table: np.ndarray | None = None

    def _build(self) -> np.ndarray:
        symbol = {c: i + 1 for i, c in enumerate(self.letters)}
        table = np.zeros(0x10000, dtype=np.uint8)
        for code in range(0x10000):
            c = chr(code)
            if not 0xD800 <= code < 0xE000 and c.isalpha():
                low = c.lower()[:1]
                table[code] = symbol.get(low, _FREQUENT + 1 + (ord(low) >> 7) % (_SYMBOLS - _FREQUENT - 1))
        return table

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text with one gap before, between and after its words."""
        if self.table is None:
            self.table = self._build()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        wide = codes > 0xFFFF
        out = self.table[np.where(wide, 0, codes)]
        for i in np.flatnonzero(wide).tolist():
            if chr(codes[i]).isalpha():
                out[i] = _FREQUENT + 1 + (int(codes[i]) >> 7) % (_SYMBOLS - _FREQUENT - 1)
        out = np.concatenate((np.zeros(1, dtype=np.uint8), out, np.zeros(1, dtype=np.uint8)))
        return out[np.concatenate(([True], (out[1:] > 0) | (out[:-1] > 0)))].astype(np.int64)


def presence(rows: list[np.ndarray]) -> np.ndarray:
    """Which n-grams each text holds: one row per text, orders side by side."""
    out = np.zeros((len(rows), _WIDTH), dtype=bool)
    for i, s in enumerate(rows):
        base, code = 0, np.zeros(len(s), dtype=np.int64)
        for n in ORDERS:
            if len(s) < n:
                break
            code = code[: len(s) - n + 1] * _SYMBOLS + s[n - 1 :] if n > 1 else s
            out[i, base + code] = True
            base += _SYMBOLS**n
        out[i, 0] = False
    return out


def scaled(present: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The chosen columns over the root of the number of n-grams of their order in the text."""
    out = present[:, columns].astype(np.float32)
    base = 0
    for n in ORDERS:
        end = base + _SYMBOLS**n
        count = np.maximum(present[:, base:end].sum(axis=1), 1)
        low, high = np.searchsorted(columns, (base, end))
        out[:, low:high] /= np.sqrt(count)[:, None].astype(np.float32)
        base = end
    return out


class Model:
    """Languages, symbols, n-gram columns and their weights; scores texts in blocks."""

    def __init__(self, languages: list[str], letters: list[str], columns: np.ndarray, weights: np.ndarray, base: np.ndarray):
        self.languages, self.letters, self.columns, self.weights, self.base = languages, letters, columns, weights, base

    def score(self, texts: list[str], alphabet: Alphabet) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)), dtype=np.float32)
        for at in range(0, len(texts), _AT_ONCE):
            rows = [alphabet.symbols(t) for t in texts[at : at + _AT_ONCE]]
            out[at : at + _AT_ONCE] = scaled(presence(rows), self.columns) @ self.weights + self.base
        return out


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on a sample; None if it holds no language."""
    known = sorted(set(languages))
    if not known:
        return None
    counts: Counter = Counter()
    for text in texts:
        counts.update(c.lower()[:1] for c in text if c.isalpha())
    letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:_FREQUENT]]
    alphabet = Alphabet(letters)
    rows = [alphabet.symbols(t) for t in texts]
    by_language = {k: [i for i, x in enumerate(languages) if x == k] for k in known}
    share = max(1, landmarks // len(known))
    chosen = sorted(i for own in by_language.values() for i in own[:share])
    marks = presence([rows[i] for i in chosen])
    columns = np.flatnonzero(marks.any(axis=0))
    marks = scaled(marks, columns)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    project = marks.T.astype(np.float64) @ whiten
    features = np.concatenate(
        [scaled(presence(rows[i : i + _AT_ONCE]), columns) @ project for i in range(0, len(rows), _AT_ONCE)]
    )
    target = np.where(np.array(languages)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    # Languages weigh alike, whatever their shares of the sample.
    weight = np.array([1.0 / len(by_language[x]) for x in languages]) * len(languages) / len(known)
    mean_x, mean_y = np.average(features, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    centred = (features - mean_x) * weight[:, None]
    gram = centred.T @ (features - mean_x) + ridge * len(texts) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, centred.T @ (target - mean_y))
    base = mean_y - mean_x @ solved
    return Model(known, letters, columns, (project @ solved).astype(np.float32), base.astype(np.float32))


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(text, lang) of a sample with a bounded number of rows per language, by a hash of the text.

    Every language is in it, with as many distinct texts as there are up to its share;
    copies of a text count once.
    """
    texts = labelled.select("lang", F.xxhash64("text").alias("hash")).distinct()
    # One row per language.
    sizes = {r["lang"]: r["texts"] for r in texts.groupBy("lang").agg(F.count("*").alias("texts")).collect()}
    if not sizes:
        return []
    each = max(LEAST_EACH, rows // len(sizes))
    # A share by hash first, so that only a few times the wanted rows are ranked.
    share = labelled.sparkSession.createDataFrame(
        [(k, min(1.0, 4.0 * each / n + 1e-12)) for k, n in sizes.items()], "lang string, share double"
    )
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000
    few = labelled.join(F.broadcast(share), "lang").where((drawn < F.col("share")) | (F.col("share") >= 1))
    order = Window.partitionBy("lang").orderBy(F.length("text") > SAMPLE_CHARS, F.xxhash64("text"), "text")
    picked = few.select("text", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return sorted((r["text"], r["lang"]) for r in picked.collect())


def predicted(documents: DataFrame, labelled: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """Carried columns, lang_pred and score of every text.

    ``labelled`` holds (text, lang) rows to learn from; null languages and texts
    without a letter are not learned. A null text or one without a letter is ``und``
    with score 0, as is every text when there is nothing to learn from. The score is
    the winning regression value moved from (-1, 1) to (0, 1); equal values take the
    first language by name.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    rows = sample(usable)
    model = fit([t for t, _ in rows], [k for _, k in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet(model.letters if model else [])
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            lettered = [any(map(str.isalpha, t)) for t in texts]
            scores = model.score(texts, alphabet) if model else np.zeros((len(texts), 1), dtype=np.float32)
            best = scores.argmax(axis=1)
            names = [model.languages[b] if model and ok else UNKNOWN for b, ok in zip(best, lettered)]
            value = np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1).astype(np.float64)
            value = [float(v) if model and ok else 0.0 for v, ok in zip(value, lettered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array(names, pa.string()), pa.array(value)],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    wanted = documents.select(*carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(run, f"{kinds}, lang_pred string, score double")
