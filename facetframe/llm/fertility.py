"""Quality rules by tokeniser fertility.

A public vocabulary measures every text: characters per token, share of tokens
that fall back to bytes, and entropy of the tokens in bits. What is usual differs
by script and length, so bands are taken per (script, power of two of the number
of tokens) from all rows that pass the base rules: the median, give or take a
multiple of the spread between quartiles. Only what lies far outside its band is
rejected. The fewer rows a group has, the more its band leans on its script's, and the
fewer a script has, the wider its bands are; no number of rows switches a rule on or off.
Quartiles are exact: values, cut to thousandths, are counted per group before any shuffle.

Texts are measured in one pass with no shuffle; each distinct word is encoded once
per slice. The band table has at most one row per script and power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from facetframe.llm.base import kept
from facetframe.llm.tokens import vocabulary_path
from facetframe.llm.words import SPACED, Words, slices

VOCABULARY = "piece_bpe_32k.model"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
#: Spreads away from the median that are still usual, by measure.
BAND = {"chars_per_token": 3.0, "byte_share": 3.0, "token_entropy": 2.5}
#: Rows with which the band of a script weighs in that of a group, and a wide band in that of a script.
PRIOR_ROWS = 20
#: Steps of a measure's unit in which quartiles are told.
STEPS = 1_000
#: Least spread of each measure, so that uniform groups reject nothing for a trifle.
LEAST_SPREAD = {"chars_per_token": 0.12, "byte_share": 0.02, "token_entropy": 0.2}
#: Measures rejected below, above or on both sides of their band.
SIDES = {"chars_per_token": (True, True), "byte_share": (False, True), "token_entropy": (True, False)}

SCRIPTS = ("none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "other", "kana", "han", "hangul")


def _script_of_byte() -> np.ndarray:
    """Script of a character by the first byte of its UTF-8 form."""
    out = np.zeros(256, dtype=np.int64)
    ranges = {
        "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)],
        "greek": [(0xCD, 0xCF)],
        "cyrillic": [(0xD0, 0xD4)],
        "hebrew": [(0xD6, 0xD7)],
        "arabic": [(0xD8, 0xDD)],
        "indic": [(0xE0, 0xE0)],
        "other": [(0xD5, 0xD5), (0xDE, 0xDF), (0xE1, 0xE1), (0xF0, 0xF4)],
        "kana": [(0xE3, 0xE3)],
        "han": [(0xE4, 0xE9)],
        "hangul": [(0xEA, 0xED)],
    }
    for name, spans in ranges.items():
        for low, high in spans:
            out[low : high + 1] = SCRIPTS.index(name)
    return out


class _Pieces:
    """Tokens of distinct words: ids, number, and how many are bytes."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        if not len(words.hashes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        _, where, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        data = words.data.tobytes()
        texts = [data[s:e].decode("utf-8") for s, e in zip(words.starts[where].tolist(), words.ends[where].tolist())]
        found = self.model.encode(texts, num_threads=1)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.int64, count=int(size.sum()))
        at = np.cumsum(size) - size
        n = size[which]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return flat[np.repeat(at[which], n) + inner], n


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of flags over each text's bytes."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[np.concatenate(([0], ends))])


def measures(texts: list[bytes], pieces: _Pieces) -> dict[str, list]:
    words = Words(texts, SPACED, lower=False)
    n_texts = len(texts)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=n_texts))
    leads = (words.data & 0xC0) != 0x80
    word_chars = _sums(leads & SPACED[words.data], ends)
    symbols = np.zeros(256, dtype=bool)
    symbols[list(b"#*$%&|<>")] = True
    script = _script_of_byte()[words.data]
    per_script = np.stack([_sums(script == i, ends) for i in range(1, len(SCRIPTS))])
    duplicates = []
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        duplicates.append(len(lines) - len(set(lines)))
    first, hashes = words.runs(3)
    repeated = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    if len(first):
        owner = words.text[first]
        order = np.lexsort((hashes, owner))
        same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
        twice = first[order][np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + 3, -1)
    covered = np.cumsum(repeated[:-1]) > 0
    n_repeat = np.bincount(words.text, weights=covered, minlength=n_texts).astype(np.int64)
    ids, per_word = pieces.encode(words)
    owner = np.repeat(words.text, per_word)
    n_tokens = np.bincount(owner, minlength=n_texts)
    n_bytes = np.bincount(owner, weights=pieces.is_byte[ids], minlength=n_texts)
    keys, counts = np.unique(owner * np.int64(len(pieces.is_byte)) + ids, return_counts=True)
    owner = keys // len(pieces.is_byte)
    share = counts / np.maximum(n_tokens, 1)[owner]
    entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=n_texts)
    some = np.maximum(n_tokens, 1)
    return {
        "n_words": words.count,
        "word_chars": word_chars,
        "n_symbols": _sums(symbols[words.data], ends),
        "n_dup_lines": duplicates,
        "n_repeat_words": n_repeat,
        "n_tokens": n_tokens,
        "chars_per_token": word_chars / some,
        "byte_share": n_bytes / some,
        "token_entropy": entropy,
        "script": [SCRIPTS[i] for i in np.where(per_script.any(axis=0), per_script.argmax(axis=0) + 1, 0)],
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_DOUBLES = ("chars_per_token", "byte_share", "token_entropy")


def measured(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Base counts and fertility of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(vocabulary)
        for batch in batches:
            for first, held in slices(batch.column(1)):
                found = measures(held, pieces)
                arrays = [batch.column(0).slice(first, len(held))]
                arrays += [pa.array(np.asarray(found[c], dtype=np.int64)) for c in _LONGS]
                arrays += [pa.array(np.asarray(found[c], dtype=np.float64)) for c in _DOUBLES]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found["script"])], names=["id", *_LONGS, *_DOUBLES, "script"])

    kind = dict(documents.dtypes)[doc_id]
    schema = f"id {kind}, " + ", ".join([f"{c} long" for c in _LONGS] + [f"{c} double" for c in _DOUBLES]) + ", script string"
    return documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _quartiles(counted: DataFrame, by: list[str]) -> DataFrame:
    """Number of rows, and median and spread of each measure, of every group, out of counts of values."""
    keys = [*by, "measure"]
    # A group has as many rows here as a measure has steps.
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = [F.min(F.when(F.col("upto") * 4 >= F.col("n") * k, F.col("value"))) / STEPS for k in (1, 2, 3)]
    found = ranked.groupBy(*keys, "n").agg(*[q.alias(f"q{k}") for k, q in enumerate(at, 1)])
    least = F.element_at(F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair]), F.col("measure"))
    return found.select(*keys, "n", F.col("q2").alias("median"), F.greatest((F.col("q3") - F.col("q1")) / 1.349, least).alias("spread"))


def bands(rows: DataFrame) -> DataFrame:
    """Low and high bound of each measure per script and length class."""
    measure = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.floor(F.col(c) * STEPS).alias("value")) for c in _DOUBLES]))
    flat = rows.select("script", "length_class", measure.alias("m")).select("script", "length_class", "m.*")
    counted = flat.groupBy("script", "length_class", "measure", "value").agg(F.count("*").alias("c"))
    of_script = _quartiles(counted.groupBy("script", "measure", "value").agg(F.sum("c").alias("c")), ["script"]).select(
        "script", "measure", F.col("median").alias("whole"), (F.col("spread") * (1 + F.lit(PRIOR_ROWS) / F.col("n"))).alias("wide")
    )
    groups = _quartiles(counted, ["script", "length_class"]).join(of_script, ["script", "measure"])
    own = F.col("n") / (F.col("n") + PRIOR_ROWS)
    median = own * F.col("median") + (1 - own) * F.col("whole")
    # What the group's median differs from its script's is not held against it.
    spread = own * F.col("spread") + (1 - own) * (F.col("wide") + F.abs(F.col("median") - F.col("whole")))
    told = groups.select("script", "length_class", "measure", median.alias("median"), spread.alias("spread"))
    out = []
    for c in _DOUBLES:
        of = lambda sign: F.max(F.when(F.col("measure") == c, F.col("median") + sign * BAND[c] * F.col("spread")))  # noqa: B023,E731
        out += [of(-1).alias(f"low_{c}"), of(1).alias(f"high_{c}")]
    return told.groupBy("script", "length_class").agg(*out)


def judged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Measures, base_failed and kept of every row.

    A null or empty text has no words and fails the base rules, as any text under
    50 words does. Texts of repeated rows count each. Values at a bound are inside. Other columns are not read.
    """
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > n * MOST_REPEATED)
    length_class = F.when(F.col("n_tokens") > 0, F.floor(F.log2("n_tokens")).cast("int")).otherwise(0)
    rows = kept(
        measured(documents, doc_id, text, vocabulary).withColumn("base_failed", failed).withColumn("length_class", length_class),
        "fertility",
    )
    # At most one row per script and power of two.
    table = F.broadcast(bands(rows.where(~F.col("base_failed"))))
    joined = rows.join(table, ["script", "length_class"], "left")
    odd = F.lit(False)
    for c, (below, above) in SIDES.items():
        if below:
            odd = odd | (F.col(c) < F.col(f"low_{c}"))
        if above:
            odd = odd | (F.col(c) > F.col(f"high_{c}"))
    kept_row = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return joined.select(F.col("id").alias(doc_id), *_LONGS, *_DOUBLES, "script", "base_failed", kept_row.alias("kept"))
