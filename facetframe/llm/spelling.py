"""Spelling variants: words one edit apart, found by pivotal grams.

All bigrams have one total order, rare ones first. A word's prefix is its three
first bigrams in that order (with all places of the third); two of them that share
no letter are its pivots, chosen for the least summed frequency by dynamic
programming over their places. Of two words one edit apart take the one whose
prefix ends first: the edit leaves at least one of its pivots whole, and as the
other word's prefix reaches as far in the order, it holds that bigram too. The
place limits: the edit lies on one side of the pivot, so up to the pivot's end, or
from its start on, the words are the same, and their lengths differ by one at most.
A pivot therefore meets only prefix bigrams with an equal hash of that side and a
fitting length; the letters that occur an odd number of times and then the edit
distance confirm each pair inside the join.

Cases: null words and words of under three bigrams are left out; repeated words are
added up; an empty table gives an empty one; ties of frequency are ordered by the
bigram, ties of a form by code points. Columns other than the word and its number
are not read, so their names cannot clash. A word of any length is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetframe.llm.base import kept
from facetframe.llm.words import mixed

#: Frequencies of so many bigrams are known to the tasks, the commonest; all others are rarer and ordered by themselves.
KNOWN_GRAMS = 1 << 16
#: Bigrams of a prefix, by the method: letters of a gram times edits, and one.
PREFIX = 3
LEAST_LETTERS = PREFIX + 1
#: Letters worked on at once.
CELLS = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POINT_BITS = np.uint64(21)
_UNKNOWN = np.int64(1 << 42)
_ROWS = "key long, word string, n long, last long, odd long"


def gram_counts(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, number of words' places) of the commonest bigrams, ascending by code."""
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.select(F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    top = grams.groupBy("gram").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "gram").limit(KNOWN_GRAMS).collect()
    codes = np.array([(ord(r["gram"][0]) << int(_POINT_BITS)) | ord(r["gram"][1]) for r in top], dtype=np.uint64)
    counts = np.array([r["c"] for r in top], dtype=np.int64)
    order = np.argsort(codes)
    return codes[order], counts[order]


class _Order:
    """The total order of bigrams and their frequencies."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts
        self.rank = np.empty(len(codes), dtype=np.int64)
        self.rank[np.lexsort((codes, counts))] = np.arange(len(codes))

    def of(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, frequency) of each bigram; unknown ones come first, by their code."""
        if not len(self.codes):
            return grams.astype(np.int64), np.zeros(grams.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        known = self.codes[at] == grams
        return np.where(known, self.rank[at] + _UNKNOWN, grams.astype(np.int64)), np.where(known, self.counts[at], 0)


def pivots(order: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the prefix as a mask, last order of the prefix, two pivot places) per row.

    Row by row the cheapest prefix bigram up to each place is carried along; a
    second one, two places on at least, is added to it, and the cheapest sum wins
    (the first of equal ones).
    """
    last = np.partition(order, PREFIX - 1, axis=1)[:, PREFIX - 1]
    prefix = order <= last[:, None]
    far = np.int64(1) << np.int64(60)
    cost = np.where(prefix, frequency, far)
    so_far = np.minimum.accumulate(cost, axis=1)
    second = np.argmin(cost[:, 2:] + so_far[:, :-2], axis=1) + 2
    places = np.arange(order.shape[1])
    first = np.argmin(np.where(places[None, :] <= second[:, None] - 2, cost, 2 * far), axis=1)
    return prefix, last, np.stack((first, second), axis=1)


def _powers(size: int) -> np.ndarray:
    out = np.full(size, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _halves(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what ends with, and of what starts with, the bigram at each place."""
    power = _powers(points.shape[1])
    ups = np.cumsum((points + np.uint64(1)) * power, axis=1)
    downs = np.cumsum(((points + np.uint64(1)) * power[::-1])[:, ::-1], axis=1)[:, ::-1]
    return mixed(ups[:, 1:]), mixed(downs[:, :-1])


def _keys(halves: np.ndarray, side: int, length: int) -> np.ndarray:
    return mixed(halves ^ mixed(np.full(1, 2 * length + side, dtype=np.uint64))).view(np.int64)


def _odd_letters(points: np.ndarray) -> np.ndarray:
    """A bit per letter (modulo 64) that occurs an odd number of times: one edit turns two bits at most."""
    return np.bitwise_xor.reduce(np.uint64(1) << (points & np.uint64(63)), axis=1).view(np.int64)


def _entries(points: np.ndarray, order: _Order, as_pivots: bool) -> tuple[np.ndarray, ...]:
    """(row, key, last order, odd letters) of the words of one length."""
    length = points.shape[1]
    ranks, frequency = order.of((points[:, :-1] << _POINT_BITS) | points[:, 1:])
    prefix, last, chosen = pivots(ranks, frequency)
    halves = _halves(points)
    if as_pivots:
        row, place = np.repeat(np.arange(len(points)), 2), chosen.reshape(-1)
        lengths = (length - 1, length, length + 1)
    else:
        row, place = np.nonzero(prefix)
        lengths = (length,)
    found = [_keys(half[row, place], side, n) for side, half in enumerate(halves) for n in lengths]
    row = np.tile(row, len(found))
    return row, np.concatenate(found), last[row], _odd_letters(points)[row]


def _gram_rows(grams: tuple[np.ndarray, np.ndarray], as_pivots: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _Order(*grams)
        for batch in batches:
            words, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            starts = np.cumsum(lengths) - lengths
            for length in np.unique(lengths).tolist():
                same = np.flatnonzero(lengths == length)
                step = max(1, CELLS // length)
                for at in range(0, len(same), step):
                    part = same[at : at + step]
                    row, key, last, odd = _entries(points[starts[part][:, None] + np.arange(length)], order, as_pivots)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key),
                            batch.column(0).take(pa.array(part[row])),
                            pa.array(numbers[part[row]]),
                            pa.array(last),
                            pa.array(odd),
                        ],
                        names=["key", "word", "n", "last", "odd"],
                    )

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of words one edit apart, once.

    `words` has one row per word: word, n. Nothing is dropped: every pair that one
    inserted, deleted or replaced code point apart joins is returned in both ways.
    """
    grams = gram_counts(words)
    rows = words.select("word", "n")
    left = rows.mapInArrow(_gram_rows(grams, True), _ROWS).alias("p")
    right = rows.mapInArrow(_gram_rows(grams, False), _ROWS).alias("q")
    met = left.join(
        right,
        (F.col("p.key") == F.col("q.key"))
        & (F.col("p.last") <= F.col("q.last"))
        & (F.bit_count(F.col("p.odd").bitwiseXOR(F.col("q.odd"))) <= 2)
        & (F.col("p.word") != F.col("q.word"))
        & (F.levenshtein(F.col("p.word"), F.col("q.word"), 1) == 1),
    ).select(
        F.least("p.word", "q.word").alias("a"),
        F.greatest("p.word", "q.word").alias("b"),
        F.when(F.col("p.word") < F.col("q.word"), F.col("p.n")).otherwise(F.col("q.n")).alias("a_n"),
        F.when(F.col("p.word") < F.col("q.word"), F.col("q.n")).otherwise(F.col("p.n")).alias("b_n"),
    )
    pairs = met.distinct()
    ways = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    return pairs.select(F.inline(ways))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following forms: each round doubles the steps that are made.

    A form is at least `ratio` times as frequent as its word, so chains are short
    and never come back to a word.
    """
    reached = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        moved = kept(
            reached.join(onward, F.col("root") == F.col("_word"), "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        if moved.where("_moved").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def grouped(counts: DataFrame, ratio: float = 2.0) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word with its number (columns word, n).

    The form of a word is its near word of largest n (of equal ones the smallest by
    code points) if that n is at least `ratio` (over 1) times the word's own. The
    root is where following forms ends; a word without a form is its own root.
    """
    if ratio <= 1:
        raise ValueError("forms lead nowhere unless they are more frequent than their words")
    words = kept(counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    long_enough = words.where(F.char_length("word") >= LEAST_LETTERS)
    best = (
        near_words(long_enough)
        .groupBy("word", "n")
        .agg(
            F.count("*").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best"),
        )
    )
    found = kept(
        best.select(
            "word",
            "n_near",
            F.when(-F.col("_best.less") >= F.lit(ratio) * F.col("n"), F.col("_best.near")).alias("form"),
            F.when(-F.col("_best.less") >= F.lit(ratio) * F.col("n"), -F.col("_best.less")).alias("form_n"),
        ),
        "near",
    )
    roots = _roots(found.where("form IS NOT NULL"))
    return (
        words.join(found, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            "form",
            "form_n",
            F.coalesce("root", "word").alias("root"),
        )
    )
