"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

Every item gives its windows of consecutive words; an item shorter than a window
is one window. Windows of one length form one search machine:

- a block is a pair of words (one word for one-word windows). The shift table
  holds, for each block of any window, its least distance to the end of a
  window; any other block lets the search jump a window less one word ahead;
- where the shift is 0, the bucket of that ending block names the windows that
  may end there, and the hash of their first block thins them;
- the bytes of the remaining windows are compared with those of the text.

The search runs over all texts of a slice at once: each text is cut into
stretches, and all stretches jump in step.

Items are broadcast in blocks of at most ``block_bytes`` of window text. More
items than one block holds are searched block after block on the same rows,
with no join or shuffle, so only memory for one block is ever needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from facetframe.llm.base import for_files, kept, small_batches
from facetframe.llm.words import LETTERED, Words, forget_powers, mixed, slices

WINDOW = 10
#: Bytes of window texts and keys in one broadcast block.
BLOCK_BYTES = 16_000_000
_STRETCH = 128
_COMPARED = 4_000_000


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, n_words, window text) of every item; words are joined by single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, texts = [], [], []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Words([(value or "").encode("utf-8")], LETTERED)
                words = [bytes(found.data[s:e]) for s, e in zip(found.starts, found.ends)]
                length = min(window, len(words))
                for i in range(len(words) - length + 1 if words else 0):
                    ids.append(item)
                    n.append(length)
                    texts.append(b" ".join(words[i : i + length]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(n, pa.int32()), pa.array(texts, pa.binary())],
                names=["item", "n_words", "window"],
            )

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, n_words int, window binary").distinct()


class Machine:
    """Wu-Manber tables for windows of one length in words."""

    def __init__(self, length: int, windows: list[bytes], items: list[list[int]]):
        self.length = length
        self.block = min(2, length)
        self.width = np.array([len(w) for w in windows], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.width)[:-1])).astype(np.int64)
        self.data = np.frombuffer(b"".join(windows), dtype=np.uint8)
        self.item_count = np.array([len(i) for i in items], dtype=np.int64)
        self.item_at = np.concatenate(([0], np.cumsum(self.item_count)[:-1])).astype(np.int64)
        self.items = np.array([i for group in items for i in group], dtype=np.int64)
        words = Words(windows, LETTERED)
        blocks = _blocks(words.hashes, self.block).reshape(-1)
        per = length - self.block + 1
        starts = words.first[:-1]
        keys = np.concatenate([blocks[starts + k] for k in range(per)])
        shifts = np.repeat(np.arange(per - 1, -1, -1), len(windows))
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        lead = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.keys, self.shifts = keys[lead], shifts[lead].astype(np.int64)
        # A coarse table of two bytes of the key rules out nearly all positions with one lookup.
        self.coarse = np.zeros(1 << 20, dtype=bool)
        self.coarse[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        suffix, prefix = blocks[starts + per - 1], blocks[starts]
        self.by_suffix = np.lexsort((prefix, suffix))
        self.suffix, self.prefix = suffix[self.by_suffix], prefix[self.by_suffix]

    def shift(self, blocks: np.ndarray) -> np.ndarray:
        out = np.full(len(blocks), self.length - self.block + 1, dtype=np.int64)
        maybe = np.flatnonzero(self.coarse[(blocks >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.keys, blocks[maybe])
        at[at == len(self.keys)] = 0
        known = self.keys[at] == blocks[maybe]
        out[maybe[known]] = self.shifts[at[known]]
        return out

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every occurrence."""
        blocks = _blocks(words.hashes, self.block)
        # The last word of a window lies from first + length - 1 to the end of its text.
        low = words.first[:-1] + self.length - 1
        high = words.first[1:]
        parts = np.maximum(0, -(-(high - low) // _STRETCH))
        text = np.repeat(np.arange(len(parts)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        place = low[text] + part * _STRETCH
        stop = np.minimum(place + _STRETCH, high[text])
        ends = []
        while len(place):
            step = self.shift(blocks[place - self.block + 1])
            ends.append(place[step == 0])
            place = place + np.maximum(step, 1)
            live = place < stop
            place, stop = place[live], stop[live]
        ends = np.sort(np.concatenate(ends)) if ends else np.empty(0, dtype=np.int64)
        return self._compare(words, blocks, ends - self.length + 1)

    def _compare(self, words: Words, blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        suffix = blocks[first + self.length - self.block]
        low = np.searchsorted(self.suffix, suffix, side="left")
        count = np.searchsorted(self.suffix, suffix, side="right") - low
        found_at, found = [], []
        at = 0
        total = np.cumsum(count)
        while at < len(first):
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + _COMPARED // 64, side="right")))
            n = count[at:stop]
            places = np.repeat(first[at:stop], n)
            ranks = np.repeat(low[at:stop], n) + np.arange(len(places)) - np.repeat(np.cumsum(n) - n, n)
            same = self.prefix[ranks] == blocks[places]
            places, numbers = places[same], self.by_suffix[ranks[same]]
            same = self._equal(words, places, numbers)
            found_at.append(places[same])
            found.append(numbers[same])
            at = stop
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)

    def _equal(self, words: Words, places: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Whether the words from a place on are those of a window, byte by byte."""
        starts, ends = words.starts, words.ends
        same = np.ones(len(places), dtype=bool)
        width = np.zeros(len(places), dtype=np.int64)
        for k in range(self.length):
            width += ends[places + k] - starts[places + k] + (k > 0)
        same &= width == self.width[numbers]
        at = self.at[numbers]
        for k in range(self.length):
            left = np.flatnonzero(same)
            s, n = starts[places[left] + k], ends[places[left] + k] - starts[places[left] + k]
            total = np.cumsum(n)
            inner = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - n, n)
            ours = np.repeat(s, n) + inner
            theirs = np.repeat(at[left], n) + inner
            end_ok = at[left] + n <= self.at[numbers[left]] + self.width[numbers[left]]
            differ = words.data[ours] != self.data[np.minimum(theirs, len(self.data) - 1)]
            bad = np.bincount(np.repeat(np.arange(len(left)), n), weights=differ, minlength=len(left)) > 0
            gap = at[left] + n
            last = k == self.length - 1
            closed = last | (self.data[np.minimum(gap, len(self.data) - 1)] == 0x20)
            same[left[bad | ~end_ok | ~closed]] = False
            at[left] = gap + 1
        return same


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    if size == 1:
        return hashes
    return mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else hashes[:0]


def _search(name: str, machines: list[Machine], labels: list[str], schema: pa.Schema):
    """Append (hits, items) of one block of windows to the columns before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(name))
            n_words, spans, items = [], [], []
            for _, held in slices(texts):
                words = Words(held, LETTERED)
                edge = np.zeros(len(words.hashes) + 1, dtype=np.int32)
                pairs = []
                for machine in machines:
                    places, numbers = machine.search(words)
                    np.add.at(edge, places, 1)
                    np.add.at(edge, places + machine.length, -1)
                    once = np.unique(words.text[places] * np.int64(len(machine.width)) + numbers)
                    text, number = once // len(machine.width), once % len(machine.width)
                    n = machine.item_count[number]
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    item = machine.items[np.repeat(machine.item_at[number], n) + inner]
                    pairs.append(np.stack([np.repeat(text, n), item]))
                hit = np.cumsum(edge[:-1]) > 0
                both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), dtype=np.int64)
                bounds = np.searchsorted(both[0], np.arange(len(held) + 1))
                turns = np.flatnonzero(np.diff(hit.view(np.int8), prepend=np.int8(0)))
                for t in range(len(held)):
                    first, stop = words.first[t], words.first[t + 1]
                    n_words.append(int(stop - first))
                    items.append([labels[i] for i in both[1][bounds[t] : bounds[t + 1]]])
                    spans.append(_runs(hit[first:stop]) if len(turns) else [])
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays += [
                pa.array(n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema)

    return run


def _holds(machines: list[Machine]):
    """Whether a text holds any window of one block; only the text goes to Python, and one flag comes back."""

    def test(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), dtype=bool)
        for first, held in slices(texts):
            words = Words(held, LETTERED)
            for machine in machines:
                places, _ = machine.search(words)
                found[first + words.text[places]] = True
        return pa.array(found)

    return F.arrow_udf(test, "boolean")


def _runs(flags: np.ndarray) -> list[int]:
    """Start, end, start, end ... of the runs of true flags."""
    return np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()


def _merge(batches: Iterator[pa.RecordBatch], blocks: int, schema: list[str], kept_columns: int):
    for batch in batches:
        n_words = batch.column(kept_columns).to_pylist()
        spans = [batch.column(kept_columns + 3 * b + 1).to_pylist() for b in range(blocks)]
        items = [batch.column(kept_columns + 3 * b + 2).to_pylist() for b in range(blocks)]
        hits, names, marks = [], [], []
        for row, n in enumerate(n_words):
            flags = np.zeros(n, dtype=bool)
            for b in range(blocks):
                edges = spans[b][row]
                for s, e in zip(edges[0::2], edges[1::2]):
                    flags[s:e] = True
            hits.append(int(flags.sum()))
            marks.append(_runs(flags))
            names.append(sorted({x for b in range(blocks) for x in items[b][row]}))
        arrays = [batch.column(i) for i in range(kept_columns)]
        arrays += [
            pa.array(n_words, pa.int64()),
            pa.array(hits, pa.int64()),
            pa.array(marks, pa.list_(pa.int32())),
            pa.array(names, pa.list_(pa.string())),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=schema)


def _window_blocks(
    items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int
) -> list[tuple[list[Machine], list[str]]]:
    """(machines, item ids) of blocks of windows in a fixed order; one without windows if there are none."""
    pool = items.where(F.col(item_id).isNotNull())
    windows = kept(item_windows(pool, item_id, item_text, window), "windows")
    grouped = windows.groupBy("n_words", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    blocks: list[tuple[list[Machine], list[str]]] = []
    held: dict[int, list[tuple[bytes, list[str]]]] = {}
    size = 0
    for row in grouped.orderBy("n_words", "window").toLocalIterator():
        cost = len(row["window"]) + 64 + sum(len(i) + 8 for i in row["items"])
        if held and size + cost > block_bytes:
            blocks.append(_machines(held))
            held, size = {}, 0
        held.setdefault(row["n_words"], []).append((bytes(row["window"]), row["items"]))
        size += cost
    if held or not blocks:
        blocks.append(_machines(held))
    return blocks


def benchmark_hits(
    documents: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document with the benchmark passages it holds.

    Returns the carried columns (by default all but the text), then ``n_words``,
    ``n_hit`` (words inside any occurrence), ``hit_spans`` (start, end, start,
    end ... in words), ``items`` (ids as strings, sorted) and ``items_sha256``.

    Words are runs of ASCII letters and digits and of anything beyond ASCII;
    A to Z are lower-cased first. A null or empty text has no words and no hit.
    An item without words, null ones included, is never found; a null item id is
    left out. Items with equal windows are all named. Repeated rows and null ids
    of documents stay as they are. A carried column whose name clashes with one of
    the results is carried under the prefix ``doc_``.
    """
    carry = [c for c in documents.columns if c != text] if carry is None else carry
    added = {"n_words", "n_hit", "hit_spans", "items", "items_sha256"}
    renamed = {c: c if c not in added else f"doc_{c}" for c in carry}
    blocks = _window_blocks(items, item_id, item_text, window, block_bytes)
    rows = documents.select(*[F.col(c).alias(renamed[c]) for c in carry], F.col(text).alias("_text"))
    fields = list(rows.schema.fields)
    for b, (machines, labels) in enumerate(blocks):
        fields = fields + [
            T.StructField(f"_n_{b}", T.LongType()),
            T.StructField(f"_spans_{b}", T.ArrayType(T.IntegerType())),
            T.StructField(f"_items_{b}", T.ArrayType(T.StringType())),
        ]
        rows = rows.mapInArrow(_search("_text", machines, labels, [f.name for f in fields]), T.StructType(fields))
    # The text is not wanted any more; the merge sees the carried columns and the blocks.
    rows = rows.drop("_text")
    out = T.StructType(
        [f for f in rows.schema.fields if f.name in renamed.values()]
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("items_sha256", T.StringType()),
        ]
    )
    n_blocks, names, n_kept = len(blocks), out.fieldNames(), len(carry)
    return rows.mapInArrow(lambda batches: _merge(batches, n_blocks, names, n_kept), out)


def clean(
    documents: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with their own columns, that hold no window of any item.

    They are written in this call, so that Python gets small batches, of texts
    alone, and a task needs one Python worker, with the tables of all blocks.
    """
    rows, own = for_files(documents)
    body = f"c{documents.columns.index(text)}"
    with small_batches(documents.sparkSession):
        for machines, _ in _window_blocks(items, item_id, item_text, window, block_bytes):
            rows = rows.where(~_holds(machines)(body))
        rows = kept(rows, "decontaminated")
    return own(rows)


def _machines(held: dict[int, list[tuple[bytes, list[str]]]]) -> tuple[list[Machine], list[str]]:
    labels = sorted({i for group in held.values() for _, items in group for i in items})
    number = {label: i for i, label in enumerate(labels)}
    machines = [
        Machine(length, [w for w, _ in group], [[number[i] for i in items] for _, items in group])
        for length, group in sorted(held.items())
    ]
    forget_powers()
    return machines, labels
