"""Best-fit packing of token sequences, certified by lower bounds and repacked where gaps remain.

1. Every document becomes ids and an end id. One longer than a sequence is cut
   into whole sequences, its first piece taking the remainder.
2. Pieces are dealt by hash into parts of a bounded number of pieces. Each part is
   packed by best-fit decreasing, and dual-feasible functions give a lower bound
   of its bins. A part that meets its bound is certified and done.
3. A part with a gap gives up its least filled bins, the gap's number of times
   over. Bins given up by all parts are dealt anew, whole, and their pieces are
   packed again by best-fit decreasing; the old bins stay if that takes no fewer.
   This repeats for a fixed number of rounds.

Each round is written before the next, so a lost executor repeats only its tasks.
Only counts reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from facetframe.llm.base import kept, small_batches
from facetframe.llm.tokens import ByteEncoder
from facetframe.llm.words import slices

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces of one part, the most that one task packs at once.
PART_PIECES = 16_384
ROUNDS = 4
#: Bins given up for each bin over the bound.
GIVEN_UP = 64
#: Bytes of texts whose ids are made at once.
_SLICE = 1_000_000

_PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(
    documents: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Carried columns, piece, start, length, ids_crc32 (and ids) of every piece; null text is empty."""
    rows = documents.select(*carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{kinds}, {_PIECE}" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(vocabulary)
        for batch in batches:
            for first, held in slices(batch.column(batch.num_columns - 1), _SLICE):
                ids, sizes = encoder.encode(held)
                ends = np.cumsum(sizes)
                row, piece, start, length, crc, own = [], [], [], [], [], []
                for t in range(len(held)):
                    all_ids = np.append(ids[ends[t] - sizes[t] : ends[t]], end_id).astype("<u4")
                    n, at = len(all_ids), 0
                    step = n % capacity or capacity
                    number = 0
                    while at < n:
                        part = all_ids[at : at + step]
                        row.append(first + t)
                        piece.append(number)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        own.append(part.astype(np.int32) if with_ids else None)
                        at, step, number = at + len(part), capacity, number + 1
                take = pa.array(row, pa.int64())
                arrays = [batch.column(i).take(take) for i in range(batch.num_columns - 1)]
                arrays += [pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
                names = batch.schema.names[:-1] + ["piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(own, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each piece: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    room = 0  # bit r is set while some bin has r left
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            number = open_bins[left].pop()
            if not open_bins[left]:
                room &= ~(1 << left)
        else:
            left, number = capacity, count
            count += 1
        bins[i] = number
        open_bins[left - size].append(number)
        room |= 1 << (left - size)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of three families of dual-feasible functions over the lengths, in whole bins."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    total, weight = np.cumsum(counts), np.cumsum(counts * size)
    for e in range(1, capacity // 2 + 1):
        # Pieces over capacity - e count as whole bins, those under e as nothing.
        large = int(total[-1] - total[capacity - e])
        middle = int(weight[capacity - e] - weight[e - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 33):
        # Rounding by k: multiples of capacity / (k + 1) stay, the rest is rounded down.
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    for e in range(2, capacity // 2 + 1):
        # Counting function: how many pieces of e fit beside a large one.
        most = capacity // e
        over = size > capacity // 2
        value = np.where(over, 2 * (most - (capacity - size) // e), np.where(size * 2 == capacity, most, 2 * (size // e)))
        best = max(best, -(-int((counts * value).sum()) // (2 * most)))
    return best


def _pack(rows: pd.DataFrame, round_number: int, capacity: int, last: bool) -> pd.DataFrame:
    """One part: its bins, its bound, and which bins are given up."""
    part = int(rows["_part"].iloc[0])
    lengths = rows["length"].to_numpy()
    bins = best_fit(lengths, capacity)
    before = rows["_bin"].to_numpy()
    if round_number and len(np.unique(before)) <= bins.max() + 1:
        bins = np.unique(before, return_inverse=True)[1]
    count = int(bins.max()) + 1
    bound = lower_bound(lengths, capacity)
    filled = np.bincount(bins, weights=lengths).astype(np.int64)
    given = np.zeros(count, dtype=bool)
    if count > bound and not last:
        worst = np.argsort(filled, kind="stable")[: GIVEN_UP * (count - bound)]
        given[worst[filled[worst] < capacity]] = True
    order = np.lexsort((-lengths, bins))
    rows, bins, lengths = rows.iloc[order].copy(), bins[order], lengths[order]
    ends = np.cumsum(lengths)
    leads = np.concatenate(([True], bins[1:] != bins[:-1])) if len(bins) else np.empty(0, dtype=bool)
    begin = np.maximum.accumulate(np.where(leads, ends - lengths, 0)) if len(bins) else bins
    rows["offset"] = ends - lengths - begin
    rows["_bin"] = (np.int64(round_number) << 58) | (np.int64(part) << 20) | bins
    rows["_given"] = given[bins]
    rows["part_bins"], rows["part_bound"] = count, bound
    return rows


_MADE = ["_bin", "_part", "offset", "_given", "part_bins", "part_bound"]


def _packer(number: int, capacity: int, last: bool, columns: list[str]):
    return lambda frame: _pack(frame, number, capacity, last)[columns]


def packed(cut: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``; lengths are 1 to capacity.

    Also returns ``part_bins`` and ``part_bound`` of the part that placed the row:
    equal numbers certify that no packing of that part takes fewer sequences. Repeated
    rows are packed each; an empty table gives no rows. Carried columns must not be
    named like the results.
    """
    columns = cut.columns
    with small_batches(cut.sparkSession):
        written = kept(cut, "pieces")
    rows = written.withColumn("_bin", F.monotonically_increasing_id())
    done: list[DataFrame] = []
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{fields}, _part long, offset long, _given boolean, part_bins long, part_bound long"
    for number in range(rounds):
        n = rows.count()
        if not n and done:
            break
        parts = max(1, round(n / part_pieces))
        last = number == rounds - 1 or (number > 0 and parts == 1)
        # Whole bins move together, so that old bins can stay where new ones are no better.
        dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(number), "_bin"), F.lit(parts)))
        out = kept(
            dealt.groupBy("_part").applyInPandas(_packer(number, capacity, last, [*columns, *_MADE]), schema),
            f"packed-{number}",
        )
        done.append(out.where(~F.col("_given")))
        rows = out.where("_given").select(*columns, "_bin")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select(*columns, F.col("_bin").alias("sequence_id"), "offset", "part_bins", "part_bound")


def pack_documents(documents: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), **sizes) -> DataFrame:
    """Pieces of all documents with the sequence and the offset of each."""
    return packed(pieces(documents, text, carry), **sizes)


def sequences(documents: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids) of whole packed sequences, the rows that training reads."""
    with_ids = pieces(documents, text, (key,), capacity, with_ids=True)
    placed = packed(with_ids, capacity)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    # A sequence holds at most `capacity` ids, so the list is bounded.
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
