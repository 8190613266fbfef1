"""Funnels: which of some ordered steps each group reached within a span.

A group's time line is cut into chunks of equal width, so that a hot group is spread
over as many tasks as it has chunks. The rows of a chunk fold into a summary of fixed
size, chunk summaries fold into the group's result:

* ``after[j][m]``: the earliest time at which a chain that enters with j steps done has m,
* ``start[m]``: the latest start of a chain inside that has m steps done at the end,
* ``hit[m]``: the earliest time at which a chain inside had m steps.

Of chains with equally many steps the one with the latest start can do all that the
others can, so two neighbouring summaries make one without a look at their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from facetframe.operators.frames import cell
from facetframe.operators.table_functions import folded

DAY = 86_400_000_000
_NEVER = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


class Summary:
    """What a stretch of a time line does to chains, for k steps and a span in microseconds."""

    def __init__(self, k: int, span: int):
        self.k, self.span = k, span
        self.after = np.full((k + 1, k + 1), _NEVER, dtype=np.int64)
        self.start = np.full(k + 1, _NONE, dtype=np.int64)
        self.hit = np.full(k + 1, _NEVER, dtype=np.int64)

    @classmethod
    def of_rows(cls, at: np.ndarray, steps: np.ndarray, k: int, span: int) -> Summary:
        """Rows in order; bit m - 1 of ``steps`` says that the row can be step m."""
        made = cls(k, span)
        places = [np.flatnonzero(steps & (1 << m)) for m in range(k)]
        for j in range(1, k):
            place = -1
            for m in range(j, k):
                i = np.searchsorted(places[m], place, side="right")
                if i == len(places[m]):
                    break
                place = places[m][i]
                made.after[j, m + 1] = at[place]
        rows, starts = places[0], at[places[0]]
        for m in range(1, k + 1):
            if not len(rows):
                break
            made.start[m], made.hit[m] = starts.max(), at[rows[0]]
            if m < k:
                best = np.maximum.accumulate(starts)
                before = np.searchsorted(rows, places[m], side="left") - 1
                follows = places[m][before >= 0]
                begun = best[before[before >= 0]]
                held = at[follows] - begun <= span
                rows, starts = follows[held], begun[held]
        return made

    def then(self, other: Summary) -> Summary:
        """This stretch followed by another."""
        k, out = self.k, Summary(self.k, self.span)
        out.start, out.hit = np.maximum(self.start, other.start), np.minimum(self.hit, other.hit)
        for m in range(1, k + 1):
            for j in range(1, m):
                done = [l for l in range(j, m) if l == j or self.after[j, l] < _NEVER]
                later = min(other.after[l, m] for l in done)
                out.after[j, m] = min(self.after[j, m], later)
                begun, at = self.start[j], other.after[j, m]
                if begun != _NONE and at != _NEVER and int(at) - int(begun) <= self.span:
                    out.start[m] = max(out.start[m], begun)
                    out.hit[m] = min(out.hit[m], at)
        return out

    def numbers(self) -> list[int]:
        return [*self.after.ravel().tolist(), *self.start.tolist(), *self.hit.tolist()]

    @classmethod
    def of_numbers(cls, numbers: Sequence[int], k: int, span: int) -> Summary:
        made, cells = cls(k, span), (k + 1) ** 2
        held = np.array(numbers, dtype=np.int64)
        made.after = held[:cells].reshape(k + 1, k + 1)
        made.start, made.hit = held[cells : cells + k + 1], held[cells + k + 1 :]
        return made


def _chunk_fold(keys: list[str], k: int, span: int):
    """Rows of a chunk to its summary."""

    class Chunk:
        def __init__(self) -> None:
            self.summary, self.head = Summary(k, span), None

        def add(self, batch: pa.RecordBatch) -> None:
            if self.head is None:
                self.head = batch.slice(0, 1)
            at, steps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "_steps"))
            self.summary = self.summary.then(Summary.of_rows(at, steps, k, span))

        def result(self) -> pa.Table:
            columns = [self.head.column(c) for c in [*keys, "_chunk"]]
            return pa.table([*columns, pa.array([self.summary.numbers()], pa.list_(pa.int64()))], names=[*keys, "_chunk", "_summary"])

    return Chunk


def _group_fold(keys: list[str], k: int, span: int):
    """Chunk summaries of a group to the steps that it reached."""

    class Group:
        def __init__(self) -> None:
            self.summary, self.head = Summary(k, span), None

        def add(self, batch: pa.RecordBatch) -> None:
            if self.head is None:
                self.head = batch.slice(0, 1)
            for numbers in batch.column("_summary").to_pylist():
                self.summary = self.summary.then(Summary.of_numbers(numbers, k, span))

        def result(self) -> pa.Table:
            hit = self.summary.hit
            reached = max([m for m in range(1, k + 1) if hit[m] != _NEVER], default=0)
            at = int(hit[reached]) if reached else None
            columns = [self.head.column(c) for c in keys]
            return pa.table([*columns, pa.array([reached], pa.int32()), pa.array([at], pa.int64())], names=[*keys, "reached", "_micros"])

    return Group


def funnel(
    df: DataFrame, by: Sequence[str], ts: str, steps: Sequence[Column], within: int, order: Sequence[str] = (), chunk: int = DAY
) -> DataFrame:
    """(by, reached, reached_at) of every group: the most steps done in order within the span.

    A chain takes one row per step, each after the one before, the last at most
    ``within`` microseconds after the first. Rows are ordered by ``ts`` and then by
    ``order``, which must tell apart rows of one time; a row serves one step of a chain.
    ``steps`` are predicates and may overlap; null counts as no. ``reached_at`` is when
    the deepest step was first reached; groups that did not do the first step have 0 and
    null. Rows without a time take no part but keep their group; null keys are a group;
    at most 62 steps.

    Rows that are no step stay out of the shuffle. A group has a summary per ``chunk``
    microseconds in which it has steps; these are folded in one task, so choose wider
    chunks for time lines of very many chunks.
    """
    by, k = list(by), len(steps)
    if not 0 < k <= 62:
        raise ValueError("a funnel has 1 to 62 steps")
    bits = [F.when(F.coalesce(step, F.lit(False)), F.lit(1 << m)).otherwise(F.lit(0)).cast("long") for m, step in enumerate(steps)]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    # Keys travel under names of their own, so that no column can clash.
    keys = [f"_key{i}" for i in range(len(by))]
    ranks = [f"_rank{i}" for i in range(len(order))]
    marked = df.select(
        *[cell(c).alias(k_) for c, k_ in zip(by, keys)],
        F.unix_micros(cell(ts).cast("timestamp")).alias("_at"),
        *[cell(c).alias(r) for c, r in zip(order, ranks)],
        mask.alias("_steps"),
    )
    line = marked.where("_at IS NOT NULL AND _steps > 0").withColumn("_chunk", F.floor(F.col("_at") / chunk))
    kinds = dict(line.dtypes)
    named = "".join(f"{c} {kinds[c]}, " for c in keys)
    summaries = folded(
        line, _chunk_fold(keys, k, within), f"{named}_chunk bigint, _summary array<bigint>", [*keys, "_chunk"], ["_at", *ranks]
    )
    reached = folded(summaries, _group_fold(keys, k, within), f"{named}reached int, _micros bigint", keys, ["_chunk"])
    nothing = marked.select(*keys).distinct().select(*keys, F.lit(0).alias("reached"), F.lit(None).cast("bigint").alias("_micros"))
    whole = reached.unionByName(nothing).groupBy(*keys).agg(F.max("reached").alias("reached"), F.max("_micros").alias("_micros"))
    return whole.select(
        *[F.col(k_).alias(c) for c, k_ in zip(by, keys)], "reached", F.timestamp_micros("_micros").alias("reached_at")
    )
