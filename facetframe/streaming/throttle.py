"""Throttling: keep an event only if enough time passed since the last KEPT one.

A dropped event does not move the clock, so this is a chain and no plain lag.
The time line of every key is cut into chunks: a first pass finds, for every moment
at which a chunk may be entered, when it is left; folding those few rows per key
gives the true entry of each chunk, and a second pass marks the kept events. All
keys take this route, whatever their size, and a hot key is spread over many tasks.
Every pass streams over sorted Arrow batches with a constant amount of state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from facetframe.operators.frames import cell

CLICK_MS = 750
FEATURE_MS = 5000
CHUNK_GAPS = 200


class _ChunkMap:
    """Entry moment -> exit moment of one chunk, built while its events go by."""

    def __init__(self, start: int, gap: int):
        self.early_until = start + gap
        self.gap = gap
        self.closed = False
        self.starts: list[int] = []
        self.leader: list[int] = []
        self.chains: deque[tuple[int, int]] = deque()
        self.exits: dict[int, int] = {}

    def _root(self, i: int) -> int:
        while self.leader[i] != i:
            self.leader[i] = self.leader[self.leader[i]]
            i = self.leader[i]
        return i

    def add(self, t: int) -> None:
        joined = -1
        while self.chains and self.chains[0][0] <= t:
            _, root = self.chains.popleft()
            if joined >= 0:
                self.leader[self._root(root)] = joined
            else:
                joined = self._root(root)
        if not self.closed:
            # Any entry up to this event starts its chain here.
            self.closed = t >= self.early_until
            self.starts.append(t)
            self.leader.append(len(self.leader))
            if joined >= 0:
                self.leader[-1] = joined
            else:
                joined = len(self.leader) - 1
        if joined >= 0:
            self.chains.append((t + self.gap, joined))

    def rows(self) -> list[tuple[int, int]]:
        """(last start, exit), neighbours with the same exit as one row."""
        exits = {self._root(root): allowed for allowed, root in self.chains}
        out: list[tuple[int, int]] = []
        for i, t in enumerate(self.starts):
            leaves = exits[self._root(i)]
            if out and out[-1][1] == leaves:
                out[-1] = (t, leaves)
            else:
                out.append((t, leaves))
        return out


def _exit_maps(keys: Sequence[str], gap: int, chunk: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number = None, None, 0
        for batch in batches:
            firsts = batch.column("_first").to_pylist()
            times = batch.column("_t").to_pylist()
            numbers = batch.column("_chunk").to_pylist()
            key_lists = [batch.column(k).to_pylist() for k in keys]
            out: list[tuple] = []
            for i, t in enumerate(times):
                if firsts[i]:
                    if held is not None:
                        out += [(*key, number, s, e) for s, e in held.rows()]
                    key = tuple(column[i] for column in key_lists)
                    number = numbers[i]
                    held = _ChunkMap(number * chunk, gap)
                held.add(t)
            if out:
                yield _batch(out, schema)
        if held is not None:
            yield _batch([(*key, number, s, e) for s, e in held.rows()], schema)

    return run


def _entries(keys: Sequence[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, number, settled = None, None, True
        for batch in batches:
            firsts = batch.column("_first").to_pylist()
            numbers = batch.column("_chunk").to_pylist()
            starts = batch.column("_start").to_pylist()
            exits = batch.column("_exit").to_pylist()
            key_lists = [batch.column(k).to_pylist() for k in keys]
            out: list[tuple] = []
            for i in range(batch.num_rows):
                if firsts[i]:
                    allowed, number = None, None
                if numbers[i] != number:
                    number, settled = numbers[i], False
                    out.append((*(column[i] for column in key_lists), number, allowed))
                if not settled and (allowed is None or starts[i] >= allowed):
                    allowed, settled = exits[i], True
            if out:
                yield _batch(out, schema)

    return run


def _kept(gap: int, columns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None
        for batch in batches:
            firsts = batch.column("_first").to_pylist()
            times = batch.column("_t").to_pylist()
            entries = batch.column("_entry").to_pylist()
            mask = []
            for i, t in enumerate(times):
                if firsts[i]:
                    allowed = entries[i]
                keep = allowed is None or t >= allowed
                if keep:
                    allowed = t + gap
                mask.append(keep)
            yield batch.filter(pa.array(mask, pa.bool_())).select(list(columns))

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(values), field.type) for values, field in zip(columns, schema)], schema=schema
    )


def throttle(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie_break: str,
    gap_ms: int = CLICK_MS,
    chunk_ms: int | None = None,
) -> DataFrame:
    """The rows kept, all columns. Of events of a key at one moment the smallest tie-break can be kept.

    A null tie-break comes last; of rows alike in it any one is taken. Null keys are a
    key; events without a moment are left out. Time lines are cut every `chunk_ms`.
    """
    gap = gap_ms * 1000
    chunk = max(chunk_ms * 1000 if chunk_ms else CHUNK_GAPS * gap, gap)
    timed = df.where(cell(ts).isNotNull())
    return _chunked_keys(timed, list(keys), ts, tie_break, gap, chunk)


def _moment(ts: str):
    return F.unix_micros(cell(ts).cast("timestamp")).alias("_t")


def _chunked_keys(timed: DataFrame, keys: list[str], ts: str, tie_break: str, gap: int, chunk: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = timed.columns
    number = F.expr(f"(_t - pmod(_t, {chunk}L)) div {chunk}L").alias("_chunk")
    # Copies at one moment are reduced before the shuffle. The first pass needs
    # the moments alone, the last one also the rows.
    moments = timed.select(*map(cell, keys), _moment(ts)).distinct().select("*", number)
    record = F.struct(*[cell(c) for c in columns])
    single = (
        timed.groupBy(*map(cell, keys), _moment(ts))
        .agg(F.min_by(record, F.struct(cell(tie_break).isNull(), cell(tie_break))).alias("_r"))
        .select("_r.*", "_t", number)
    )
    by_chunk = W.partitionBy(*map(cell, keys), F.col("_chunk")).orderBy("_t")
    by_key = W.partitionBy(*map(cell, keys)).orderBy("_chunk", "_start")

    key_fields = [timed.schema[k] for k in keys]
    long = T.LongType()
    map_type = T.StructType([*key_fields, *[T.StructField(n, long) for n in ("_chunk", "_start", "_exit")]])
    entry_type = T.StructType([*key_fields, T.StructField("_chunk", long), T.StructField("_entry", long)])

    maps = moments.withColumn("_first", F.row_number().over(by_chunk) == 1).mapInArrow(
        _exit_maps(keys, gap, chunk, to_arrow_schema(map_type)), map_type
    )
    entries = maps.withColumn("_first", F.row_number().over(by_key) == 1).mapInArrow(
        _entries(keys, to_arrow_schema(entry_type)), entry_type
    )
    renamed = entries.toDF(*[f"_k{i}" for i in range(len(keys))], "_c", "_entry")
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & cell(k).eqNullSafe(F.col(f"_k{i}"))
    marked = single.join(renamed, same).withColumn("_first", F.row_number().over(by_chunk) == 1)
    return marked.select(*map(cell, columns), "_t", "_entry", "_first").mapInArrow(_kept(gap, columns), timed.schema)
