"""Line dedup: lines that many documents share stay in one of them.

Every long enough line becomes a row of a 128-bit hash of its key, its document and
its position. The rows are range-partitioned by (hash, document descending, text,
position) and sorted inside each partition, so a task streams over one hash after
the other and meets the line's last document first. A hash whose rows span several
partitions (a very common line) is cut by document, and no task holds it: each task
says which of its rows it could not judge, and the few distinct documents it saw of
its first and its last hash; these summaries, at most two hashes a partition, settle
the rest. The result is one keep bitmap per document that loses lines, compressed;
texts do not travel with the lines.

Cases: a null or empty text is one empty line; a null document key counts as the
least one; rows with equal keys count as one document, and rows equal in key and text
share one bitmap; ties do not arise, as the largest key keeps all places of its line.
An empty table gives an empty one. Only the key and the text are read, and other
columns pass through `deduplicated` inside one struct, so their names cannot clash. A
text of any length is read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from facetframe.llm.base import kept

LEAST_POINTS = 20
LEAST_DOCUMENTS = 3
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_KEY = -(1 << 63)

DROPPED, OPEN, EDGE = 0, 1, 2
_MARKS = "kind int, high long, low long, doc long, text_key long, line int, n_lines int"
_BITMAPS = "doc long, text_key long, n_lines int, n_dropped int, keep binary"


def line_key(line: Column) -> Column:
    """What two lines must share to be the same line."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _document(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(_NO_KEY))


def line_rows(docs: DataFrame, key: str, text: str, least_points: int) -> DataFrame:
    lines = docs.select(
        _document(key).alias("doc"), F.xxhash64(_text(text)).alias("text_key"), F.split(_text(text), "\n", -1).alias("_lines")
    )
    each = lines.select("doc", "text_key", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("line", "_line"))
    keyed = each.withColumn("_line", line_key(F.col("_line"))).where(F.char_length("_line") >= least_points)
    return keyed.select(
        F.xxhash64("_line").alias("high"), F.xxhash64(F.lit(1), "_line").alias("low"), "doc", "text_key", "line", "n_lines"
    )


class _Stream:
    """Judges sorted rows of one partition, batch after batch.

    Of the hash that a batch ends with, only what later rows may change is held:
    its rows while fewer documents than needed were seen, else the first document.
    """

    def __init__(self, least_documents: int):
        self.least = least_documents
        self.held: np.ndarray | None = None
        self.settled: tuple | None = None
        self.leading = True
        self.edges: list[tuple[int, int, int]] = []

    @staticmethod
    def _starts(rows: np.ndarray) -> np.ndarray:
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        return np.concatenate(([0], np.flatnonzero(~same) + 1))

    def _see(self, rows: np.ndarray, seen: list[int]) -> list[int]:
        """The first distinct documents of one hash, as many as are needed."""
        for doc in rows[np.concatenate(([True], rows[1:, 2] != rows[:-1, 2])), 2][: self.least + 1].tolist():
            if len(seen) < self.least and doc not in seen[-1:]:
                seen.append(doc)
        return seen

    def feed(self, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(kind, rows) that are certain now."""
        out = []
        if self.settled is not None:
            high, low, first, seen, leading = self.settled
            more = int(np.searchsorted(~((rows[:, 0] == high) & (rows[:, 1] == low)), True))
            mine, rows = rows[:more], rows[more:]
            if len(mine):
                self._see(mine, seen)
                out.append((OPEN, mine) if leading else (DROPPED, mine[mine[:, 2] != first]))
            if not len(rows):
                return out
            if leading:
                self._edge(high, low, seen)
            self.settled = None
        if self.held is not None:
            rows = np.concatenate((self.held, rows))
            self.held = None
        starts = self._starts(rows)
        whole, tail = rows[: starts[-1]], rows[starts[-1] :]
        if len(whole):
            out += self._judge(whole, starts[:-1])
        self._hold(tail, out)
        return out

    def _judge(self, rows: np.ndarray, starts: np.ndarray) -> list[tuple[int, np.ndarray]]:
        out = []
        if self.leading:
            end = int(starts[1]) if len(starts) > 1 else len(rows)
            out.append((OPEN, rows[:end]))
            self._edge(int(rows[0, 0]), int(rows[0, 1]), self._see(rows[:end], []))
            self.leading = False
            rows, starts = rows[end:], starts[1:] - end
            if not len(rows):
                return out
        new_doc = np.concatenate(([True], rows[1:, 2] != rows[:-1, 2]))
        new_doc[starts] = True
        sizes = np.diff(np.append(starts, len(rows)))
        documents = np.add.reduceat(new_doc.astype(np.int64), starts)
        lost = np.repeat(documents >= self.least, sizes) & (rows[:, 2] != np.repeat(rows[starts, 2], sizes))
        out.append((DROPPED, rows[lost]))
        return out

    def _hold(self, tail: np.ndarray, out: list) -> None:
        seen = self._see(tail, [])
        first = int(tail[0, 2])
        if self.leading or len(seen) >= self.least:
            out.append((OPEN, tail) if self.leading else (DROPPED, tail[tail[:, 2] != first]))
            self.settled = (int(tail[0, 0]), int(tail[0, 1]), first, seen, self.leading)
            self.leading = False
        else:
            self.held = tail

    def _edge(self, high: int, low: int, seen: list[int]) -> None:
        self.edges += [(high, low, doc) for doc in seen]

    def end(self) -> list[tuple[int, np.ndarray]]:
        """What the last hash leaves open, and the summaries of both edges."""
        out = []
        if self.settled is not None:
            high, low, _, seen, _ = self.settled
            self._edge(high, low, seen)
        if self.held is not None:
            out.append((OPEN, self.held))
            self._edge(int(self.held[0, 0]), int(self.held[0, 1]), self._see(self.held, []))
        if self.edges:
            summary = np.zeros((len(self.edges), 6), dtype=np.int64)
            summary[:, :3] = self.edges
            out.append((EDGE, summary))
        return out


def _marked(least_documents: int):
    schema = pa.schema([("kind", pa.int32()), *[(c, pa.int64()) for c in ("high", "low", "doc", "text_key")], ("line", pa.int32()), ("n_lines", pa.int32())])

    def batch_of(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        columns = [np.full(len(rows), kind), *rows.T]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(least_documents)
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
                yield from (batch_of(kind, found) for kind, found in stream.feed(rows) if len(found))
        yield from (batch_of(kind, found) for kind, found in stream.end() if len(found))

    return run


def _packed(n_lines: int, lost: np.ndarray) -> bytes:
    keep = np.ones(n_lines, dtype=bool)
    keep[lost] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(n_lines: int, keep: bytes) -> np.ndarray:
    """Which of the lines stay, from a compressed bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document and line become one bitmap per document."""

    def made(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1))))
        parts = np.split(rows, starts[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(p[0, 0]) for p in parts], pa.int64()),
                pa.array([int(p[0, 1]) for p in parts], pa.int64()),
                pa.array([int(p[0, 3]) for p in parts], pa.int32()),
                pa.array([len(p) for p in parts], pa.int32()),
                pa.array([_packed(int(p[0, 3]), p[:, 2]) for p in parts], pa.binary()),
            ],
            names=["doc", "text_key", "n_lines", "n_dropped", "keep"],
        )

    held = np.empty((0, 4), dtype=np.int64)
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        rows = np.concatenate((held, rows))
        if not len(rows):
            continue
        last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield made(rows[:cut])
        held = rows[cut:]
    if len(held):
        yield made(held)


def keep_bitmaps(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_points: int = LEAST_POINTS,
    least_documents: int = LEAST_DOCUMENTS,
) -> DataFrame:
    """(doc, text_key, n_lines, n_dropped, keep) of every document that loses lines.

    `text_key` is the 64-bit hash of the text, `keep` a zlib-compressed bitmap over
    the lines (most significant bit first; 1 stays). Documents without a row keep all.
    """
    if least_documents < 2:
        raise ValueError("a line of one document has no other place to stay in")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["high", "low", F.desc("doc"), "text_key", "line"]
    # Equal rows of repeated documents may lie in several ranges, by where they were read.
    rows = line_rows(docs, key, text, least_points).withColumn("_read", F.spark_partition_id())
    streamed = rows.repartitionByRange(parts, *order, "_read").sortWithinPartitions(*order).drop("_read")
    marks = kept(streamed.mapInArrow(_marked(least_documents), _MARKS), "line-marks")
    edges = (
        marks.where(F.col("kind") == EDGE)
        .select("high", "low", "doc")
        .distinct()
        .groupBy("high", "low")
        .agg(F.max("doc").alias("top"), F.count("*").alias("n"))
        .where(F.col("n") >= least_documents)
    )
    # At most two hashes of each range: a broadcast bounded by the number of partitions.
    settled = marks.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["high", "low"]).where("doc <> top")
    lost = (
        marks.where(F.col("kind") == DROPPED)
        .select("doc", "text_key", "line", "n_lines")
        .unionByName(settled.select("doc", "text_key", "line", "n_lines"))
        .groupBy("doc", "text_key", "line")
        .agg(F.first("n_lines").alias("n_lines"))
    )
    ordered = lost.repartition("doc", "text_key").sortWithinPartitions("doc", "text_key", "line")
    return ordered.mapInArrow(_bitmaps, _BITMAPS)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, text, keep): each document as a struct, its text, its bitmap or null."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        _text(text).alias("text"),
        _document(key).alias("_doc"),
        F.xxhash64(_text(text)).alias("_key"),
    )
    found = bitmaps.select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), "keep")
    return rows.join(found, ["_doc", "_key"], "left").select("row", "text", "keep")


def remaining(text: str, keep: bytes | None) -> tuple[int, int, str]:
    """(lines, lines dropped, text that stays)."""
    if keep is None:
        return text.count("\n") + 1, 0, text
    lines = text.split("\n")
    stays = kept_lines(len(lines), keep)
    return len(lines), int(len(lines) - stays.sum()), "\n".join(lines[i] for i in np.flatnonzero(stays))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines they lose; a null text stays null."""
    joined = with_bitmaps(docs, keep_bitmaps(docs, key, text), key, text)
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            left = pa.array([remaining(t, k)[2] for t, k in zip(texts, keeps)], batch.schema.field(1).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), left], names=["row", "text"])

    stays = joined.mapInArrow(run, schema)
    columns = [
        F.when(F.col("row")[c].isNotNull(), F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns
    ]
    return stays.select(*columns)
