"""Event envelopes, sessions, and delivery; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from facetframe.operators.frames import cell
from facetframe.operators.ordering import numbered

DELIVERY_ROWS = 20
DELIVERY_MS = 1500

ENVELOPE = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("label", T.StringType()),
                    T.StructField("page", T.StringType()),
                    T.StructField("duration", T.LongType()),
                    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
                ]
            ),
        ),
    ]
)


def envelope(
    df: DataFrame,
    event_type: str,
    ts: str,
    label: Column,
    page: Column,
    extra: str | None = None,
    duration: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(keep..., event_type, timestamp, metadata); `extra` is a JSON text column."""
    extras = F.from_json(cell(extra), "map<string,string>") if extra else F.create_map().cast("map<string,string>")
    return df.select(
        *[cell(k) for k in keep],
        cell(event_type).alias("event_type"),
        cell(ts).cast("timestamp").alias("timestamp"),
        F.struct(
            label.cast("string").alias("label"),
            page.cast("string").alias("page"),
            (duration if duration is not None else F.lit(None)).cast("long").alias("duration"),
            extras.alias("extra"),
        ).alias("metadata"),
    )


# ---------------------------------------------------------------- sessions


def session_seconds(first: Column, last: Column) -> Column:
    """Length in whole seconds, at least 1, from micros."""
    return F.greatest(F.lit(1), F.round((last - first) / 1_000_000.0).cast("long"))


def sessions(df: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """(user, session_no, first_at, last_at, events, duration).

    A pause longer than the gap ends a session. Time is cut into cells as wide as
    the gap: events of one cell belong to one session, so a cell is a partial
    aggregate, combined before the shuffle. The window per user then sees at most
    one row per gap, however many events the user has.
    """
    gap = gap_seconds * 1_000_000
    width = max(gap, 1)
    parts = (
        df.where(cell(ts).isNotNull())
        .select(cell(user).alias(user), F.unix_micros(cell(ts).cast("timestamp")).alias("_t"))
        .groupBy(user, (F.col("_t") - F.pmod(F.col("_t"), F.lit(width))).alias("_cell"))
        .agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"))
    )
    whole = W.partitionBy(user).orderBy("_from")
    return (
        parts.withColumn("_new", (F.col("_from") - F.lag("_to").over(whole) > gap).cast("int"))
        .withColumn("session_no", F.coalesce(F.sum("_new").over(whole), F.lit(0)) + 1)
        .groupBy(user, "session_no")
        .agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("events"))
        .select(
            user,
            "session_no",
            F.timestamp_micros("_from").alias("first_at"),
            F.timestamp_micros("_to").alias("last_at"),
            "events",
            session_seconds(F.col("_from"), F.col("_to")).alias("duration"),
        )
    )


def session_stream(stream: DataFrame, user: str, ts: str, gap: str, lateness: str) -> DataFrame:
    """Streaming sessions: one row per session once the watermark has passed it."""
    timed = stream.withColumn("_ts", cell(ts).cast("timestamp")).withWatermark("_ts", lateness)
    grouped = timed.groupBy(cell(user).alias(user), F.session_window("_ts", gap).alias("_w")).agg(
        F.min("_ts").alias("first_at"), F.max("_ts").alias("last_at"), F.count("*").alias("events")
    )
    return grouped.select(
        user,
        "first_at",
        "last_at",
        "events",
        session_seconds(F.unix_micros("first_at"), F.unix_micros("last_at")).alias("duration"),
    )


# ---------------------------------------------------------------- throttle, streaming


class _Throttle(StatefulProcessor):
    """Holds each key's events until the watermark passes them, then keeps in time order."""

    def __init__(self, gap_ms: int, keys: Sequence[str], ts: str, tie_break: str, columns: Sequence[str]):
        self.gap = gap_ms * 1000
        self.keys, self.ts, self.tie = list(keys), ts, tie_break
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))
        self.held = handle.getListState(
            "held", T.StructType([T.StructField("t", T.LongType()), T.StructField("tie", T.LongType())])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added, earliest = [], None
        for frame in rows:
            micros = frame[self.ts].astype("datetime64[us]").astype("int64")
            added += list(zip(micros.tolist(), frame[self.tie].astype("int64").tolist()))
        if added:
            self.held.appendList(added)
            earliest = min(t for t, _ in added)
            # Fires once the watermark is past the earliest event of this batch.
            self.handle.registerTimer(earliest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((t, tie) for t, tie in self.held.get())
        ready = [e for e in held if e[0] <= upto]
        waiting = held[len(ready) :]
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t, tie in ready:
            if last is None or t - last >= self.gap:
                kept.append((t, tie))
                last = t
        if kept:
            self.last.update((last,))
        self.held.clear()
        if waiting:
            self.held.put(waiting)
            self.handle.registerTimer(waiting[0][0] // 1000 + 1)
        if kept:
            frame = pd.DataFrame(kept, columns=["_t", self.tie])
            for name, value in zip(self.keys, key):
                frame[name] = value
            frame[self.ts] = pd.to_datetime(frame["_t"], unit="us")
            yield frame[[*self.keys, self.ts, self.tie]]

    def close(self) -> None:
        pass


def throttle_stream(
    stream: DataFrame, keys: Sequence[str], ts: str, tie_break: str, gap_ms: int, lateness: str
) -> DataFrame:
    """Streaming throttle: (keys..., ts, tie_break) of the kept events.

    Events older than the watermark are dropped by Spark and counted in the
    progress of the query. The state store must be RocksDB.
    """
    keys = list(keys)
    rows = (
        stream.select(*map(cell, keys), cell(ts).cast("timestamp").alias(ts), cell(tie_break).cast("long").alias(tie_break))
        .withWatermark(ts, lateness)
    )
    schema = T.StructType([rows.schema[c] for c in [*keys, ts, tie_break]])
    processor = _Throttle(gap_ms, keys, ts, tie_break, rows.columns)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


# ---------------------------------------------------------------- delivery


def delivery_batches(df: DataFrame, order_by, size: int = DELIVERY_ROWS) -> DataFrame:
    """Add `delivery`: which batch of at most `size` rows each event leaves in."""
    return numbered(df, order_by, "_n").withColumn("delivery", F.floor((F.col("_n") - 1) / size)).drop("_n")


def deliver(
    stream: DataFrame,
    send: Callable[[list[Row]], None],
    checkpoint: str,
    size: int = DELIVERY_ROWS,
    every_ms: int = DELIVERY_MS,
):
    """Hand events to `send` on the executors, at most `size` at a time.

    A failing `send` fails the micro-batch, which the checkpoint repeats: an
    event may be sent twice but is not lost.
    """

    def send_rows(rows: Iterator[Row]) -> None:
        batch: list[Row] = []
        for row in rows:
            batch.append(row)
            if len(batch) == size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    return (
        stream.writeStream.foreachBatch(lambda df, _: df.foreachPartition(send_rows))
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{every_ms} milliseconds")
        .start()
    )
