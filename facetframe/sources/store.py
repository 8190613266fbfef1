"""Keyed records and message logs kept as plain tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from facetframe.operators.frames import cell, order_columns, stacked

RECENT_MOST = 200


def latest_per_key(df: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest record of each key.

    A running maximum per key combines before the shuffle, so a key with many
    versions never gathers in one task, as it would under a ranking window.
    """
    keys = [cell(k) for k in key]
    record = F.struct(*[cell(c) for c in df.columns])
    best = F.max_by(record, F.struct(*order_columns(newest)))
    return df.groupBy(*keys).agg(best.alias("_r")).select("_r.*")


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Current records with the changes merged in, newest per key."""
    return latest_per_key(current.unionByName(changes), key, newest)


def current_record(df: DataFrame, newest: Sequence[str]) -> DataFrame:
    """The one record that is newest by the given columns, in turn."""
    return df.orderBy(*[c.desc() for c in order_columns(newest)]).limit(1)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def recent(df: DataFrame, order_by, limit: int = 20) -> DataFrame:
    """Newest entries first; the limit is held to 1..200."""
    newest_first = [c.desc() for c in order_columns(order_by)]
    return df.orderBy(*newest_first).limit(max(1, min(limit, RECENT_MOST)))


def history(df: DataFrame, key: str, value, order_by) -> DataFrame:
    """All entries of one key, oldest first."""
    return df.where(cell(key) == F.lit(value)).orderBy(*order_columns(order_by))


def status(tables: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(table, row_count, last_update): the update column may be None."""
    return stacked(
        [
            df.agg(
                F.count("*").alias("row_count"),
                (F.max(updated).cast("string") if updated is not None else F.lit(None).cast("string")).alias(
                    "last_update"
                ),
            ).select(F.lit(name).alias("table"), "row_count", "last_update")
            for name, (df, updated) in tables.items()
        ]
    )
