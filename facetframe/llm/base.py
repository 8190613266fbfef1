"""Shared steps of the operators: reading tables, writing intermediates, sizing work."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from facetframe.session import scratch_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write rows to the folder shared by all executors and read them back.

    What follows reads files, so a lost executor costs only its own tasks again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def for_files(documents: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows under names c0, c1 ... and types that files can hold, and what gives such rows their own ones again."""
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    # Files hold no column without a type; it is all null.
    empty = {c for c, kind in plain.dtypes if kind == "void"}
    rows = plain.select(*[F.col(c).cast("string").alias(c) if c in empty else F.col(c) for c in plain.columns])
    return rows, lambda df: df.select(*[(F.lit(None) if c in empty else F.col(c)).alias(n) for c, n in zip(plain.columns, names)])


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: int = 2_000_000) -> Iterator[None]:
    """What runs inside hands Python at most so many rows and about so many bytes at once, for rows that hold whole texts or sets."""
    before = {}
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        before[name] = spark.conf.get(name)
        number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmg]?)\w*\s*", before[name].lower()).groups()
        value = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        spark.conf.set(name, str(min(value, most) if value > 0 else most))
    try:
        yield
    finally:
        for name, text in before.items():
            spark.conf.set(name, text)


def unused(name: str, columns: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name
