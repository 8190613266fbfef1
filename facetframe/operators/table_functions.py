"""Functions over partitioned tables: a fold sees each group's rows in order and gives rows.

A fold is a class made without arguments. ``add(batch)`` takes the next Arrow rows of
its group, in order; ``result()`` gives an Arrow table at the group's end. It should
hold a state of fixed size, not the rows, since a group may be large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import arrow_udtf


class Fold(Protocol):
    def add(self, batch: pa.RecordBatch) -> None: ...

    def result(self) -> pa.Table: ...


def table_function(fold: Callable[[], Fold], returns: str):
    """The fold as a Spark table function of one table argument; ``returns`` is its schema."""

    class Function:
        def __init__(self) -> None:
            self.fold = fold()
            self.met = False

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            if batch.num_rows:
                self.met = True
                self.fold.add(batch)
            return iter(())

        def terminate(self) -> Iterator[pa.Table]:
            # A task without rows has no group and gives nothing.
            if self.met:
                yield self.fold.result()

    return arrow_udtf(Function, returnType=returns)


def register(spark: SparkSession, name: str, fold: Callable[[], Fold], returns: str) -> None:
    """Make a user's own fold callable in SQL: ``FROM name(TABLE(t) PARTITION BY k ORDER BY o)``."""
    spark.udtf.register(name, table_function(fold, returns))


def folded(df: DataFrame, fold: Callable[[], Fold], returns: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that the fold gives for every group; null keys are groups, an empty table gives none."""
    return table_function(fold, returns)(df.asTable().partitionBy(*by).orderBy(*order))
