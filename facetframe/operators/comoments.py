"""Counts, means and co-moments of all pairs of columns in one pass over the data.

Every task folds its rows into matrices (columns by columns) and gives one row per
pair, so the shuffle holds pairs times tasks, not values. Moments are taken around
means and merged by the differences of means, never as raw sums of squares.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from facetframe.functions.numbers import without_nan
from facetframe.operators.frames import cell

SCHEMA = "i int, j int, n long, mean_i double, mean_j double, s_ii double, s_jj double, s_ij double"


def _of_batch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean of the row's column, its squares, products) over the rows that hold both columns."""
    present = ~np.isnan(values)
    has = present.astype(np.float64)
    # The first value goes first, so that a column that never varies is exactly 0.
    first = np.where(present.any(0), values[present.argmax(0), np.arange(values.shape[1])], 0.0)
    centred = np.where(present, values - first, 0.0)
    middle = centred.sum(0) / np.maximum(has.sum(0), 1.0)
    centred = np.where(present, centred - middle, 0.0)
    n = has.T @ has
    sums = centred.T @ has
    some = np.maximum(n, 1.0)
    squares = (centred * centred).T @ has - sums * sums / some
    products = centred.T @ centred - sums * sums.T / some
    return n, (first + middle)[:, None] + sums / some, squares, products


def _merged(a, b):
    n = a[0] + b[0]
    some = np.maximum(n, 1.0)
    # A side without rows gives a mean, but no weight.
    step = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    weight = a[0] * b[0] / some
    mean = np.where(a[0] > 0, a[1], b[1]) + step * b[0] / some
    return n, mean, a[2] + b[2] + step * step * weight, a[3] + b[3] + step * step.T * weight


def _folded(pairs: Sequence[tuple[int, int]]):
    i, j = (np.array(side, dtype=np.int32) for side in zip(*pairs))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
            with np.errstate(invalid="ignore", over="ignore"):
                part = _of_batch(np.stack(columns, axis=1))
                total = part if total is None else _merged(total, part)
        if total is None:
            return
        n, mean, squares, products = total
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a)
                for a in (i, j, n[i, j].astype(np.int64), mean[i, j], mean[j, i], squares[i, j], squares[j, i], products[i, j])
            ],
            names=["i", "j", "n", "mean_i", "mean_j", "s_ii", "s_jj", "s_ij"],
        )

    return fold


def co_moments(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(i, j, n, s_ii, s_jj, s_ij) per pair of column positions, over the rows that hold both.

    Nulls and NaN are missing. Pairs that no row holds have n = 0 or no row.
    """
    numbers = df.select(*[without_nan(cell(c)).cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    parts = numbers.mapInArrow(_folded(pairs), SCHEMA).where("n > 0")
    pair = W.partitionBy("i", "j")

    # From the least mean, not from 0: a constant column keeps an offset of exactly 0.
    apart = parts.select(
        "*",
        (F.col("mean_i") - F.min("mean_i").over(pair)).alias("d_i"),
        (F.col("mean_j") - F.min("mean_j").over(pair)).alias("d_j"),
    )
    rows = F.sum("n").over(pair)
    centred = apart.select(
        "*",
        (F.col("d_i") - F.sum(F.col("n") * F.col("d_i")).over(pair) / rows).alias("c_i"),
        (F.col("d_j") - F.sum(F.col("n") * F.col("d_j")).over(pair) / rows).alias("c_j"),
    )
    return centred.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("s_ii") + F.col("n") * F.col("c_i") * F.col("c_i")).alias("s_ii"),
        F.sum(F.col("s_jj") + F.col("n") * F.col("c_j") * F.col("c_j")).alias("s_jj"),
        F.sum(F.col("s_ij") + F.col("n") * F.col("c_i") * F.col("c_j")).alias("s_ij"),
    )
