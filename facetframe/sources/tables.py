"""Reading and writing datasets: CSV, Parquet, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from facetframe.operators.cleaning import missing_to_null
from facetframe.operators.frames import cell, order_columns

PREVIEW_ROWS = 100
EMPTY = "Dataset invalid or empty"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    sampling_ratio: float = 1.0,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header; quoted commas, doubled quotes and quoted newlines are kept.

    Types are inferred by a pass over the data unless a schema is given: give
    one for large inputs. `multi_line=False` lets Spark split large files,
    and is right when no cell holds a newline.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        reader = reader.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    else:
        reader = reader.schema(schema).option("enforceSchema", False)
    return missing_to_null(reader.csv(path))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV as trimmed text cells: blank lines dropped, short rows padded, long rows cut."""
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    if not raw.columns or raw.isEmpty():
        raise ValueError("CSV must include a header row and at least one data row.")
    return raw.select(*[F.coalesce(F.trim(cell(c)), F.lit("")).alias(c) for c in raw.columns])


def validated(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """The frame itself, or an error if it is empty or lacks a required column."""
    if any(c not in df.columns for c in required) or df.isEmpty():
        raise ValueError(EMPTY)
    return df


def preview(df: DataFrame, order_by, rows: int = PREVIEW_ROWS) -> DataFrame:
    """First rows by the order key, every value as text."""
    head = df.orderBy(*order_columns(order_by)).limit(rows)
    return head.select(*[cell(c).cast("string").alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
