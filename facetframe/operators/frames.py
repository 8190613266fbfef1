"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# One aggregate of more buffers than this outgrows what the JVM compiles. Wider
# ones are cut by column: each part reads its own columns only (a columnar file
# is read once in all, another source once per part), side by side.
AGG_BUFFERS = 48


def cell(name: str) -> Column:
    """Column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def order_columns(order_by) -> list[Column]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return [cell(i) if isinstance(i, str) else i for i in items]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def kind_of(data_type: T.DataType) -> str:
    """`boolean`, `numeric`, `datetime` or `text`, by physical type alone."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def long_cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) rows, each cell as text."""
    columns = list(columns or [c for c in df.columns if c not in keep])
    texts = df.select(*[cell(k) for k in keep], *[cell(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([cell(k) for k in keep], [cell(c) for c in columns], "column", "value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n): one pass over all columns, combined before the shuffle."""
    return long_cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


def rows_of(one_row: DataFrame, labels: Iterable[str], fields: Mapping[str, object], label: str = "column") -> DataFrame:
    """Turn a one-row wide frame into one row per label.

    `fields` maps an output name to a function from the label to a Column.
    """
    structs = [
        F.struct(F.lit(name).alias(label), *[make(name).alias(out) for out, make in fields.items()])
        for name in labels
    ]
    return one_row.select(F.inline(F.array(*structs)))


def in_chunks(items: Sequence, size: int = AGG_BUFFERS) -> list[Sequence]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def with_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row) to every row."""
    return df.crossJoin(F.broadcast(one_row))
