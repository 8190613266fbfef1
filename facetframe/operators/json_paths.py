"""Schema and paths of JSON cells: what lies where, and typed columns with counted failures."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from facetframe.operators.frames import cell

#: Cells that nest deeper are broken; variant columns have about this bound too.
MOST_LEVELS = 1000

_KINDS = ("nulls", "booleans", "integers", "doubles", "strings", "objects", "arrays")
_COUNTS = ("cells", "broken", *_KINDS)
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_PLAIN_KEY = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _refused(word: str) -> None:
    raise ValueError(f"{word} is not JSON")


def _object(pairs: list[tuple[str, object]]) -> dict[str, object]:
    held = dict(pairs)
    if len(held) < len(pairs):
        raise ValueError("a key is repeated")
    return held


def _kind(value: object) -> str:
    if value is None:
        return "nulls"
    if isinstance(value, bool):
        return "booleans"
    if isinstance(value, int):
        return "integers" if -(2**63) <= value < 2**63 else "doubles"
    if isinstance(value, float):
        return "doubles"
    if isinstance(value, str):
        return "strings"
    return "objects" if isinstance(value, dict) else "arrays"


def _below(path: str, key: str) -> str:
    """Path of a member, in the notation that variant columns are read by."""
    if key and _PLAIN_KEY.issuperset(key):
        return f"{path}.{key}"
    return f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def _values(text: str) -> list[tuple[str, str]] | None:
    """(path, kind) of every value of a cell; None if it cannot be read."""
    try:
        root = json.loads(text, parse_constant=_refused, object_pairs_hook=_object)
    except (ValueError, RecursionError):
        return None
    held: list[tuple[str, str]] = []
    waiting: list[tuple[str, object, int]] = [("$", root, 1)]
    while waiting:
        path, value, depth = waiting.pop()
        if depth > MOST_LEVELS:
            return None
        held.append((path, _kind(value)))
        if isinstance(value, dict):
            waiting += [(_below(path, key), inner, depth + 1) for key, inner in value.items()]
        elif isinstance(value, list):
            waiting += [(f"{path}[*]", inner, depth + 1) for inner in value]
    return held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells to one row of counts per path of a batch."""
    place = {name: i for i, name in enumerate(_COUNTS)}
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            held = _values(text)
            if held is None:
                own = counts.setdefault("$", [0] * len(_COUNTS))
                own[place["broken"]] += 1
                own[place["cells"]] += 1
                continue
            met = set()
            for path, kind in held:
                own = counts.setdefault(path, [0] * len(_COUNTS))
                own[place[kind]] += 1
                if path not in met:
                    met.add(path)
                    own[place["cells"]] += 1
        paths = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string())] + [pa.array([counts[p][i] for p in paths], pa.int64()) for i in range(len(_COUNTS))],
            names=["path", *_COUNTS],
        )


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, type, cells, broken, and how many values are of each kind), a row per path.

    Elements of an array share the path ``[*]``. ``cells`` counts cells that hold the
    path, once each; at ``$`` it counts all cells that are not null, and ``broken`` those
    of them that are no JSON, repeat a key, or nest beyond ``MOST_LEVELS``. ``type``
    merges the kinds other than null: one kind is itself, integers and doubles are
    double, other mixtures variant, none at all void. Integers beyond 64 bits count as
    doubles. Counts are made per batch and summed, so the merge needs no order; paths
    are rows, never fetched, however many keys the data have.
    """
    kinds = ", ".join(f"{c} long" for c in _COUNTS)
    found = df.select(cell(column).cast("string").alias("_cell")).mapInArrow(_counted, f"path string, {kinds}")
    summed = found.groupBy("path").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    single = {"booleans": "boolean", "integers": "bigint", "doubles": "double", "strings": "string", "objects": "object", "arrays": "array"}
    present = reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("int") for c in single])
    numbers = (F.col("integers") > 0) & (F.col("doubles") > 0)
    merged = F.when(present == 0, "void").when((present == 2) & numbers, "double").when(present > 1, "variant")
    for kind, name in single.items():
        merged = merged.when(F.col(kind) > 0, name)
    return summed.select("path", merged.alias("type"), *_COUNTS)


def _parsed(column: str) -> Column:
    return F.try_parse_json(cell(column).cast("string"))


def _read(parsed: Column, path: str, kind: str) -> tuple[Column, Column]:
    """(value, present) of a path; a number with a fraction is no integer."""
    value = F.try_variant_get(parsed, path, kind)
    if kind in _INTEGRAL:
        value = F.when(value.cast("double") == F.try_variant_get(parsed, path, "double"), value)
    return value, F.try_variant_get(parsed, path, "variant")


def read_paths(df: DataFrame, column: str, paths: Mapping[str, tuple[str, str]], failures: str = "failures") -> DataFrame:
    """The rows with a typed column per path (name -> (path, type)) and the names that failed.

    A path that is absent or null gives null and is no failure; a value that the type
    cannot take gives null and its name is in ``failures``. A cell that is no JSON gives
    nulls and ``['*']``; a null cell nulls and no failure. Added columns replace those
    of their names. Cells are parsed once, inside generated code; no Python runs.
    """
    added = [*paths, failures]
    held = df.withColumn("_parsed_cell", _parsed(column))
    parsed, broken = F.col("_parsed_cell"), cell(column).isNotNull() & F.col("_parsed_cell").isNull()
    values, failed = [], []
    for name, (path, kind) in paths.items():
        value, present = _read(parsed, path, kind)
        values.append(value.alias(name))
        bad = present.isNotNull() & ~F.is_variant_null(present) & value.isNull()
        failed.append(F.when(bad, F.lit(name)))
    names = F.when(broken, F.array(F.lit("*"))).otherwise(F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>"))
    return held.select(*[cell(c) for c in df.columns if c not in added], *values, names.alias(failures))


def path_failures(df: DataFrame, column: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(name, cells, broken, missing, nulls, typed, failed), a row per path, by one scan.

    The five counts after ``cells`` add up to it. An empty table gives zeros.
    """
    held = df.select(cell(column).alias("_cell"), _parsed(column).alias("_parsed_cell")).where("_cell IS NOT NULL")
    parsed = F.col("_parsed_cell")
    totals = [F.count("*").alias("_cells"), F.count_if(parsed.isNull()).alias("_broken")]
    for i, (path, kind) in enumerate(paths.values()):
        value, present = _read(parsed, path, kind)
        null = present.isNotNull() & F.is_variant_null(present)
        totals += [
            F.count_if(parsed.isNotNull() & present.isNull()).alias(f"_missing{i}"),
            F.count_if(null).alias(f"_null{i}"),
            F.count_if(present.isNotNull() & ~null & value.isNotNull()).alias(f"_typed{i}"),
            F.count_if(present.isNotNull() & ~null & value.isNull()).alias(f"_failed{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.col("_cells").alias("cells"),
            F.col("_broken").alias("broken"),
            *[F.col(f"_{count}{i}").alias(as_) for count, as_ in (("missing", "missing"), ("null", "nulls"), ("typed", "typed"), ("failed", "failed"))],
        )
        for i, name in enumerate(paths)
    ]
    return held.agg(*totals).select(F.inline(F.array(*rows)))
