"""Balanced shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells. Virtual nodes of each shard sit on cells, and a row's
cell is the top of its key's hash, so all rows of a cell meet the shards in the
same clockwise order. A shard takes rows up to its bound; rows of a cell that
overflow a full shard continue clockwise to the next shard with room. With the
bounds set to the rounded-down and rounded-up mean, row counts of any two shards
differ by at most one, and a changed number of shards moves only rows whose shard
is new or whose overflow changed.

Only counts per cell reach the driver (at most 65,536 rows, whatever the input),
which walks the ring once. Rows are ranked inside cells, never across the table.
A cell that holds far more rows than the mean (one key repeated many times) is
ranked in 64 parts, so no task sorts it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from facetframe.session import checkpointed

CELL_BITS = 16
#: Virtual nodes of each shard.
VIRTUAL_NODES = 256
_PARTS = 64


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, seed: str = "ring") -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    nodes = []
    for shard in range(shards):
        for copy in range(virtual_nodes):
            digest = hashlib.sha256(f"{seed}/{shard}/{copy}".encode()).digest()
            nodes.append((int.from_bytes(digest[:8], "big") >> (64 - CELL_BITS), digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(nodes)]


def place(counts: dict[int, int], shards: int, bounds: Sequence[int], virtual_nodes: int = VIRTUAL_NODES) -> dict:
    """cell -> [(shard, first rank, end rank, first slot)]: where the rows of each cell go.

    Cells come in clockwise order; each fills the shards it meets up to their
    bounds. The bounds must add up to the number of rows or more.
    """
    nodes = ring(shards, virtual_nodes)
    cells = sorted(counts)
    taken = [0] * shards
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    at = 0
    for cell in cells:
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        rank, left, flows = 0, counts[cell], []
        for step in range(len(nodes)):
            if not left:
                break
            shard = nodes[(at + step) % len(nodes)][1]
            moved = min(left, bounds[shard] - taken[shard])
            if moved > 0:
                flows.append((shard, rank, rank + moved, taken[shard]))
                taken[shard] += moved
                rank, left = rank + moved, left - moved
        if left:
            raise ValueError("the bounds of the shards hold fewer rows than there are")
        out[cell] = flows
    return out


def sharded(
    rows: DataFrame,
    keys: Sequence[str],
    shards: int,
    carry: Sequence[str] | None = None,
    virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """The carried columns of every row (default: all), with ``shard`` and ``slot``.

    Shards are 0 to shards - 1; slots of a shard run from 0 without gaps; the row
    counts of two shards differ by at most one. Columns named shard or slot are
    replaced. Null keys are keys like any other; rows that are alike in all keys
    share a cell and are told apart by an arbitrary order; an empty table gives no
    rows. Wide columns need not be carried: join them back by a key.
    """
    spark = rows.sparkSession
    carry = [c for c in (rows.columns if carry is None else carry) if c not in ("shard", "slot")]
    missing = [k for k in keys if k not in carry]
    hashed = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in keys])
    cells = checkpointed(
        rows.select(
            *carry,
            *missing,
            F.shiftrightunsigned(hashed, 64 - CELL_BITS).cast("int").alias("_cell"),
            hashed.alias("_hash"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    counts = {r["_cell"]: r["n"] for r in cells.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    flows = place(counts, shards, bounds, virtual_nodes)
    large = 4096 + 16 * total // (1 << CELL_BITS)
    parts = spark.createDataFrame(
        [(c, _PARTS) for c, n in counts.items() if n > large], "_cell int, _parts int"
    )
    cells = cells.join(F.broadcast(parts), "_cell", "left").withColumn(
        "_part", F.coalesce(F.pmod("_row", "_parts").cast("int"), F.lit(0))
    )
    starts = {(c, 0): 0 for c in counts}
    if any(n > large for n in counts.values()):
        before: dict[int, int] = {}
        sizes = cells.where("_parts is not null").groupBy("_cell", "_part").agg(F.count("*").alias("n"))
        for r in sorted(sizes.collect()):
            starts[(r["_cell"], r["_part"])] = before.get(r["_cell"], 0)
            before[r["_cell"]] = before.get(r["_cell"], 0) + r["n"]
    # At most one row per cell, and 64 for each of at most 4,096 large cells.
    plan = spark.createDataFrame(
        [(c, p, first, flows[c]) for (c, p), first in starts.items()],
        "_cell int, _part int, _first long, _flows array<struct<shard:int,low:long,high:long,slot:long>>",
    )
    order = Window.partitionBy("_cell", "_part").orderBy("_hash", *[F.col(k).cast("string") for k in keys], "_row")
    ranked = cells.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    rank = F.col("_first") + F.col("_rank")
    placed = ranked.join(F.broadcast(plan), ["_cell", "_part"]).withColumn("_at", rank)
    flow = F.filter("_flows", lambda f: (f["low"] <= F.col("_at")) & (F.col("_at") < f["high"]))[0]
    return placed.withColumn("_flow", flow).select(
        *carry,
        F.col("_flow.shard").alias("shard"),
        (F.col("_flow.slot") + F.col("_at") - F.col("_flow.low")).alias("slot"),
    )


def write_shards(rows: DataFrame, placed: DataFrame, key: str, path: str) -> None:
    """Write whole rows as Parquet, a folder per shard; key must tell rows apart."""
    joined = rows.join(placed.select(key, "shard", "slot"), key)
    joined.repartition("shard", F.col("slot") % 64).write.partitionBy("shard").parquet(path)
