"""Merkle manifest: digests of a table per group, with a proof for every row.

The rows of a group are numbered in order, and each aligned block of 512 (three
levels of eight) keeps its digests as one hex string, the lowest level. Fixed-width
substrings of a level are hashed to give the next one; a block so yields four strings
at most, and its top digest is a node of the next tree of blocks, until one block is
left per group. The siblings of a node are the two substrings that flank it inside
its run of eight; a path is the list of these pairs from a leaf to the root. The
groups' roots, in the order of the groups, form one more tree of the same kind.

No task holds more than a block, however large a group is. Positions come from range
partitions whose sizes are added up, so no window runs over a group.

Cases: a null group is a group of its own and the first; a null order key comes
first; rows equal in key are ordered by their digest, so results do not depend on the
reading order; a single row is its group's root; an empty table gives an empty one.
Rows are carried in a struct, so names cannot clash; a digest must not be null. Texts
of any length take part only through their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from facetframe.llm.base import kept
from facetframe.session import checkpointed

#: Nodes of a run, levels of a block, hex digits of a digest.
RUN, LEVELS, WIDTH = 8, 3, 64
BLOCK = RUN**LEVELS
_LOW_BITS = 33
_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, start, lambda node, pair: digest(F.concat(pair["left"], node, pair["right"])))


def proof(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda pair: F.concat(pair["left"], pair["right"])), "")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (g, key, digest, row) with their position in the group and the group's size."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("g"), F.col("key").asc_nulls_first(), F.col("digest")]
    ranged = rows.withColumn("_read", F.spark_partition_id()).repartitionByRange(parts, *order, "_read")
    placed = checkpointed(ranged.sortWithinPartitions(*order).drop("_read").withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", _LOW_BITS))
    spans = placed.groupBy("_part", "g").agg(F.min("_id").alias("_from"), F.count("*").alias("_rows"))
    earlier = W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select(
        "_part",
        "g",
        "_from",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_rows").over(W.partitionBy("g")).alias("size"),
    )
    return placed.join(starts, ["_part", "g"]).select(
        "g", "size", (F.col("_start") + F.col("_id") - F.col("_from")).alias("pos"), "digest", "row"
    )


def _height(size: Column) -> Column:
    """Levels above the leaves: the octal digits of size - 1, none for a single leaf."""
    return F.when(size <= 1, 0).otherwise(F.length(F.conv((size - 1).cast("string"), 10, RUN)))


def _next_level(below: Column) -> Column:
    runs = F.ceil(F.length(below) / (RUN * WIDTH)).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), runs - 1), lambda i: digest(F.substring(below, i * (RUN * WIDTH) + 1, F.lit(RUN * WIDTH)))
    )
    return F.array_join(hashed, "")


def _blocks(nodes: DataFrame, label: str) -> DataFrame:
    """One row per block: its digest, its levels as strings, and its nodes' rows in order."""
    grouped = nodes.groupBy("g", "size", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "row"))).alias("nodes")
    )
    made = grouped.select(
        "g",
        "size",
        "block",
        F.least(_height(F.col("size")), F.lit(LEVELS)).alias("up"),
        F.transform("nodes", lambda x: x["row"]).alias("rows"),
        F.array_join(F.transform("nodes", lambda x: x["digest"]), "").alias("level0"),
    )
    for k in range(1, LEVELS + 1):
        made = made.withColumn(f"level{k}", F.when(F.col("up") >= k, _next_level(F.col(f"level{k - 1}"))))
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])
    return kept(made.withColumn("digest", top), label)


def _tree(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of leaves, blocks of these blocks, and so on until every group is one block."""
    trees = [_blocks(nodes, "merkle-leaves")]
    while not trees[-1].where(F.col("size") > BLOCK).isEmpty():
        above = trees[-1].where(F.col("size") > BLOCK).select(
            "g", F.ceil(F.col("size") / BLOCK).alias("size"), F.col("block").alias("pos"), "digest", F.lit(None).cast("int").alias("row")
        )
        trees.append(_blocks(above, "merkle-blocks"))
    return trees


def _inside(i: Column) -> Column:
    """Siblings of a block's node, level by level up to the block's top."""

    def pair(k: int) -> Column:
        level = F.col(f"level{k}")
        at = F.floor(i / RUN**k).cast("int")
        run = F.floor(at / RUN).cast("int") * RUN
        left = F.substring(level, run * WIDTH + 1, (at - run) * WIDTH)
        right = F.substring(level, (at + 1) * WIDTH + 1, (run + RUN - at - 1) * WIDTH)
        return F.struct(left.alias("left"), right.alias("right"))

    pairs = F.array(*[F.when(F.col("up") > k, pair(k)) for k in range(LEVELS)])
    return F.filter(pairs, lambda p: p.isNotNull())


def _tops(trees: list[DataFrame]) -> DataFrame:
    """(g, root) of every group."""
    whole = [t.where(F.col("size") <= BLOCK).select("g", F.col("digest").alias("root")) for t in trees]
    out = whole[0]
    for more in whole[1:]:
        out = out.unionByName(more)
    return out


def _paths(trees: list[DataFrame]) -> DataFrame:
    """(g, row, digest, path to the group's root) of every leaf."""
    above = None
    for blocks in reversed(trees):
        blocks = blocks.withColumn("_none", F.array().cast(_PATH))
        if above is None:
            held = blocks.withColumn("path", F.col("_none"))
        else:
            held = blocks.join(above, ["g", "block"], "left").withColumn("path", F.coalesce("path", "_none"))
        each = F.transform(
            F.sequence(F.lit(0), F.size("rows") - 1),
            lambda i: F.struct(
                (F.col("block") * BLOCK + i).alias("block"),
                F.get(F.col("rows"), i).alias("row"),
                F.substring(F.col("level0"), i * WIDTH + 1, F.lit(WIDTH)).alias("digest"),
                F.concat(_inside(i), F.col("path")).alias("path"),
            ),
        )
        leaves = held.select("g", F.inline(each))
        above = leaves.select("g", "block", "path")
    return leaves.select("g", "row", "digest", "path")


def proofs(rows: DataFrame, group: str, key: str, digest_column: str) -> DataFrame:
    """(row, digest, subroot, root, path): each row as a struct, its group's and the table's root.

    `digest_column` holds the leaf digests (lower-case hex, 64 digits). The path leads
    from the leaf over the group's root to the table's.
    """
    g = F.col(f"`{group}`").cast("string")
    leaves = rows.select(
        F.when(g.isNull(), "").otherwise(F.concat(F.lit("="), g)).alias("g"),
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{digest_column}`").alias("digest"),
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
    )
    trees = _tree(_numbered(leaves))
    subroots = _tops(trees)
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("root").alias("digest"), F.col("g").alias("row"))
    top = _tree(_numbered(groups))
    upper = _paths(top).select(F.col("row").alias("g"), F.col("digest").alias("subroot"), F.col("path").alias("_upper"))
    root = _tops(top).select("root")
    return (
        _paths(trees)
        .join(upper, "g")
        .crossJoin(F.broadcast(root))
        .select("row", "digest", "subroot", "root", F.concat("path", "_upper").alias("path"))
    )
