"""Sharding by a hierarchical weighted hash tree.

A key goes down the tree of regions, racks and shards. At each level every child has a draw, and
the lowest wins. A shard draws an exponential number from the hash of (key, shard), divided by its
weight; what a rack or a region draws is the lowest draw of the shards below it, which is an
exponential number for the sum of their weights. So a node wins with a chance in proportion to
the weight below it, and a key that enters a subtree because a weight in it grew, or because it
has one more shard, has the draw of that shard and goes down to it and nowhere else: whatever the
number of shards, keys move only into a shard that gains weight and only out of one that loses it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenara.llm.common import table, without, written

RACKS_IN_REGION, SHARDS_IN_RACK = 2, 4
_UNIT = float(1 << 53)
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass(frozen=True)
class Tree:
    """Weights of the shards, and which racks and regions they stand in: filled rack by rack and region by region."""

    weights: tuple[float, ...]
    racks_in_region: int = RACKS_IN_REGION
    shards_in_rack: int = SHARDS_IN_RACK

    def __post_init__(self) -> None:
        if not any(w > 0 for w in self.weights) or min(self.weights) < 0:
            raise ValueError("there must be a shard with a weight, and none below 0")

    def below(self, level: int) -> list[range]:
        """The children of each node: those of racks are shards, those of regions racks, that of the root regions."""
        size = (self.shards_in_rack, self.racks_in_region)
        n = len(self.weights)
        for k in range(level):
            n = -(-n // size[k])
        if level == 2:
            return [range(n)]
        return [range(i, min(i + size[level], n)) for i in range(0, n, size[level])]


def layout(shards: int, weights: list[float] | None = None) -> Tree:
    """The tree of shards 0 to `shards` - 1, of weight 1 each unless given."""
    if shards < 1:
        raise ValueError("there must be a shard")
    return Tree(tuple(weights) if weights else (1.0,) * shards)


def _draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for u in (0, 1] from the hash of key and shard: the lowest wins with a chance in proportion to its weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard {shard}")), 11) + 1) / _UNIT
    return -F.log(u) / F.lit(weight) if weight > 0 else F.lit(float("inf"))


def _least(columns: list[str]) -> Column:
    return F.least(*columns) if len(columns) > 1 else F.col(columns[0])


def _first_of(draw: Column, columns: list[str], children: range) -> Column:
    """The child that has this draw; of equal ones the earlier."""
    out = F.lit(children[-1])
    for child, c in reversed(list(zip(children, columns, strict=True))[:-1]):
        out = F.when(F.col(c) == draw, F.lit(child)).otherwise(out)
    return out


def descended(docs: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """`docs` plus `out`, the shard that the tree gives the key. Each level is a few short columns of its own."""
    kept = [c for c in docs.columns if c != out]
    at = f"__{out}_"
    names = lambda level, n: [f"{at}{'dkrt'[level]}{i}" for i in range(n)]
    now = docs.withColumn(f"{at}key", key)
    draws = names(0, len(tree.weights))
    now = now.select("*", *[_draw(F.col(f"{at}key"), s, w).alias(c) for s, (c, w) in enumerate(zip(draws, tree.weights, strict=True))])
    levels = [draws]
    for level in range(3):
        nodes = tree.below(level)
        made = names(level + 1, len(nodes))
        now = now.select("*", *[_least([levels[level][i] for i in children]).alias(c) for c, children in zip(made, nodes, strict=True)])
        levels.append(made)
    # down again: the region with the root's draw, in it the rack, in it the shard; elsewhere nothing is looked at
    won = F.lit(0)
    for level in (2, 1, 0):
        step = None
        for node, children in enumerate(tree.below(level)):
            value = _first_of(F.col(levels[level + 1][node]), [levels[level][i] for i in children], children)
            step = F.when(won == node, value) if step is None else step.when(won == node, value)
        now = now.withColumn(f"{at}at{level}", step)
        won = F.col(f"{at}at{level}")
    return now.select(*kept, won.cast("int").alias(out))


def sharded(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", tree: Tree | None = None, grown: Tree | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all if None) plus size, text_crc32, law, shard, slot and grown_shard.

    A row's shard follows from its id and the tree alone; rows without id share one place, and
    repeated rows stay together in different slots. `slot` numbers a shard's rows from 0 without
    a gap: rows are numbered within each part of a written table, in its order, and start where
    the parts before end; no shard, key or copied text is ever gathered in one task. `size` is
    the UTF-8 bytes of the text (none for null) plus 8, `text_crc32` the unsigned CRC-32 of those
    bytes. Existing columns of these names are replaced; an empty table gives an empty one.
    """
    docs = without(docs, [*RESULT, "__part", "__row", "__from"])
    kept = [c for c in docs.columns if keep is None or c in keep]
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(*docs.columns, (F.octet_length(bytes_).cast("long") + 8).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    placed = placed.withColumn("__key", F.coalesce(F.col(id).cast("string"), F.lit("null"))).select(*kept, "size", "text_crc32", "__key")
    placed = descended(placed, F.col("__key"), tree or layout(shards), "shard")
    placed = descended(placed, F.col("__key"), grown or layout(shards + 1), "grown_shard").drop("__key")
    # a row's number in the order in which it is written is then fixed, whatever task reads it again
    placed = written(placed.withColumn("__row", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__row", 33))
    counts = placed.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")
    starts = counts.select("shard", "__part", before.alias("__from"))
    within = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__row"))
    out = placed.withColumn("__nth", within - 1).join(starts, ["shard", "__part"])
    return out.select(*kept, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__from") + F.col("__nth")).cast("long").alias("slot"), "grown_shard")


def op2_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    """All `documents` in shards 0 to 23; see the README's contract table."""
    return sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), 24, keep=["doc_id"])
