"""Operator 7: a hierarchical weighted hash tree of regions, racks and shards.

At each node every child draws -ln(u) / weight, u from a hash of the row's key and
the child's name, and the least draw wins; a child's weight is the number of shards
below it. A change of weights below one child changes that child's draws alone, so rows
move only into or out of its subtree. A further shard comes as a region of its own:
rows move only into it. The law is `key`: doc_id and the tree decide.

Results: a null text has size 1 and checksum 0; rows come back one for one, repeated rows
with slots of their own; null ids share one key; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, two_columns

#: A tree: a shard's number, or (name, children).
Tree = int | tuple


def even_tree(regions: int = 4, racks: int = 2, shards: int = 2) -> Tree:
    """Regions of racks of shards, numbered in order."""
    number = iter(range(regions * racks * shards))
    return ("", [(f"region{r}", [(f"region{r}/rack{k}", [next(number) for _ in range(shards)]) for k in range(racks)]) for r in range(regions)])


def grown_tree(tree: Tree) -> Tree:
    """The tree with one more shard, in a region of its own."""
    name, children = tree
    return (name, [*children, (f"region{len(children)}", [weight(tree)])])


def weight(tree: Tree) -> int:
    return 1 if isinstance(tree, int) else sum(map(weight, tree[1]))


def _name(tree: Tree) -> str:
    return f"shard{tree}" if isinstance(tree, int) else tree[0]


def _draw(key: Column, child: Tree) -> Column:
    h = F.xxhash64(F.concat_ws(":", F.lit(_name(child)), key))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight(child)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key, by draws from the root down."""
    if isinstance(tree, int):
        return F.lit(tree)
    if len(tree[1]) == 1:
        return shard_of(key, tree[1][0])
    draws = [_draw(key, c) for c in tree[1]]
    least = F.least(*draws)
    found = F.when(draws[0] == least, shard_of(key, tree[1][0]))
    for draw, child in zip(draws[1:-1], tree[1][1:-1], strict=True):
        found = found.when(draw == least, shard_of(key, child))
    return found.otherwise(shard_of(key, tree[1][-1]))


#: Rows that are numbered together, about.
TOGETHER = 4096


def assign_shards(df: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and the shard after one more is added, for every row.

    Slots: rows alike in id and text are counted; a shard's rows fall into buckets of about TOGETHER by a hash of both; each is numbered
    alone and begins where the buckets before it end. Only numbers are shuffled, never a text."""
    tree = even_tree() if tree is None else tree
    rows = two_columns(df, id_col, text_col)
    shards = weight(tree)
    buckets = max(1, df.count() // (TOGETHER * shards))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    alike = rows.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    alike = alike.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("rows"))
    placed = stored(
        alike.select(
            "*",
            shard_of(key, tree).cast("int").alias("shard"),
            shard_of(key, grown_tree(tree)).cast("int").alias("grown_shard"),
            F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int").alias("bucket"),
        )
    )
    counted = placed.groupBy("shard", "bucket").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("at", F.coalesce(F.sum("rows").over(order), F.lit(0))).join(first, ["shard", "bucket"])
    slots = F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.col("at") + F.col("rows") - 1)).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots, "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
