"""Documents dealt to shards by descending a weighted hash tree: region, rack, shard.

At each level every child draws a number from the key's hash, ``-ln(u) / weight``, and
the smallest draw wins, so a child is chosen in proportion to its weight. A child whose
weight grows can only win keys, one whose weight shrinks can only lose them, and the
draws of all others stay as they are: a change moves rows only into, out of or within the
subtrees whose weights change. ``tree_of`` fills racks and regions in order, and what
does not fit into full ones opens a new region of its own. With all racks full, one more
shard is then a subtree of its own and takes rows only into itself.

The law of the contract is ``key``: id and number of shards decide. It promises nothing
about equal texts. Slots number a shard's rows without gaps: rows are counted per
(shard, part of the key's hash), the counts are summed up in order, and only rows of one
part are ranked together. Equal rows are counted before they are shuffled.

Defined cases: a null doc_id is hashed as the empty key; null texts have size 1 and the
CRC of no bytes. Repeated rows each get a slot. Weights must be above 0. Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from logwarden.sources.landing import land

#: Parts of the hash within a shard that are ranked by themselves: hexadecimal digits.
PART_DIGITS = 3
#: Rows that are made at once from the count of equal rows.
RUN = 65_536


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Inner nodes weigh what their children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree_of(shards: int, per_rack: int = 2, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Regions of racks of shards, numbered in order; the last rack and region may hold less."""
    if shards < 1:
        raise ValueError("at least one shard")
    leaves = [Node(f"s{k}", (), (weights or {}).get(k, 1.0), k) for k in range(shards)]
    if any(leaf.own_weight <= 0 for leaf in leaves):
        raise ValueError("weights must be above 0")
    racks = [Node(f"k{k}", tuple(leaves[k * per_rack:(k + 1) * per_rack])) for k in range(-(-shards // per_rack))]
    regions = [Node(f"r{k}", tuple(racks[k * racks_per_region:(k + 1) * racks_per_region]))
               for k in range(-(-len(racks) // racks_per_region))]
    return Node("root", tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight, u in (0, 1) from 48 bits of the MD5 of the node's name and the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{node.name}:"), key).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard that the key reaches from this node. Ties go to the first child."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [draw(key, child) for child in node.children]
    chosen = F.array_position(F.array(*draws), F.array_min(F.array(*draws)))
    choice = F.when(F.lit(False), F.lit(0))
    for k, child in enumerate(node.children, 1):
        choice = choice.when(chosen == k, descend(key, child))
    return choice


def assign(docs: DataFrame, tree: Node, grown: Node) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, grown_shard and the hash part it is ranked in."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    ).select(
        "*", descend(key, tree).cast("int").alias("shard"), descend(key, grown).cast("int").alias("grown_shard"),
        F.substring(F.md5(F.concat_ws(":", key, "text_crc32", "size").cast("binary")), 1, PART_DIGITS).alias("part"),
    )


def with_slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers from 0 within each shard, in order of part, doc_id (nulls first), CRC and size."""
    counted = land(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "shards")
    parts = counted.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    first = counted.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, ["shard", "part"])
    first = first.withColumn("first", F.col("first") + F.col("base"))
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))))
    return runs.withColumn("slot", F.explode(F.sequence(
        F.col("first") + F.col("run"), F.col("first") + F.least(F.col("run") + RUN, "n") - 1))).drop(
        "n", "base", "first", "run", "part")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = with_slots(assign(docs, tree_of(shards), tree_of(shards + 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
