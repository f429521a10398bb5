"""Shards by a hierarchical weighted hash tree.

A row descends from the root to a region, a rack and a shard. At each level every child
draws ``-ln(u) / weight`` with ``u`` from a hash of the row's id and the child's name, and
the smallest draw takes the row. A child's draw depends on nothing but its own weight, so
a change of weights moves rows only into the subtrees that gained and out of those that
lost; all rows inside an unchanged subtree stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kodagraf.runtime import cut

SHARDS = 40
RACKS, PER_RACK = 4, 5
#: Rows that one numbering group has on average, at most.
SLOT_ROWS = 100_000

#: region -> rack -> {shard: weight}
Tree = dict[str, dict[str, dict[int, float]]]


def tree(shards: int, base: int = SHARDS) -> Tree:
    """Equal shards: the first ``base`` in regions of ``RACKS * PER_RACK``, each further one in a region of its own.

    A shard that is added is thus a new region: only its own draw is new, and rows move
    into it and nowhere else.
    """
    out: Tree = {}
    for s in range(shards):
        region, rack = (f"region{s // (RACKS * PER_RACK)}", s // PER_RACK % RACKS) if s < base else (f"single{s}", 0)
        out.setdefault(region, {}).setdefault(f"{region}/rack{rack}", {})[s] = 1.0
    return out


def _draw(key: Column, name: str, weight: float) -> Column:
    # 53 bits of the hash as a number in (0, 1].
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((bits + 1) / F.lit(float(1 << 53))) / F.lit(weight)


def shard_of(key: Column, layout: Tree) -> Column:
    """The shard of an id: region, rack, shard by the smallest draw. Children of weight 0 take nothing."""

    def weight(node: dict | float) -> float:
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def descend(node: dict, level: str) -> Column:
        options = []
        for i, (name, child) in enumerate(node.items()):
            if weight(child) > 0:
                value = descend(child, str(name)) if isinstance(child, dict) else F.lit(int(name))
                draw = _draw(key, f"{level}>{name}", weight(child))
                options.append(F.struct(draw.alias("draw"), F.lit(i).alias("i"), value.alias("value")))
        return (F.least(*options) if len(options) > 1 else options[0])["value"]

    return descend(layout, "root")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard. rows: a written table with shard and row.

    Rows are counted by shard and hash bucket first; a row's slot is the number of rows in
    the buckets before its own plus its place within it. No group follows the largest shard.
    """
    n = rows.count()
    buckets = max(1, n // (SLOT_ROWS * 4))
    held = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = held.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1
    return held.withColumn("place", place).join(starts, ["shard", "bucket"]).withColumn(
        "slot", (F.col("start") + F.col("place")).cast("bigint")
    ).drop("bucket", "place", "start")


def assign(docs: DataFrame, layout: Tree, grown: Tree | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) for every row of ``docs`` (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 16. text_crc32 of a null text is that
    of the empty one. The shard depends on doc_id alone: repeated rows share it, and rows
    without doc_id share the shard of a missing id. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(F.col("doc_id"), layout).cast("int").alias("shard"),
        (shard_of(F.col("doc_id"), grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    return numbered(cut(rows, "shards")).drop("row")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    found = assign(docs, tree(shards), tree(shards + 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
