"""Sharding by a hierarchical weighted hash tree.

A cluster is a tree: regions hold racks, racks hold shards, and every node
weighs what its shards weigh.  A document descends from the top: at each level
every child draws ``-ln(u) / weight`` with ``u`` hashed from the document's key
and the child's name, and the smallest draw wins.  A child's draw depends on
nothing but its own weight, so changing a weight moves documents only between
the changed subtree and its siblings: rows between unchanged subtrees stay.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.binding import bind
from vdjloom.llm.shared import free_name, written

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

_HEX = 13
_SPAN = float(16 ** _HEX)

#: Rows of a shard that are numbered together, about.
ROWS_PER_SLICE = 50_000


def layout(shards: int, base: int = 16, regions: int = 2, racks: int = 2) -> Tree:
    """Shards 0 to base-1 dealt evenly to the racks; each further shard is a region of its own.

    A cluster of more than ``base`` shards so differs from one of a shard less
    by one whole subtree, and growing takes rows into the new shard only.
    """
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        if s < base:
            rack = s * regions * racks // base
            tree.setdefault(f"r{rack // racks}", {}).setdefault(f"k{rack % racks}", {})[s] = 1.0
        else:
            tree[f"x{s}"] = {"k0": {s: 1.0}}
    return tree


def _uniform(key: Column, name: str) -> Column:
    """Uniform in (0, 1], from 52 bits of the md5 of the key and a node's name."""
    digits = F.substring(F.md5(F.concat_ws("/", key, F.lit(name)).cast("binary")), 1, _HEX)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 1.0) / _SPAN


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, Mapping) else float(node)


def _winner(key: Column, path: str, children: Mapping) -> Column:
    """Index of the child with the smallest weighted draw; of equal draws, the first."""
    live = [(i, name, _weight(node)) for i, (name, node) in enumerate(children.items()) if _weight(node) > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    draws = [F.struct((-F.ln(_uniform(key, f"{path}/{name}")) / w).alias("d"), F.lit(i).alias("i")) for i, name, w in live]
    return F.least(*draws)["i"]


def _leaf(key: Column, path: str, node) -> Column:
    chosen, out = _winner(key, path, node), None
    for i, (name, child) in enumerate(node.items()):
        if _weight(child) <= 0:
            continue
        below = _leaf(key, f"{path}/{name}", child) if isinstance(child, Mapping) else F.lit(int(name))
        out = below if out is None else F.when(chosen == i, below).otherwise(out)
    return out


def descend(key: Column, tree: Tree) -> Column:
    """Shard number of a text key in ``tree``; nodes without weight get nothing."""
    return _leaf(key, "t", tree)


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) in one of ``shards`` shards.

    Returns doc_id, size (UTF-8 bytes of the text, none for null, plus 1),
    text_crc32 (of those bytes), law ``key``, shard, slot and grown_shard (the
    shard when there is one more).  doc_id and the number of shards decide; a
    null doc_id is a key like any other, so repeated ids stay together.  Slots
    number a shard's rows without gaps from 0, by hash of key, checksum and size
    (so that rows of one id are numbered in many slices), then by these, null first.  Other columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = _key(F.col("doc_id"))
    slim = docs.select(
        "doc_id", (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        key.alias("_key"))
    placed = bind(slim, {"shard": descend(F.col("_key"), layout(shards)).cast("int"),
                         "grown_shard": descend(F.col("_key"), layout(shards + 1)).cast("int"),
                         "_h": _uniform(F.concat_ws("/", "_key", "text_crc32", "size"), "slot")}).drop("_key")
    placed = written(placed, "placed")
    slices = max(1, placed.count() // (shards * ROWS_PER_SLICE))
    sliced = placed.withColumn("_slice", F.floor(F.col("_h") * slices * (1 - 1e-15)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("shard", "_slice").count().select(
        "shard", "_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_h", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        sliced.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_slice"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("_rank") + F.col("_start")).cast("bigint").alias("slot"), "grown_shard")
    )


def place(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Add ``shard`` to whole rows of ``docs`` (doc_id): each row finds its shard alone, nothing is shuffled.

    If ``docs`` has a column of that name, the new one has underscores in front.
    """
    return docs.withColumn(free_name(docs, "shard"), descend(_key(F.col("doc_id")), layout(shards)).cast("int"))


def moved(docs: DataFrame, before: Tree, after: Tree, key: str = "doc_id") -> DataFrame:
    """How many rows go from which shard to which when the tree changes."""
    k = free_name(docs, "k")
    keyed = docs.select(_key(F.col(key)).alias(k))
    return (
        keyed.select(descend(F.col(k), before).alias("shard"), descend(F.col(k), after).alias("new_shard"))
        .where("shard <> new_shard").groupBy("shard", "new_shard").count())
