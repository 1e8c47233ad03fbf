"""Greedy first-fit grouping as rounds of joins.

Items come in a fixed order.  Each item joins the first earlier *founder* it
matches, and founds a group of its own when it matches none; this is what a
one-by-one scan would do.  Here it runs in rounds over all items at once:

* two items can match only if they share a key, so comparisons are equi joins;
* per round every key offers its first few undecided items as leaders, and
  items are compared with the leaders of their keys only;
* a leader seen by all of its keys that matches no earlier undecided item is
  certainly a founder; items that match a founder are certainly members and
  stop being leaders, but stay until no earlier founder can turn up.

A key shared by very many items costs (items x leaders) rows per round, spread
by the join over all tasks, and never a product of the items with themselves;
one founder usually takes in most of a crowded key in the first round.  The
number of leaders per key grows each round, so the rounds stay few.  State is
checkpointed each round: a lost executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.durable import checkpoint

UNDECIDED, MEMBER, FOUNDER = 0, 1, 2


def first_fit(items: DataFrame, match: Callable[[Column, Column], Column],
              leaders: int = 1, growth: int = 4) -> DataFrame:
    """Map every item to its founder.

    ``items`` has ``rank`` (unique BIGINT order), ``keys`` (ARRAY of join
    keys) and ``data`` (what ``match`` compares).  Returns (rank, founder).
    """
    state = checkpoint(items.select(
        "rank", "keys", "data", F.lit(UNDECIDED).alias("status"),
        F.lit(None).cast("bigint").alias("best")))
    while state.filter(F.col("status") == UNDECIDED).limit(1).count():
        state = checkpoint(_round(state, match, leaders))
        leaders *= growth
    return state.select("rank", F.coalesce("best", "rank").alias("founder"))


def _round(state: DataFrame, match, limit: int) -> DataFrame:
    waiting = state.filter(F.col("status") == UNDECIDED)
    in_order = Window.partitionBy("key").orderBy("rank")
    offers = (
        waiting.select("rank", F.explode("keys").alias("key"))
        .withColumn("place", F.row_number().over(in_order))
        .filter(F.col("place") <= limit)
        .select("key", "rank")
    )
    lead = offers.join(waiting.select("rank", "data"), "rank").select(
        "key", F.col("rank").alias("leader"), F.col("data").alias("leader_data"))
    others = state.filter(F.col("status") != FOUNDER).select(
        "rank", "data", "status", "best", F.explode("keys").alias("key"))
    earlier = F.col("leader") < F.least(F.col("rank"), F.coalesce("best", "rank"))
    edges = (
        others.join(lead, "key").filter(earlier)
        .filter(match(F.col("leader_data"), F.col("data")))
        .select("rank", "leader", "status").distinct()
    )
    edges = checkpoint(edges)
    blocked = edges.filter(F.col("status") == UNDECIDED).select("rank").distinct()
    seen = offers.groupBy("rank").agg(F.count("*").alias("offered"))
    founders = (
        waiting.select("rank", F.size("keys").alias("needed")).join(seen, "rank")
        .filter(F.col("offered") == F.col("needed"))
        .join(blocked, "rank", "left_anti").select("rank")
    )
    joins = edges.join(founders.select(F.col("rank").alias("leader")), "leader").groupBy(
        "rank").agg(F.min("leader").alias("first"))
    marked = founders.select("rank", F.lit(FOUNDER).alias("now"))
    best = F.least("best", "first")
    return (
        state.join(joins, "rank", "left").join(marked, "rank", "left")
        .select(
            "rank", "keys", "data",
            F.coalesce("now", F.when(best.isNotNull(), MEMBER), "status").alias("status"),
            best.alias("best"))
    )
