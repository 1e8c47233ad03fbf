"""Global row numbers and running values without a single-partition window.

The order column is a whole number, so the numbers that differ in their last
``BITS`` bits only are one slot: of unique numbers a slot has at most 65,536.
Rows run inside their slot; slots run inside the slot of the next level, which
drops ``BITS`` bits more, up to the 65,536 slots of the top.  No slot is larger
whatever the number of rows, and no pass over the rows is needed to choose them.

The table is read twice, once for its slots and once for its rows, so numbers
that depend on the partitioning (``monotonically_increasing_id``) have to be
written first; see ``renumber``.  A row whose slot the other pass did not see
stops the run.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.durable import checkpoint

BITS = 16
LEVELS = 3  # 64 bits in all: three levels of slots and the numbers within one
_LAST = 2 ** 63 - 1


def _slots(at: Column) -> dict[str, Column]:
    return {f"_slot{i}": F.shiftright(at, BITS * (i + 1)) for i in range(LEVELS)}


def _carried(rows: DataFrame, fold: Callable, merge: Callable) -> DataFrame:
    """(_slot0, _carry): the values of all earlier slots, folded; NULL before the first one."""
    slots = [f"_slot{i}" for i in range(LEVELS)]
    totals = [rows.groupBy(*slots).agg(fold("_amount").alias("_total"))]
    for i in range(1, LEVELS):
        totals.append(totals[-1].groupBy(*slots[i:]).agg(fold("_total").alias("_total")))
    carry = None
    for i in reversed(range(LEVELS)):
        within = Window.partitionBy(slots[i + 1] if i + 1 < LEVELS else F.lit(0)).orderBy(slots[i])
        earlier = fold("_total").over(within.rowsBetween(Window.unboundedPreceding, -1))
        level = totals[i].select(*slots[i:i + 2], earlier.alias("_here"))
        if carry is None:
            carry = level.select(slots[i], F.col("_here").alias("_carry"))
        else:
            carry = level.join(carry, slots[i + 1]).select(
                slots[i], merge(F.col("_here"), F.col("_carry")).alias("_carry"))
    return carry


def _run(df: DataFrame, order: str, amount: Column, fold: Callable, merge: Callable, frame: Callable) -> DataFrame:
    """Add _run: ``amount`` folded over the rows of ``frame`` in the row's slot and all earlier slots."""
    at = F.coalesce(F.col(order).cast("bigint"), F.lit(_LAST))  # rows without a number come last
    slotted = df.withColumns({"_at": at, "_amount": amount}).withColumns(_slots(F.col("_at")))
    inside = fold("_amount").over(frame(Window.partitionBy("_slot0").orderBy("_at")))
    carry = _carried(slotted.select("_amount", *[f"_slot{i}" for i in range(LEVELS)]), fold, merge)
    changed = F.raise_error(F.lit("the order differs between two passes over the table; write it before it is numbered"))
    return slotted.withColumn("_inside", inside).join(
        carry.withColumn("_seen", F.lit(True)), "_slot0", "left").withColumn(
        "_run", F.when(F.col("_seen"), merge(F.col("_inside"), F.col("_carry"))).otherwise(changed)).drop(
        "_at", "_amount", "_inside", "_carry", "_seen", *[f"_slot{i}" for i in range(LEVELS)])


def running(df: DataFrame, order: str, amount: Column, name: str) -> DataFrame:
    """Add the sum of ``amount`` over all rows before this one (unique order)."""
    def merge(a, b):
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    found = _run(df, order, amount, F.sum, merge, lambda w: w.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn(name, F.col("_run").cast("bigint")).drop("_run")


def highest(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Add the highest ``value`` of all rows up to this one's place in ``order``, rows of the same place included."""
    found = _run(df, order, value, F.max, F.greatest, lambda w: w.rangeBetween(
        Window.unboundedPreceding, Window.currentRow))
    return found.withColumnRenamed("_run", name)


def number_rows(df: DataFrame, order: str, name: str) -> DataFrame:
    """Add row numbers from 0 in ``order`` (unique values)."""
    return running(df, order, F.lit(1), name)


def renumber(df: DataFrame, name: str) -> DataFrame:
    """Set ``name`` to ascending numbers in the present order of the rows, with gaps, written once."""
    return checkpoint(df.withColumn(name, F.monotonically_increasing_id()))
