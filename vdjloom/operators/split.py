"""Splitting, sampling, sorting and selecting reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx
from vdjloom.functions import ordering
from vdjloom.functions.durable import checkpoint, few
from vdjloom.sources.schema import require_field


def split_count(df: DataFrame, n: int) -> DataFrame:
    """Add ``part``: consecutive parts of ``n`` reads in input order, from 1.

    Input order is ``seq_no``; sorted reads take theirs from ``ordering.renumber``.
    """
    numbered = ordering.number_rows(df, "seq_no", "_row")
    return numbered.withColumn(
        "part", (F.floor(F.col("_row") / n) + 1).cast("bigint")).drop("_row")


def split_group(df: DataFrame, field: str) -> DataFrame:
    """Add ``part``: the value of ``field``."""
    require_field(df, field)
    return df.withColumn("part", fx.text(F.col(field)))


def _as_number(field: str) -> Column:
    """The field as a number: 0 where it is absent or empty; other text stops the run."""
    written = fx.text(F.col(field))
    refused = F.raise_error(F.concat(F.lit(f"{field} is no number: "), written)).cast("double")
    return F.coalesce(fx.number(written), refused)


def split_threshold(df: DataFrame, field: str, threshold: float) -> dict[str, DataFrame]:
    """Two outputs: ``under`` (below the threshold; an absent field counts as 0) and ``atleast``."""
    require_field(df, field)
    value = _as_number(field)
    return {"under": df.filter(value < threshold), "atleast": df.filter(value >= threshold)}


def mark_threshold(df: DataFrame, field: str, threshold: float) -> DataFrame:
    """The same split as one DataFrame with a ``part`` column."""
    require_field(df, field)
    value = _as_number(field)
    return df.withColumn(
        "part", F.when(value < threshold, F.lit("under")).otherwise(F.lit("atleast")))


# -- sampling ------------------------------------------------------------------

SLICE = 10_000  # reads of a group that are ranked together, about


def _ticket(seed: int) -> Column:
    """A repeatable lottery number per read."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("read_id")))


def _restrict(df: DataFrame, field: str | None, values: list[str] | None) -> DataFrame:
    if values is None:
        return df
    require_field(df, field)
    return df.filter(F.arrays_overlap(F.col(field), F.array(*[F.lit(v) for v in values])))


def sample_reads(df: DataFrame, sizes: list[int], field: str | None = None,
                 values: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Random samples without replacement, one per size (column ``sample_size``).

    With ``field`` alone, the sample is drawn from every value of the field;
    with ``values`` too, from the reads that carry one of the values.  Sizes
    above the number of reads give all reads.

    A group is cut into slices of its lottery numbers.  Only slices that reach
    into the sample are ranked, each by itself, so no task sorts a whole group
    or sample, whatever their sizes.  Groups and slices are looked up where the
    reads lie (see ``few``), so reads outside those slices do not move.
    """
    pool = _restrict(df, field, values).withColumn("_ticket", _ticket(seed))
    largest = max(sizes)
    each = field is not None and values is None
    group = F.coalesce(F.concat(F.lit("="), fx.text(F.col(field))), F.lit("")) if each else F.lit("")
    pool = pool.withColumn("_group", group)
    slices = few(pool.groupBy("_group").agg(F.ceil(F.count("*") / SLICE).alias("_slices")))
    draw = F.conv(F.substring("_ticket", 1, 13), 16, 10).cast("bigint").cast("double") / float(16 ** 13)
    sliced = pool.join(slices, "_group").withColumn("_slice", F.floor(draw * F.col("_slices"))).drop("_slices")
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    reached = few(sliced.groupBy("_group", "_slice").agg(F.count("*").alias("_n")).select(
        "_group", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).filter(
        F.col("_before") < largest))
    order = Window.partitionBy("_group", "_slice").orderBy("_ticket", "read_id")
    drawn = sliced.join(reached, ["_group", "_slice"]).withColumn(
        "_rank", F.row_number().over(order) + F.col("_before")).filter(F.col("_rank") <= largest).drop(
        "_group", "_slice", "_before")
    fits = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: F.col("_rank") <= n)
    return drawn.withColumn("sample_size", F.explode(fits)).drop("_ticket", "_rank")


def sample_pairs(r1: DataFrame, r2: DataFrame, sizes: list[int], field: str | None = None,
                 values: list[str] | None = None, seed: int = 0
                 ) -> tuple[DataFrame, DataFrame]:
    """The same sampled pairs from both mates."""
    both = r1.join(r2.select("read_id"), "read_id", "left_semi")
    keys = sample_reads(both, sizes, field, values, seed).select("read_id", "sample_size")
    return r1.join(keys, "read_id"), r2.join(keys, "read_id")


# -- sorting ---------------------------------------------------------------------

def sort_reads(df: DataFrame, field: str, numeric: bool = False,
               max_count: int | None = None) -> DataFrame:
    """Sort by a field, input order within equal values.

    With ``max_count`` a ``part`` column is added: parts of at most
    ``max_count`` reads filled in sorted order that never split a value (a
    value with more reads than that has its own part).  Reads without the field
    come first and count as one value.
    """
    require_field(df, field)
    key = _as_number(field) if numeric else fx.text(F.col(field))
    keyed = df.withColumn("_key", key)
    if max_count is not None:
        parts = _parts(keyed, max_count).withColumnRenamed("_key", "_part_key")
        keyed = keyed.join(parts, F.col("_key").eqNullSafe(F.col("_part_key"))).drop("_part_key")
        return keyed.orderBy("part", "_key", "seq_no").drop("_key")
    return keyed.orderBy("_key", "seq_no").drop("_key")


def _parts(keyed: DataFrame, limit: int) -> DataFrame:
    """(_key, part): values laid end to end and cut greedily at ``limit`` reads.

    Value i takes the places [begin, end).  If a part opens at i, the next
    part opens at the value that covers the place begin + limit, or at the end
    of value i if that lies further on.  That successor is found for every
    value at once.  Values lie in blocks of at most 65,536 that follow each
    other; in a block the chain from every value is followed to the first value
    behind the block, so pointer doubling only needs the values where a chain
    enters a block.  Then each block marks the values that open a part on the
    one chain that enters it.
    """
    sizes = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    ranked = ordering.renumber(sizes.orderBy("_key"), "_rank")
    laid = ordering.running(ranked, "_rank", F.col("_n"), "begin").select(
        "_key", F.shiftright("_rank", ordering.BITS).alias("block"), "begin", (F.col("begin") + F.col("_n")).alias("end"))
    laid = checkpoint(laid)
    chain = checkpoint(laid.select("block", "begin").join(_successors(laid, limit), "begin"))
    left = checkpoint(chain.groupBy("block").applyInPandas(_leaver(), "begin bigint, next bigint"))
    entered = left.select(F.col("next").alias("begin")).filter("begin IS NOT NULL").union(
        left.filter("begin = 0").select("begin")).distinct()
    jump = checkpoint(left.join(entered, "begin", "left_semi"))
    opened = left.filter("begin = 0").select("begin")
    found = opened.count()
    while True:
        step = jump.join(opened, "begin").select(F.col("next").alias("begin"))
        opened = checkpoint(opened.union(step.filter("begin IS NOT NULL")).distinct())
        size = opened.count()
        if size == found:
            break
        found = size
        far = jump.select(F.col("begin").alias("next"), F.col("next").alias("far"))
        jump = checkpoint(jump.join(far, "next").select("begin", F.col("far").alias("next")))
    entry = chain.join(opened, "begin", "left_semi").select("block", F.col("begin").alias("entry"))
    marks = chain.join(entry, "block").groupBy("block").applyInPandas(_marker(), "begin bigint, _mark int")
    # Each value belongs to the last part opened at or before it.
    marked = laid.join(checkpoint(marks), "begin", "left").select(
        "_key", "begin", F.coalesce("_mark", F.lit(0)).alias("_mark"))
    counted = ordering.running(marked, "begin", F.col("_mark"), "_before")
    return counted.select("_key", (F.col("_before") + F.col("_mark")).alias("part"))


def _leaver():
    """Per value of a block: the first value behind the block on the chain from it."""
    import numpy as np
    import pandas as pd

    def leave(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("begin", ignore_index=True)
        begin = block["begin"].to_numpy()
        inside = np.searchsorted(begin, block["next"].fillna(-1).to_numpy("int64"))
        behind = block["next"].isna() | (block["next"] > begin[-1])
        out = block["next"].tolist()
        for i in range(len(out) - 1, -1, -1):
            if not behind[i]:
                out[i] = out[inside[i]]
        return pd.DataFrame({"begin": begin, "next": pd.array(
            [None if pd.isna(x) else int(x) for x in out], "Int64")})

    return leave


def _marker():
    """Per value of a block: 1 if a part opens there on the chain that enters at ``entry``."""
    import numpy as np
    import pandas as pd

    def mark(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("begin", ignore_index=True)
        begin, following = block["begin"].to_numpy(), block["next"].fillna(-1).to_numpy("int64")
        marks = np.zeros(len(begin), "int32")
        at = int(block["entry"].iloc[0])
        while 0 <= at <= begin[-1]:
            place = int(np.searchsorted(begin, at))
            marks[place] = 1
            at = int(following[place])
        return pd.DataFrame({"begin": begin, "_mark": marks})

    return mark


def _successors(laid: DataFrame, limit: int) -> DataFrame:
    """(begin, next): where the part opens that follows one opened at begin.

    That is the value that covers place begin + limit, or the one behind a value
    that fills a part of its own.

    Values lie end to end, so the one that covers a place is the last that
    begins at or before it.
    """
    values = laid.select(F.col("begin").alias("at"), F.struct("begin", "end").alias("value"),
                         F.lit(None).cast("bigint").alias("asker"))
    asks = laid.select(F.greatest(F.col("begin") + limit, F.col("end")).alias("at"), F.lit(None).cast("struct<begin:bigint,end:bigint>"),
                       F.col("begin"))
    found = ordering.highest(values.union(asks), "at", F.col("value"), "cover").filter("asker IS NOT NULL")
    return found.select(
        F.col("asker").alias("begin"),
        F.when(F.col("cover.end") > F.col("at"), F.col("cover.begin")).alias("next"))


# -- selection --------------------------------------------------------------------

def select_reads(df: DataFrame, field: str, values: list[str] | DataFrame,
                 negate: bool = False) -> DataFrame:
    """Keep (or drop) reads with any value of ``field`` among ``values``.

    ``values`` is a list, or a DataFrame whose first column holds the values;
    the latter becomes a semi (anti) join, by broadcast if it is small (see
    ``few``), so that few values make no few tasks.  A read without the field has none of
    the values, so kept and dropped reads together are the input.
    """
    require_field(df, field)
    if not isinstance(values, DataFrame):
        hit = F.coalesce(
            F.arrays_overlap(F.col(field), F.array(*[F.lit(str(v)) for v in values])),
            F.lit(False))
        return df.filter(~hit if negate else hit)
    table = few(values.select(F.col(values.columns[0]).cast("string").alias("_v")).distinct())
    several = F.coalesce(F.size(field), F.lit(0)) > 1
    single = df.filter(~several).withColumn("_v", F.get(field, F.lit(0)))
    many = df.filter(several)
    # Whether a read has one of the values depends on its field alone, so the reads need no names.
    held = many.select(F.col(field).alias("_held")).distinct()
    hits = few(held.select("_held", F.explode("_held").alias("_v")).join(table, "_v", "left_semi").select("_held").distinct())
    how = "left_anti" if negate else "left_semi"
    kept = single.join(table, "_v", how).drop("_v").select(*df.columns)
    return kept.unionByName(many.join(hits, F.col(field) == F.col("_held"), how))
