"""Statistics of steps and comparisons of outputs, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx
from vdjloom.sources.schema import field_names


# -- step statistics ---------------------------------------------------------------

class StepStats:
    """Counts reads before and after steps while the data flows.

    ``watch`` attaches an observed count to a DataFrame; the counts are filled
    by the job that consumes the final output, so they cost no job of their
    own.  ``table`` then gives (step, lane, before, failed, remaining).
    """

    def __init__(self) -> None:
        self._seen: list[tuple[int, str, int, str, Observation]] = []

    def watch(self, df: DataFrame, index: int, step: str, lane: int, end: str) -> DataFrame:
        if end not in ("before", "remaining"):
            raise ValueError("end must be 'before' or 'remaining'")
        mark = Observation(f"{index}-{step}-{lane}-{end}")
        self._seen.append((index, step, lane, end, mark))
        return df.observe(mark, F.count(F.lit(1)).alias("n"))

    def table(self, spark) -> DataFrame:
        counts: dict[tuple[int, str, int], dict[str, int]] = {}
        for index, step, lane, end, mark in self._seen:
            counts.setdefault((index, step, lane), {})[end] = mark.get["n"]
        rows = [(i, s, lane, c["before"], max(c["before"] - c["remaining"], 0), c["remaining"])
                for (i, s, lane), c in counts.items()]
        return spark.createDataFrame(
            rows, "idx int, step string, lane int, before bigint, failed bigint, remaining bigint")


def step_stats(steps: list[tuple[str, int, DataFrame, DataFrame]]) -> DataFrame:
    """(idx, step, lane, before, failed, remaining) for (name, lane, in, out) steps."""
    rows = []
    for index, (name, lane, before, after) in enumerate(steps, 1):
        marks = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).union(
            after.select(F.lit(0), F.lit(1)))
        rows.append(marks.agg(F.sum("b").alias("before"), F.sum("a").alias("remaining")).select(
            F.lit(index).alias("idx"), F.lit(name).alias("step"), F.lit(lane).alias("lane"),
            "before", F.greatest(F.col("before") - F.col("remaining"), F.lit(0)).alias("failed"),
            "remaining"))
    out = rows[0]
    for row in rows[1:]:
        out = out.union(row)
    return out


def lane_totals(stats: DataFrame) -> DataFrame:
    """Statistics summed over the lanes of a step."""
    return stats.groupBy("idx", "step").agg(
        *[F.sum(c).alias(c) for c in ("before", "failed", "remaining")])


def retention(stats: DataFrame) -> DataFrame:
    """Share kept by each step, and of the first step's input so far.

    One row per step, so the window over all of them stays tiny.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("idx")
    totals = lane_totals(stats)
    initial = F.first("before").over(order)
    return totals.select(
        "idx", "step", "before", "remaining",
        F.when(F.col("before") > 0, F.col("remaining") / F.col("before")).otherwise(0.0)
        .alias("step_retention"),
        F.when(initial > 0, F.col("remaining") / initial).otherwise(0.0).alias("cumulative"))


# -- comparisons -----------------------------------------------------------------------

def _annotations(df: DataFrame) -> Column:
    return F.sort_array(F.array_compact(F.array(*[
        F.when(F.col(f).isNotNull(), F.concat(F.lit(f + "="), fx.text(F.col(f))))
        for f in sorted(field_names(df))]))) if field_names(df) else F.array().cast("array<string>")


def _by_id(df: DataFrame, side: str) -> DataFrame:
    qual = F.col("qual") if "qual" in df.columns else F.lit(None).cast("array<tinyint>")
    order = F.col("seq_no") if "seq_no" in df.columns else F.lit(0)
    record = F.struct(F.col("seq").alias("s"), qual.alias("q"), _annotations(df).alias("a"))
    return df.groupBy("read_id").agg(
        F.count("*").alias(f"n_{side}"), F.max_by(record, order).alias(side))


def compare_records(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of counts: how two sets of reads differ, regardless of order.

    Records are matched by id; of a repeated id the last record counts.
    """
    joined = _by_id(a, "a").join(_by_id(b, "b"), "read_id", "full")
    both = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()

    def differs(part):
        return F.count_if(both & ~F.col(f"a.{part}").eqNullSafe(F.col(f"b.{part}")))

    return joined.agg(
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("records_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("records_b"),
        F.coalesce(F.sum(F.col("n_a") - 1), F.lit(0)).alias("duplicate_ids_a"),
        F.coalesce(F.sum(F.col("n_b") - 1), F.lit(0)).alias("duplicate_ids_b"),
        F.count_if(F.col("n_b").isNull()).alias("missing"),
        F.count_if(F.col("n_a").isNull()).alias("additional"),
        differs("s").alias("sequence_differs"), differs("q").alias("quality_differs"),
        differs("a").alias("annotations_differ"),
        F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("identical"))


def multiset_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows in both, only in ``a``, only in ``b``, counted as multisets."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        raise ValueError(f"columns differ: {columns} and {sorted(b.columns)}")
    marked = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counted = marked.groupBy(*columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    zero = F.lit(0)
    return counted.agg(
        F.coalesce(F.sum(F.least("_a", "_b")), zero).alias("identical"),
        F.coalesce(F.sum(F.greatest(F.col("_a") - F.col("_b"), zero)), zero).alias("only_a"),
        F.coalesce(F.sum(F.greatest(F.col("_b") - F.col("_a"), zero)), zero).alias("only_b"))


def compare_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset counts of two tables as text, columns matched by name."""
    def text(df):
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return multiset_counts(text(a), text(b))


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset intersection."""
    return a.intersectAll(b.select(*a.columns))


def extra_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference: rows of ``a`` beyond those of ``b``."""
    return a.exceptAll(b.select(*a.columns))


def _canonical(df: DataFrame, field: str, group: str | None) -> DataFrame:
    """(read_id, label): every cluster named by its smallest member."""
    keys = [fx.text(F.col(field)).alias("_c")]
    if group:
        keys.append(fx.text(F.col(group)).alias("_g"))
    named = df.select("read_id", *keys)
    by = ["_c", "_g"] if group else ["_c"]
    first = named.groupBy(*by).agg(F.min("read_id").alias("label"))
    on = [named[c].eqNullSafe(first[c]) for c in by]
    return named.join(first, on).select("read_id", "label")


def same_partition(a: DataFrame, b: DataFrame, field: str = "CLUSTER",
                   group: str | None = None) -> DataFrame:
    """One row: clusters on each side, reads placed differently, and whether
    the two clusterings are the same up to their labels."""
    left = _canonical(a, field, group).withColumnRenamed("label", "la")
    right = _canonical(b, field, group).withColumnRenamed("label", "lb")
    joined = left.join(right, "read_id", "full")
    return joined.agg(
        F.count_distinct("la").alias("clusters_a"), F.count_distinct("lb").alias("clusters_b"),
        F.count_if(~F.col("la").eqNullSafe(F.col("lb"))).alias("moved")
    ).withColumn("same", F.col("moved") == 0)


def check_sidecar(records: DataFrame, sidecar: DataFrame, source_columns: list[str]) -> DataFrame:
    """One row: does every record have exactly one sidecar row, with all columns?"""
    side = sidecar.groupBy("sequence_id").agg(F.count("*").alias("n"))
    main = records.select("sequence_id").distinct().withColumn("r", F.lit(True))
    kept = [c for c in source_columns if c in sidecar.columns]
    return main.join(side, "sequence_id", "full").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("n").alias("distinct_ids"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"),
        F.count_if(F.col("r").isNull()).alias("rows_without_record"),
        F.count_if(F.col("n").isNull()).alias("records_without_row")
    ).withColumn("columns_missing", F.lit(len(source_columns) - len(kept)))


def compare_fields(a: DataFrame, b: DataFrame, fields: list[str], key: str = "sequence_id"
                   ) -> DataFrame:
    """(field, mismatches) over the records both sides have."""
    left = a.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    right = b.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields])
    counts = left.join(right, key).agg(*[
        F.count_if(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))).alias(f) for f in fields])
    return counts.unpivot([], fields, "field", "mismatches")


def check_sample(sample: DataFrame, source: DataFrame) -> DataFrame:
    """One row: size of a sample, repeated rows, rows that are not in the source."""
    columns = sorted(set(sample.columns) & set(source.columns))
    marked = sample.select(*columns, F.lit(1).alias("_s"), F.lit(0).alias("_o")).unionByName(
        source.select(*columns, F.lit(0).alias("_s"), F.lit(1).alias("_o")))
    counted = marked.groupBy(*columns).agg(F.sum("_s").alias("s"), F.sum("_o").alias("o"))
    return counted.agg(
        F.sum("s").alias("records"),
        F.sum(F.greatest(F.col("s") - 1, F.lit(0))).alias("duplicates"),
        F.sum(F.greatest(F.col("s") - F.col("o"), F.lit(0))).alias("not_in_source"))


def _part_prints(df: DataFrame, part: str) -> DataFrame:
    """(part, rows, two order-free sums of row hashes), aggregated per part."""
    columns = sorted(c for c in df.columns if c != part)
    low = F.xxhash64(*[F.col(c) for c in columns])
    high = F.xxhash64(F.lit(17), *[F.col(c) for c in columns])
    return df.groupBy(F.col(part).cast("string").alias("part")).agg(
        F.count("*").alias("rows"), F.sum(low.cast("decimal(38,0)")).alias("h1"),
        F.sum(high.cast("decimal(38,0)")).alias("h2"))


def compare_parts(a: DataFrame, b: DataFrame, part: str = "part") -> DataFrame:
    """One row: parts on each side, and parts of ``a`` with an equal part in ``b``.

    Each part may be matched once; equal parts are counted as multisets.
    """
    print_ = ["rows", "h1", "h2"]
    left = _part_prints(a, part).groupBy(*print_).agg(F.count("*").alias("na"))
    right = _part_prints(b, part).groupBy(*print_).agg(F.count("*").alias("nb"))
    joined = left.join(right, print_, "full").fillna(0, ["na", "nb"])
    return joined.agg(
        F.sum("na").alias("parts_a"), F.sum("nb").alias("parts_b"),
        F.sum(F.least("na", "nb")).alias("matched"))
