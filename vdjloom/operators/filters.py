"""Read filters and trims.

Filters take ``keep="pass"`` (default), ``"fail"`` or ``"both"``; ``both``
returns every read with a BOOLEAN ``_pass`` column, so one scan serves the
two outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions import bases, quality
from vdjloom.functions.binding import bind, let
from vdjloom.sources.schema import require_field, require_quality

# Characters allowed in a sequence record.
VALID_ALPHABET = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv-"


def split_on(df: DataFrame, condition: Column, keep: str) -> DataFrame:
    passed = F.coalesce(condition, F.lit(False))
    if keep == "pass":
        return df.filter(passed)
    if keep == "fail":
        return df.filter(~passed)
    if keep == "both":
        return df.withColumn("_pass", passed)
    raise ValueError("keep must be 'pass', 'fail' or 'both'")


def _scope(inner: bool) -> Column:
    return bases.inner(F.col("seq")) if inner else F.col("seq")


def filter_length(df: DataFrame, min_length: int, inner: bool = True,
                  keep: str = "pass") -> DataFrame:
    """Keep reads with at least ``min_length`` bases."""
    return split_on(df, F.length(_scope(inner)) >= min_length, keep)


def filter_quality(df: DataFrame, min_qual: float = 20, inner: bool = True,
                   keep: str = "pass") -> DataFrame:
    """Keep reads whose mean Phred score is at least ``min_qual``."""
    require_quality(df)
    scores, seq = F.col("qual"), F.col("seq")
    length = F.length(_scope(inner))
    if inner:
        scores = F.when(length == F.length(seq), scores).otherwise(
            F.slice(scores, bases.inner_start(seq) + 1, length))
    # Bound: a filter below the projection that makes the scores would make them again for every score.
    passed = bind(df, {"_enough": (length > 0) & (quality.total(scores) >= min_qual * length)})
    return split_on(passed, F.col("_enough"), keep).drop("_enough")


def filter_missing(df: DataFrame, max_missing: int, inner: bool = True,
                   keep: str = "pass") -> DataFrame:
    """Keep reads with at most ``max_missing`` missing characters."""
    return split_on(df, bases.count_missing(_scope(inner)) <= max_missing, keep)


def filter_repeats(df: DataFrame, max_repeat: int, include_missing: bool = False,
                   inner: bool = True, keep: str = "pass") -> DataFrame:
    """Keep reads without a single-base run longer than ``max_repeat``."""
    letters = ["A", "C", "G", "T"] + (["N", "-", "[.]"] if include_missing else [])
    runs = "|".join(f"{c}{{{max_repeat + 1},}}" for c in letters)
    scope = _scope(inner)
    return split_on(df, (F.length(scope) > 0) & ~F.upper(scope).rlike(runs), keep)


def trim_quality(df: DataFrame, min_qual: float = 20, window: int = 10,
                 reverse: bool = False, keep: str = "pass") -> DataFrame:
    """Cut each read where a sliding window's mean quality first drops.

    The window moves by one base and is shorter at the end of the read; the
    read is cut at the start of the first window whose mean is below
    ``min_qual``.  ``reverse`` scans from the other end and trims the head.
    Reads left empty fail.
    """
    require_quality(df)
    scores = F.reverse("qual") if reverse else F.col("qual")

    def first_low(q: Column) -> Column:
        """Start of the first low window: one running sum over the full
        windows, then the shorter windows at the end of the read."""
        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + 1
            total = acc["total"] + x - F.coalesce(F.get(q, at - 1 - window), F.lit(0))
            hit = (at >= window) & (total < min_qual * window)
            return F.struct(
                at.alias("at"), total.alias("total"),
                F.coalesce(acc["cut"], F.when(hit, at - window + 1)).alias("cut"))

        def low_tail(start: Column) -> Column:
            part = F.slice(q, start, F.lit(window))
            return quality.total(part) < min_qual * F.size(part)

        begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("total"),
                         F.lit(None).cast("int").alias("cut"))
        full = F.aggregate(q, begin, step, lambda acc: acc["cut"])
        tail = F.sequence(F.greatest(F.size(q) - window + 2, F.lit(1)), F.size(q))
        return F.coalesce(full, F.get(F.filter(tail, low_tail), F.lit(0)), F.size(q) + 1)

    kept = F.col("_kept")
    trimmed = bind(df, {
        "_kept": F.when(F.size("qual") > 0, let(scores, first_low) - 1).otherwise(0)})
    begin = F.length("seq") - kept + 1 if reverse else F.lit(1)
    if keep != "fail":
        trimmed = trimmed.withColumns({
            "seq": F.substr("seq", begin, kept),
            "qual": F.slice("qual", begin, kept),
        })
    return split_on(trimmed, kept > 0, keep).drop("_kept")


def mask_quality(df: DataFrame, min_qual: float) -> DataFrame:
    """Replace bases scored below ``min_qual`` by N."""
    require_quality(df)
    masked = F.array_join(
        F.zip_with(
            F.split("seq", ""), F.col("qual"),
            lambda base, q: F.when(q < min_qual, F.lit("N")).otherwise(base)),
        "",
    )
    return df.withColumn("seq", masked)


def valid_sequence(df: DataFrame, col: str = "seq", keep: str = "pass") -> DataFrame:
    """Keep non-empty sequences over the nucleotide alphabet."""
    return split_on(df, F.col(col).rlike(f"^[{VALID_ALPHABET}]+$"), keep)


def first_by_id(df: DataFrame, id_col: str = "read_id", order: str = "seq_no",
                keep: str = "pass") -> DataFrame:
    """Keep the first record of every id in input order.

    ``order`` repeats when files are read apart and united; among records of one
    id and order the one with the smallest hash of its columns is first, and of
    wholly equal records one.  Records without an id count as one id.

    The first per id comes from an aggregate that starts before the shuffle, and
    with it the whole record if only those are kept.  Otherwise the flag comes
    from a join by the record's hash, so an id shared by very many records never
    gathers them in one sort.
    """
    require_field(df, id_col, order)
    own = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    if keep == "pass":
        record = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.groupBy(F.col(id_col).alias("_id")).agg(
            F.min_by(record, F.struct(F.col(order), own)).alias("_record")).select("_record.*")
    numbered = df.withColumn("_own", own)
    firsts = numbered.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.struct(order, "_own"))["_own"].alias("_own"))
    same = F.row_number().over(Window.partitionBy("_own", id_col).orderBy("_own"))
    flagged = numbered.alias("a").join(
        firsts.alias("b"), (F.col("a._own") == F.col("b._own")) & F.col(id_col).eqNullSafe(F.col("_id")), "left").select(
        "a.*", F.col("b._own").isNotNull().alias("_match"))
    flagged = flagged.withColumn("_first", F.col("_match") & (same == 1))
    return split_on(flagged, F.col("_first"), keep).select(
        *df.columns, *(["_pass"] if keep == "both" else []))
