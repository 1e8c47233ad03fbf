"""Cluster barcodes or sequences by identity.

Clustering is greedy by abundance: sequences are taken by falling read count
(then alphabetically), and each joins the first cluster whose founder it is
close enough to.  Only distinct sequences are compared.  Two sequences close
enough must share a key, so comparisons are equi joins (see ``firstfit``).

Sequences are compared place by place:

* short equal-length sequences: every way to blank the allowed mismatches; the
  sequences that share such a key are few, whatever the data;
* otherwise: segments, one more than the allowed mismatches, of which at least
  one must be equal.

Barcodes are compared by edit distance, as a base may be lost or gained:

* short ones: every way to delete up to the allowed number of bases, since two
  strings within t edits are equal after t deletions in each at most;
* otherwise: segments, one more than the allowed edits, at their own place and
  shifted by as many places to either side.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions import bases, ordering
from vdjloom.functions import fields as fx
from vdjloom.functions.binding import let
from vdjloom.functions.durable import checkpoint
from vdjloom.operators.filters import split_on
from vdjloom.operators.firstfit import first_fit
from vdjloom.sources.schema import require_field

MAX_MASKS = 200
_SLACK = 1e-9


def allowed(length: int, ident: float) -> int:
    """Mismatches allowed in ``length`` bases at identity ``ident``."""
    return floor(length * (1 - ident) + _SLACK)


def _match(ident: float, length_ratio: float):
    """Identity is counted from the first base over the shorter sequence; a
    missing base agrees with nothing."""
    def match(a: Column, b: Column) -> Column:
        short, long = F.least(a["len"], b["len"]), F.greatest(a["len"], b["len"])
        near = bases.packed_matches(a["w"], b["w"]) >= short - F.floor(
            short * F.lit(1 - ident) + _SLACK)
        return near & (short >= long * length_ratio) if length_ratio > 0 else near
    return match


def _edit_match(ident: float, length_ratio: float):
    """Edits are counted against the shorter sequence; a missing base agrees with nothing."""
    def match(a: Column, b: Column) -> Column:
        short, long = F.least(a["len"], b["len"]), F.greatest(a["len"], b["len"])
        edits = F.levenshtein(a["s"], F.translate(b["s"], "N", "n"))
        near = edits <= F.floor(short * F.lit(1 - ident) + _SLACK)
        return near & (short >= long * length_ratio) if length_ratio > 0 else near
    return match


def _without_one(seq: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.concat(
        F.substr(seq, F.lit(1), i - 1), F.substr(seq, i + 1)))


def _deletion_keys(seq: Column, edits: int) -> Column:
    """``seq`` and all that is left of it after up to ``edits`` deletions."""
    level = keys = F.array(seq)
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda s: s != ""), _without_one)))
        keys = F.concat(keys, level)
    return F.array_distinct(keys)


def _shifted_keys(seq: Column, width: int, edits: int) -> Column:
    """Segments of ``width`` bases, numbered, each taken at every place within ``edits`` of its own."""
    def around(s: Column, i: Column) -> Column:
        starts = F.filter(F.sequence(i * width - edits, i * width + edits), lambda at: (at >= 0) & (at + width <= F.length(s)))
        return F.transform(starts, lambda at: F.concat_ws(":", i, F.substr(s, at + 1, F.lit(width))))

    return let(seq, lambda s: F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) + edits) / width).cast("int")), lambda i: around(s, i)))))


def _edit_keys(lengths: list[int], ident: float) -> Column:
    seq, edits = F.col("seq"), allowed(max(lengths), ident)
    if sum(comb(max(lengths), k) for k in range(edits + 1)) <= MAX_MASKS:
        return _deletion_keys(seq, edits)
    width = min(n // (allowed(n, ident) + 1) for n in lengths)
    return _shifted_keys(seq, max(width, 1), edits)


def _mask_keys(seq: Column, length: int, blanks: int) -> Column:
    keys = []
    for places in combinations(range(length), blanks):
        parts, at = [], 0
        for p in places:
            parts += [F.substr(seq, F.lit(at + 1), F.lit(p - at)), F.lit("*")]
            at = p + 1
        keys.append(F.concat(*parts, F.substr(seq, F.lit(at + 1))))
    return F.array(*keys)


def _segment_keys(seq: Column, width: int) -> Column:
    return let(seq, lambda s: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.length(s) / width) - 1, F.lit(0)).cast("int")),
        lambda i: F.concat_ws(":", i, F.substr(s, i * width + 1, F.lit(width)))))


def _keys(lengths: list[int], ident: float) -> Column:
    seq = F.col("seq")
    shortest, longest = min(lengths), max(lengths)
    blanks = allowed(longest, ident)
    if shortest == longest and blanks and comb(longest, blanks) <= MAX_MASKS:
        return _mask_keys(seq, longest, blanks)
    width = min(n // (allowed(n, ident) + 1) for n in lengths)
    return _segment_keys(seq, max(width, 1))


def greedy_clusters(distinct: DataFrame, ident: float, length_ratio: float = 0.0, edits: bool = False) -> DataFrame:
    """(set, seq, cluster): cluster numbers from 1 within each set.

    ``distinct`` has (set, seq, n) with non-empty, upper-case sequences.  With
    ``edits`` lost and gained bases count like substitutions.
    """
    if not 0 < ident <= 1:
        raise ValueError("ident must be above 0 and at most 1")
    ranked = checkpoint(distinct.orderBy("set", F.desc("n"), "seq").withColumn(
        "rank", F.monotonically_increasing_id()))
    lengths = [r[0] for r in ranked.select(F.length("seq")).distinct().collect()]
    if not lengths:
        return ranked.select("set", "seq", F.lit(None).cast("bigint").alias("cluster"))
    made = (_edit_keys if edits else _keys)(lengths, ident)
    keys = F.transform(made, lambda k: F.concat_ws("\x1f", F.col("set"), k))
    shown = F.col("seq").alias("s") if edits else bases.pack(F.col("seq")).alias("w")
    items = ranked.select("rank", keys.alias("keys"), F.struct(shown, F.length("seq").alias("len")).alias("data"))
    fit = first_fit(items, (_edit_match if edits else _match)(ident, length_ratio))
    members = checkpoint(ranked.join(fit, "rank").select("set", "seq", "rank", "founder"))
    founders = ordering.number_rows(
        members.filter(F.col("rank") == F.col("founder")).select("set", "founder"),
        "founder", "_no")
    first = founders.groupBy("set").agg(F.min("_no").alias("_base"))
    numbered = founders.join(first, "set").select(
        "founder", (F.col("_no") - F.col("_base") + 1).alias("cluster"))
    return members.join(numbered, "founder").select("set", "seq", "cluster")


def _attach(df: DataFrame, set_col: Column, seq_col: Column, ident: float,
            length_ratio: float, field: str, prefix: str, keep: str,
            whole_sets: bool = False, edits: bool = False) -> DataFrame:
    keyed = df.withColumns({"_set": set_col, "_seq": F.upper(bases.gaps_to_n(seq_col))})
    usable = F.length("_seq") > 0
    clustered = keyed.filter(usable)
    distinct = clustered.groupBy(F.col("_set").alias("set"), F.col("_seq").alias("seq")).agg(
        F.count("*").alias("n"))
    labels = greedy_clusters(distinct, ident, length_ratio, edits).select(
        F.col("set").alias("_set"), F.col("seq").alias("_seq"),
        F.array(F.concat(F.lit(prefix), F.col("cluster").cast("string"))).alias("_label"))
    joined = keyed.join(labels, ["_set", "_seq"], "left")
    ok = F.col("_label").isNotNull()
    if whole_sets:
        complete = keyed.groupBy("_set").agg(F.bool_and(usable).alias("_complete"))
        joined = joined.join(complete, "_set")
        ok = ok & F.col("_complete")
    out = joined.withColumn(field, F.when(ok, F.col("_label")))
    return split_on(out, ok, keep).drop("_set", "_seq", "_label", "_complete")


def cluster_barcodes(df: DataFrame, barcode: str = "BARCODE", ident: float = 0.9,
                     length_ratio: float = 0.0, field: str = "CLUSTER", prefix: str = "",
                     keep: str = "pass") -> DataFrame:
    """Give reads whose barcodes are alike one value of ``field``.

    Two barcodes are alike within (1 - ``ident``) times the shorter one's length
    edits, rounded down; an edit is a base changed, lost or gained.
    """
    require_field(df, barcode)
    return _attach(df, F.lit(""), fx.text(F.col(barcode)), ident, length_ratio, field,
                   prefix, keep, edits=True)


def _region(start: int, end: int | None) -> Column:
    if end is None:
        return F.substr("seq", F.lit(start + 1))
    return F.substr("seq", F.lit(start + 1), F.lit(max(end - start, 0)))


def cluster_all(df: DataFrame, ident: float = 0.9, length_ratio: float = 0.0,
                seq_start: int = 0, seq_end: int | None = None, field: str = "CLUSTER",
                prefix: str = "", keep: str = "pass") -> DataFrame:
    """Cluster all reads by (a region of) their sequence."""
    return _attach(df, F.lit(""), _region(seq_start, seq_end), ident, length_ratio, field,
                   prefix, keep)


def cluster_sets(df: DataFrame, set_field: str = "BARCODE", ident: float = 0.9,
                 length_ratio: float = 0.0, seq_start: int = 0, seq_end: int | None = None,
                 field: str = "CLUSTER", prefix: str = "", keep: str = "pass") -> DataFrame:
    """Cluster reads within each set; a set with a read that has no bases in
    the region fails as a whole."""
    require_field(df, set_field)
    return _attach(df, fx.text(F.col(set_field)), _region(seq_start, seq_end), ident,
                   length_ratio, field, prefix, keep, whole_sets=True)
