"""Error estimation: mismatches against the set consensus, distance histograms."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx
from vdjloom.functions import quality
from vdjloom.functions.durable import checkpoint
from vdjloom.operators import tiles
from vdjloom.operators.sets import BASES, by_set, call_positions, diversity_rate, position_counts
from vdjloom.sources.schema import require_field, require_quality

SET_BINS = 50


def usable_sets(df: DataFrame, set_field: str, min_count: int = 20,
                max_diversity: float | None = None) -> DataFrame:
    """(set, n) of the sets with enough reads, all of one length."""
    require_field(df, set_field)
    keyed = df.select(
        fx.text(F.col(set_field)).alias("set"), "seq", F.length("seq").alias("len"))
    good = keyed.groupBy("set").agg(
        F.count("*").alias("n"), F.min("len").alias("lo"), F.max("len").alias("hi")
    ).filter((F.col("n") >= min_count) & (F.col("lo") == F.col("hi"))).select("set", "n")
    if max_diversity is None:
        return good
    good = checkpoint(good)
    spread = position_counts(
        keyed, ["set"], sets=good.withColumnRenamed("n", "_size")).groupBy("set").agg(diversity_rate().alias("v"))
    return good.join(spread.filter(F.col("v") <= max_diversity).select("set"), "set")


def error_counts(df: DataFrame, set_field: str = "BARCODE", min_count: int = 20,
                 mode: str = "freq", min_freq: float = 0.6, min_qual: float = 0,
                 max_diversity: float | None = None) -> DataFrame:
    """Number of read bases by (position, score, consensus base, read base, set size).

    The reads of usable sets move once, whole, to their set (see ``by_set``) and
    are counted there per (set, position, base, score); the consensus is a sum
    over the few scores and bases of a position.  The result is small and
    bounded by its keys; it is checkpointed and every table derives from it.
    """
    require_quality(df)
    if mode not in ("freq", "qual"):
        raise ValueError("mode must be 'freq' or 'qual'")
    sets = checkpoint(usable_sets(df, set_field, min_count, max_diversity)).filter(
        "set IS NOT NULL").withColumnRenamed("n", "_size")
    cells = F.posexplode(F.arrays_zip(
        F.split(F.upper("seq"), "").alias("base"), F.col("qual").alias("q")))
    counted = by_set(
        df.select(fx.text(F.col(set_field)).alias("set"), "seq", "qual"), "set",
        lambda reads: reads.select("set", "_size", cells.alias("pos", "c")).groupBy(
            "set", F.col("_size").alias("set_n"), "pos", F.col("c.base").alias("obs"),
            F.col("c.q").cast("int").alias("score")).agg(F.count("*").alias("k")), sets=sets)
    place = Window.partitionBy("set", "pos")
    votes = {
        f"{n}_{b}": F.sum(F.when(F.col("obs") == b, of).otherwise(0)).over(place)
        for b in BASES for n, of in (("n", F.col("k")), ("q", F.col("k") * F.col("score")))}
    called = call_positions(
        counted.withColumns(votes), min_freq, min_qual, with_quality=mode == "qual").filter(
        F.col("obs").isin(*BASES) & (F.col("base") != "N"))
    return checkpoint(called.groupBy(
        "pos", F.col("score").alias("q"), F.col("base").alias("ref"), "obs", "set_n").agg(
        F.sum("k").alias("k")))


def _rates(df: DataFrame) -> DataFrame:
    """mismatch, total, q_sum to the reported columns; a zero error counts as Q90."""
    error = F.col("mismatch") / F.col("total")
    error = F.when(error == 0, F.lit(1e-9)).otherwise(error)
    return df.withColumns({
        "rep_q": F.col("q_sum") / F.col("total"), "error": error,
        "emp_q": quality.empirical(error)}).drop("q_sum")


def _by(counts: DataFrame, key: Column) -> DataFrame:
    wrong = F.col("ref") != F.col("obs")
    return counts.groupBy(key).agg(
        F.sum(F.when(wrong, F.col("k")).otherwise(0)).alias("mismatch"),
        F.sum("k").alias("total"), F.sum(F.col("k") * F.col("q")).alias("q_sum"))


def error_tables(counts: DataFrame) -> dict[str, DataFrame]:
    """The tables position, quality, nucleotide and set from ``error_counts``.

    The quality table lists the scores 0 to 93, unseen ones with NULL rates.
    In the nucleotide table the observations of (reference, observed) count
    the reads whose *observed* base equals the reference letter of the row.
    """
    spark = counts.sparkSession
    letters = spark.createDataFrame(
        [(a, b) for a in BASES for b in BASES if a != b], "reference string, observed string")
    wrong = counts.filter(F.col("ref") != F.col("obs")).groupBy(
        F.col("ref").alias("reference"), F.col("obs").alias("observed")).agg(
        F.sum("k").alias("mismatch"))
    seen = counts.groupBy(F.col("obs").alias("reference")).agg(
        F.sum("k").alias("total"), F.sum(F.col("k") * F.col("q")).alias("q_sum"))
    nucleotide = letters.join(wrong, ["reference", "observed"], "left").join(
        seen, "reference", "left").fillna(0, ["mismatch"])
    scores = spark.range(94).select(F.col("id").cast("int").alias("q"))
    by_q = scores.join(_by(counts, F.col("q")), "q", "left").fillna(0, ["mismatch", "total"])
    null_if_unseen = by_q.withColumn(
        "total", F.when(F.col("total") > 0, F.col("total")))
    return {
        "position": _rates(_by(counts, F.col("pos").alias("position"))),
        "quality": _rates(null_if_unseen).fillna(0, ["total"]),
        "nucleotide": _rates(nucleotide),
        "set": _rates(_by(counts, F.col("set_n").alias("set_count"))),
    }


def error_profile(df: DataFrame, set_field: str = "BARCODE", **options) -> dict[str, DataFrame]:
    return error_tables(error_counts(df, set_field, **options))


def error_summary(counts: DataFrame) -> DataFrame:
    """One row of overall error rates; the nucleotide rate is scaled by 3,
    because each observation stands in three rows of its table."""
    tables = error_tables(counts)
    rows = [
        t.agg((F.sum("mismatch") / F.sum("total") * (3 if name == "nucleotide" else 1))
              .alias("error")).select(F.lit(name).alias("name"), "error")
        for name, t in tables.items()]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


# -- distances ---------------------------------------------------------------------

def set_distance_hist(df: DataFrame, set_field: str = "BARCODE", min_count: int = 20,
                      bins: int = SET_BINS, max_diversity: float | None = None) -> DataFrame:
    """(bin, pairs): normalised pairwise distances within sets, in ``bins`` bins."""
    sets = usable_sets(df, set_field, min_count, max_diversity)
    distinct = df.select(fx.text(F.col(set_field)).alias("set"), "seq").groupBy(
        "set", "seq").agg(F.count("*").alias("n")).join(sets.select("set"), "set")
    found = tiles.distances(distinct)
    place = F.least(F.floor(F.col("d") * bins / F.col("length")), F.lit(bins - 1)).cast("int")
    return _all_bins(found.groupBy(place.alias("bin")).agg(F.sum("pairs").alias("pairs")), bins)


def _all_bins(found: DataFrame, bins: int) -> DataFrame:
    every = found.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").fillna(0, ["pairs"])


def barcode_distance_hist(df: DataFrame, barcode: str = "BARCODE", pad: str = "none",
                          method: str = "auto") -> DataFrame:
    """(bin, pairs): pairwise barcode distances over all reads, bin = mismatches.

    Shorter barcodes are left out, or padded with N at the ``head`` or
    ``tail``.  Only distinct barcodes are compared.  ``tiles`` compares them
    blockwise; ``subsets`` costs the same per barcode however many there are
    (see ``_by_subsets``) and is chosen when there are many short barcodes.
    """
    require_field(df, barcode)
    codes = df.select(fx.text(F.col(barcode)).alias("seq")).groupBy("seq").agg(
        F.count("*").alias("n"))
    length, distinct = codes.agg(F.max(F.length("seq")), F.count("*")).first()
    length = length or 0
    if pad == "none":
        codes = codes.filter(F.length("seq") == length)
    elif pad in ("head", "tail"):
        fill = F.lpad if pad == "head" else F.rpad
        codes = codes.select(fill("seq", length, "N").alias("seq"), "n").groupBy("seq").agg(
            F.sum("n").alias("n"))
    else:
        raise ValueError("pad must be 'none', 'head' or 'tail'")
    if method == "auto":
        method = "subsets" if distinct > 16 * 2 ** length else "tiles"
    if method == "subsets":
        return _by_subsets(codes, length)
    found = tiles.distances(codes.withColumn("set", F.lit("")))
    return _all_bins(found.select(F.col("d").alias("bin"), "pairs"), length + 1)


def _masked(letters: Column, first: int, count: int) -> Column:
    """All ways to keep or blank ``count`` letters from place ``first`` on."""
    return F.transform(F.sequence(F.lit(0), F.lit(2 ** count - 1)), lambda m: F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(
            F.call_function("getbit", m, i) == 1,
            F.substr(letters, i + first + 1, F.lit(1))).otherwise(F.lit("*"))), ""))


def _by_subsets(codes: DataFrame, length: int) -> DataFrame:
    """Distance histogram from group sizes instead of pairs.

    Let T_k be the number of (pair, k places) with the pair equal at those
    places: group the barcodes by each choice of k places and add c(c-1)/2 per
    group.  With N_a pairs equal at exactly a places, T_k = sum_a C(a,k) N_a,
    which inverts to N_a = sum_k (-1)^(k-a) C(k,a) T_k.  The work is linear in
    the number of distinct barcodes; counts are merged after each half of the
    places, so crowded regions shrink early.
    """
    half = length // 2
    first = codes.select(
        F.explode(_masked(F.col("seq"), 0, half) if half else F.array(F.lit(""))).alias("a"),
        F.substr("seq", F.lit(half + 1)).alias("b"), "n").groupBy("a", "b").agg(
        F.sum("n").alias("n"))
    second = first.select(
        "a", F.explode(_masked(F.col("b"), 0, length - half)).alias("b"), "n").groupBy(
        "a", "b").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    kept = length - (F.length(F.concat("a", "b")) - F.length(
        F.translate(F.concat("a", "b"), "*", "")))
    sums = second.groupBy(kept.alias("k")).agg(
        F.sum((F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")).alias("t"))
    t = {r["k"]: int(r["t"]) // 2 for r in sums.collect()}   # length + 1 rows
    counts = [
        (length - a, sum((-1) ** (k - a) * comb(k, a) * t.get(k, 0) for k in range(a, length + 1)))
        for a in range(length + 1)]
    return codes.sparkSession.createDataFrame(counts, "bin int, pairs bigint")


def distance_threshold(hist: DataFrame, after_mode: bool = False, legacy: bool = False
                       ) -> DataFrame:
    """One row: the clustering threshold a histogram suggests.

    The mean place of the minima among the first 75 % of the bins, as a share
    of all bins.  ``after_mode`` (distances within sets) starts at the fullest
    bin; ``legacy`` then forgets to add that start back.
    """
    whole = Window.partitionBy(F.lit(0))
    sized = hist.withColumns({
        "_bins": F.count("*").over(whole),
        "_top": F.max("pairs").over(whole)})
    start = F.min(F.when(F.col("pairs") == F.col("_top"), F.col("bin"))).over(whole)
    sized = sized.withColumn("_start", start if after_mode else F.lit(0))
    kept = F.floor((F.col("_bins") - F.col("_start")) * 0.75)
    window = sized.filter(
        (F.col("bin") >= F.col("_start")) & (F.col("bin") < F.col("_start") + kept))
    least = window.withColumn("_least", F.min("pairs").over(whole)).filter(
        F.col("pairs") == F.col("_least"))
    shift = F.lit(0) if legacy else F.first("_start")
    return least.agg(((
        F.floor(F.avg(F.col("bin") - F.col("_start"))) + shift) / F.first("_bins")
    ).alias("threshold"))
