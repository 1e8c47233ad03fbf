"""Sets of reads that share an annotation: unify, consensus, diversity, offsets.

Reads move once and whole to the partition of their set (``by_set``); there
they are exploded to positions and counted per (set, position).  No set is held
in memory, and a set with a large share of all reads is counted where its reads
lie, so it shrinks to one row per position before it moves.  The consensus, the
diversity and the error rate of the set all come from these counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx
from vdjloom.operators.filters import split_on
from vdjloom.sources.schema import require_field, require_quality

BASES = "ACGT"
MAX_CONSENSUS_Q = 90


# -- annotation consensus -----------------------------------------------------

def field_consensus(df: DataFrame, set_field: str, field: str) -> DataFrame:
    """One row per set: distinct values, their counts, the majority, its share.

    Columns ``set``, ``values``, ``counts``, ``cons``, ``freq``; values are in
    ascending order and the smallest value wins a tie.
    """
    require_field(df, set_field, field)
    keyed = df.select(
        fx.text(F.col(set_field)).alias("set"), fx.text(F.col(field)).alias("value"))
    return _summarise_values(keyed, ["set"])


def _summarise_values(keyed: DataFrame, keys: list[str]) -> DataFrame:
    counted = keyed.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct("value", "n")))
    summed = counted.groupBy(*keys).agg(
        ranked.alias("_v"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("cons"),
        F.max("n").alias("_top"), F.sum("n").alias("_all"))
    return summed.select(
        *keys, F.col("_v.value").alias("values"), F.col("_v.n").alias("counts"), "cons",
        (F.col("_top") / F.col("_all")).alias("freq"))


def unify_consensus(df: DataFrame, set_field: str = "BARCODE", field: str = "SAMPLE"
                    ) -> DataFrame:
    """Give every read of a set the set's most frequent value of ``field``.

    A read without a set keeps its value.
    """
    cons = field_consensus(df, set_field, field).select("set", "cons")
    joined = df.withColumn("set", fx.text(F.col(set_field))).join(cons, "set", "left")
    return joined.withColumn(field, F.when(F.col("cons").isNull(), F.col(field)).otherwise(
        F.array("cons"))).select(*df.columns)


def unify_delete(df: DataFrame, set_field: str = "BARCODE", field: str = "SAMPLE",
                 keep: str = "pass") -> DataFrame:
    """Drop the sets in which ``field`` has more than one value; a read without a set fails."""
    require_field(df, set_field, field)
    keyed = df.withColumns({
        "_set": fx.text(F.col(set_field)), "_value": fx.text(F.col(field))})
    uniform = keyed.filter(F.col("_set").isNotNull()).groupBy("_set").agg(
        (F.min("_value") == F.max("_value")).alias("_uniform"))
    flagged = keyed.join(uniform, "_set", "left")
    out = split_on(flagged, F.coalesce("_uniform", F.lit(False)), keep)
    return out.drop("_set", "_value", "_uniform")


# -- position counts -----------------------------------------------------------

#: A set is crowded if it has more reads than this, and more than one in so many of all reads.
CROWDED, CROWDED_SHARE = 100_000, 1_000


def by_set(df: DataFrame, key: str, count: Callable[[DataFrame], DataFrame], least: int = 1,
           sets: DataFrame | None = None) -> DataFrame:
    """``count(reads)``, an aggregate by ``key`` and more that may explode the reads.

    The reads are shuffled once, as they are, by ``key``; what ``count`` makes
    of them needs no other shuffle.  Sets below ``least`` reads are dropped
    before ``count`` sees them; ``sets`` (key, _size; no null) names the only
    sets that count instead.  A crowded set would be one long task: its reads stay in
    place and are counted with map-side combine.  Fewer than CROWDED_SHARE sets
    can be crowded, so their names are broadcast.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_size")) if sets is None else sets
    total, top = sizes.agg(F.sum("_size"), F.max("_size")).first()
    limit = max(CROWDED, (total or 0) // CROWDED_SHARE)
    crowded = (top or 0) > limit
    large = sizes.filter(F.col("_size") > limit)
    if sets is not None:
        whole = df.join(sets.filter(F.col("_size") <= limit).hint("merge"), key)
        return count(whole).unionByName(count(df.join(F.broadcast(large), key))) if crowded else count(whole)
    names = F.broadcast(large.select(F.col(key).alias("_large")))
    same = F.col(key).eqNullSafe(F.col("_large"))
    whole = (df.join(names, same, "left_anti") if crowded else df).repartition(key)
    if least > 1:
        whole = whole.withColumn("_size", F.count("*").over(Window.partitionBy(key))).filter(
            F.col("_size") >= least).drop("_size")
    return count(whole).unionByName(count(df.join(names, same, "left_semi"))) if crowded else count(whole)


def position_counts(df: DataFrame, keys: list[str], with_quality: bool = False,
                    dependent: bool = False, carried: dict[str, Column] | None = None,
                    extra: list[Column] | None = None, least: int = 1,
                    sets: DataFrame | None = None) -> DataFrame:
    """Base counts per (keys, position); the first key names the set.

    ``n_A..n_T`` reads with the base, ``gaps`` reads with a gap, ``n`` reads
    reaching the position; with quality also ``q_A..q_T`` summed scores (or
    the highest score when the reads are not independent).  ``carried``
    columns travel with the exploded rows for the ``extra`` aggregates.
    ``least`` and ``sets`` choose the sets, see ``by_set``.
    """
    df = df.select(*keys, "seq", *(["qual"] if with_quality else []),
                   *[c.alias(n) for n, c in (carried or {}).items()])
    kept = [*keys, *(carried or {})]

    def exploded(reads: DataFrame) -> DataFrame:
        if not with_quality:
            return reads.select(*kept, F.posexplode(F.split(F.upper("seq"), "")).alias("pos", "base"))
        cells = F.posexplode(F.arrays_zip(
            F.split("seq", "").alias("base"), F.col("qual").alias("q")))
        return reads.select(*kept, cells.alias("pos", "cell")).select(
            *kept, "pos", F.upper("cell.base").alias("base"),
            F.col("cell.q").cast("int").alias("q"))

    base = F.col("base")
    aggs = [F.sum((base == b).cast("int")).alias(f"n_{b}") for b in BASES]
    aggs.append(F.sum(base.isin("-", ".").cast("int")).alias("gaps"))
    aggs.append(F.count("*").alias("n"))
    if with_quality:
        fold = F.max if dependent else F.sum
        aggs += [
            F.coalesce(fold(F.when(base == b, F.col("q"))), F.lit(0)).cast("bigint")
            .alias(f"q_{b}") for b in BASES]
    return by_set(df, keys[0], lambda reads: exploded(reads).groupBy(*keys, "pos").agg(
        *aggs, *(extra or [])), least, sets)


def _called() -> Column:
    return sum((F.col(f"n_{b}") for b in BASES), F.lit(0))


def _winner(prefix: str) -> tuple[Column, Column]:
    """(base, amount) with the largest amount; the first letter wins a tie."""
    code = F.greatest(*[
        F.col(f"{prefix}_{b}") * 4 + (3 - i) for i, b in enumerate(BASES)])
    base = F.substr(F.lit(BASES[::-1]), (code % 4 + 1).cast("int"), F.lit(1))
    return base, F.floor(code / 4)


def call_positions(counts: DataFrame, min_freq: float = 0.6, min_qual: float = 0,
                   with_quality: bool = False, dependent: bool = False) -> DataFrame:
    """Add the consensus ``base`` and score ``q`` to position counts.

    Without quality the most common base wins.  With quality the base with
    the largest summed score wins and its score is the winner's sum less all
    other sums, at most 90 (the winner's highest score for dependent reads);
    a score below ``min_qual`` makes the position N.  In both modes the
    position is N when the winner is less than ``min_freq`` of the called
    bases, or nothing is called.
    """
    called = _called()
    if with_quality:
        base, amount = _winner("q")
        others = sum((F.col(f"q_{b}") for b in BASES), F.lit(0)) - amount
        score = amount if dependent else F.least(amount - others, F.lit(MAX_CONSENSUS_Q))
        votes = F.lit(0)
        for b in BASES:
            votes = F.when(base == b, F.col(f"n_{b}")).otherwise(votes)
        ok = (votes / called >= min_freq) & (score >= min_qual) & (score > 0)
    else:
        base, votes = _winner("n")
        score = F.lit(0)
        ok = votes / called >= min_freq
    keep = (called > 0) & ok
    return counts.withColumns({
        "called": called,
        "base": F.when(keep, base).otherwise(F.lit("N")),
        "q": F.when(keep, score).otherwise(F.lit(0)).cast("tinyint"),
    })


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def diversity_rate() -> Column:
    """Mean pairwise mismatch of a set, from its per-position base counts."""
    agreeing = sum((_pairs(F.col(f"n_{b}")) for b in BASES), F.lit(0.0))
    total = F.sum(_pairs(_called()))
    return F.when(total > 0, 1 - F.sum(agreeing) / total).otherwise(F.lit(0.0))


def set_diversity(df: DataFrame, barcode: str = "BARCODE") -> DataFrame:
    """Mean pairwise mismatch rate over called bases, one row per set."""
    keyed = df.withColumn("set", fx.text(F.col(barcode)))
    counts = position_counts(keyed, ["set"])
    return counts.groupBy("set").agg(diversity_rate().alias("diversity"))


def _error(kept: Column) -> Column:
    """Share of called bases that differ from the consensus base."""
    votes = F.lit(0)
    for b in BASES:
        votes = F.when(F.col("base") == b, F.col(f"n_{b}")).otherwise(votes)
    scored = kept & (F.col("base") != "N")
    total = F.sum(F.when(scored, F.col("called")))
    return F.when(
        total > 0, F.sum(F.when(scored, F.col("called") - votes)) / total
    ).otherwise(F.lit(0.0))


def set_error(df: DataFrame, barcode: str = "BARCODE", min_freq: float = 0.6) -> DataFrame:
    """Mismatch rate of the members against the frequency consensus, per set."""
    keyed = df.withColumn("set", fx.text(F.col(barcode)))
    called = call_positions(position_counts(keyed, ["set"]), min_freq)
    return called.groupBy("set").agg(_error(F.lit(True)).alias("error"))


# -- UMI consensus --------------------------------------------------------------

def build_consensus(
    df: DataFrame,
    barcode: str = "BARCODE",
    min_count: int = 1,
    min_freq: float = 0.6,
    min_qual: float = 0,
    primer_field: str | None = None,
    primer_freq: float | None = None,
    max_gap: float | None = None,
    max_error: float | None = None,
    max_diversity: float | None = None,
    copy: list[tuple[str, str]] | None = None,
    dependent: bool = False,
    use_quality: bool | None = None,
    keep: str = "pass",
) -> DataFrame:
    """One consensus read per barcode.

    ``read_id`` is the barcode; CONSCOUNT, PRCONS/PRFREQ (with
    ``primer_freq``) or PRIMER/PRCOUNT and the copied fields are added.
    ``keep="fail"`` returns the failed sets with the rule they broke in
    ``reason``; ``"both"`` returns all sets, ``reason`` NULL when they pass.
    Reads without a barcode are one failed set, with the reason BARCODE.
    """
    require_field(df, barcode, primer_field, *[f for f, _ in copy or ()])
    with_quality = "qual" in df.columns if use_quality is None else use_quality
    if with_quality:
        require_quality(df)
    majority = primer_field is not None and primer_freq is not None
    primer = fx.text(F.col(primer_field)) if majority else F.lit("")
    keyed = df.withColumns({"_set": fx.text(F.col(barcode)), "_primer": primer})
    if keep == "pass":
        keyed = keyed.filter(F.col("_set").isNotNull())
    keys = ["_set", "_primer"]

    # One pass: everything about a set rides on its position counts, and what
    # is counted per read is taken at position 0, which every read has.
    carried, folds, finals = _numeric_copies(copy or [])
    counts = position_counts(
        keyed, keys, with_quality, dependent, {"seq_no": F.col("seq_no"), **carried},
        [F.min("seq_no").alias("seq_no"), *folds], min_count if keep == "pass" else 1)
    positions = call_positions(counts, min_freq, min_qual, with_quality, dependent)
    kept = F.lit(True) if max_gap is None else F.col("gaps") / F.col("n") <= max_gap
    at_first = F.col("pos") == 0
    aggs = [
        F.sort_array(F.collect_list(F.when(kept, F.struct("pos", "base", "q")))).alias("_cells"),
        F.max(F.when(at_first, F.col("n"))).alias("_n"),
        F.min("seq_no").alias("seq_no"), *finals]
    if max_diversity is not None:
        aggs.append(diversity_rate().alias("_diversity"))
    if max_error is not None:
        aggs.append(_error(kept).alias("_error"))
    built = positions.groupBy(*keys).agg(*aggs)
    if majority:
        built = _majority_primer(built, primer_freq)
    else:
        built = built.withColumn("reason", F.lit(None).cast("string"))
    built = built.withColumn("reason", F.coalesce(
        F.when(F.col("_set").isNull(), F.lit("BARCODE")), "reason",
        F.when(F.col("_n") < min_count, F.lit("CONSCOUNT"))))

    reason = F.col("reason")
    if max_diversity is not None:
        reason = F.coalesce(reason, F.when(F.col("_diversity") > max_diversity, "DIVERSITY"))
    if max_error is not None:
        reason = F.coalesce(reason, F.when(F.col("_error") > max_error, "ERROR"))
    built = built.withColumn("reason", reason)
    if keep == "pass":
        built = built.filter(F.col("reason").isNull())
    elif keep == "fail":
        built = built.filter(F.col("reason").isNotNull())

    out = {
        "read_id": F.col("_set"),
        "seq": F.array_join("_cells.base", ""),
        "seq_no": F.col("seq_no"),
        "CONSCOUNT": F.array(F.col("_n").cast("string")),
    }
    if with_quality:
        out["qual"] = F.col("_cells.q")
    if majority:
        out["PRCONS"] = F.array("_primer")
        out["PRFREQ"] = F.array(F.col("_freq").cast("string"))
    for field, action in copy or ():
        if action in ("min", "max", "sum"):
            out[field] = F.array(fx.compact(F.col(f"_{action}_{field}")))
    if keep != "pass":
        out["reason"] = F.col("reason")
    out["_primer"] = F.col("_primer")
    result = built.select(*[c.alias(k) for k, c in out.items()])

    if primer_field is not None and not majority:
        result = _attach_values(result, keyed, primer_field, "PRIMER", "PRCOUNT")
    for field, action in copy or ():
        if action == "set":
            result = _attach_values(result, keyed, field, field, f"{field}_COUNT")
        elif action == "majority":
            result = _attach_majority(result, keyed, field)
        elif action not in ("min", "max", "sum"):
            raise ValueError(f"copy action {action!r} is not min, max, sum, set or majority")
    return result.drop("_primer")


def _numeric_copies(copy: list[tuple[str, str]]):
    """(columns to carry, per-position folds, per-set folds) of numeric copies."""
    reduce = {"min": F.min, "max": F.max, "sum": F.sum}
    carried, folds, finals = {}, [], []
    for field, action in copy:
        if action not in reduce:
            continue
        name = f"_{action}_{field}"
        carried[name] = F.coalesce(fx.number(F.element_at(field, 1)), F.lit(0.0))
        folds.append(reduce[action](F.when(F.col("pos") == 0, F.col(name))).alias(name))
        finals.append(F.max(name).alias(name))
    return carried, folds, finals


def _majority_primer(built: DataFrame, primer_freq: float) -> DataFrame:
    """Keep each set's most frequent primer; fail the set below ``primer_freq``.

    One row per (set, primer) arrives here, so a set has few rows."""
    rest = [c for c in built.columns if c != "_set"]
    chosen = built.groupBy("_set").agg(
        F.min_by(F.struct(*rest), F.struct(-F.col("_n"), F.col("_primer"))).alias("_c"),
        (F.max("_n") / F.sum("_n")).alias("_freq"))
    return chosen.select("_set", "_freq", "_c.*").withColumn(
        "reason", F.when(F.col("_freq") < primer_freq, F.lit("PRIMER")))


def _value_table(keyed: DataFrame, field: str) -> DataFrame:
    return _summarise_values(
        keyed.select("_set", "_primer", fx.text(F.col(field)).alias("value")),
        ["_set", "_primer"])


def _attach_values(result, keyed, field, values_name, counts_name) -> DataFrame:
    table = _value_table(keyed, field).select(
        "_set", F.col("_primer").alias("_of"), F.col("values").alias(values_name),
        F.col("counts").cast("array<string>").alias(counts_name))
    return _beside(result, table)


def _attach_majority(result, keyed, field) -> DataFrame:
    table = _value_table(keyed, field).select(
        "_set", F.col("_primer").alias("_of"), F.array("cons").alias(field),
        F.array(F.col("freq").cast("string")).alias(f"{field}_FREQ"))
    return _beside(result, table)


def _beside(result: DataFrame, table: DataFrame) -> DataFrame:
    """Each set beside its row of ``table``; the reads without a set are one set, reads without a primer one primer."""
    same = F.col("read_id").eqNullSafe(F.col("_set")) & F.col("_primer").eqNullSafe(F.col("_of"))
    return result.join(table, same).drop("_set", "_of")


# -- alignment of sets by primer offset --------------------------------------------

def align_offset(df: DataFrame, offsets: DataFrame, barcode: str = "BARCODE",
                 primer: str = "PRIMER", mode: str = "pad", keep: str = "pass"
                 ) -> DataFrame:
    """Bring the reads of a set to one length by their primers' offsets.

    ``offsets`` has columns (primer, offset).  ``pad`` puts ``offset`` gaps in
    front; ``cut`` drops the bases before the common start.  Both fill the end
    with gaps to the longest read of the set; gaps have quality 0.  A set with
    a primer that has no offset fails as a whole, and so does a read without a set.
    """
    require_field(df, barcode, primer)
    if mode not in ("pad", "cut"):
        raise ValueError("mode must be 'pad' or 'cut'")
    table = offsets.select(F.col("primer").alias("_name"), F.col("offset").alias("_offset"))
    if mode == "cut":
        largest = offsets.agg(F.max("offset")).first()[0] or 0
        table = table.withColumn("_offset", F.col("_offset") - largest)
    keyed = (
        df.withColumns({"_set": fx.text(F.col(barcode)), "_name": fx.text(F.col(primer))})
        .join(table, "_name", "left")
        .withColumn("_placed", F.greatest(F.length("seq") + F.col("_offset"), F.lit(0)))
    )
    limits = keyed.filter(F.col("_set").isNotNull()).groupBy("_set").agg(
        F.max("_placed").alias("_width"),
        F.bool_and(F.col("_offset").isNotNull()).alias("_known"))
    joined = split_on(keyed.join(limits, "_set", "left").withColumn(
        "_known", F.coalesce("_known", F.lit(False))), F.col("_known"), keep)
    ahead = F.greatest(F.col("_offset"), F.lit(0))
    drop = F.greatest(-F.col("_offset"), F.lit(0))
    after = F.col("_width") - F.col("_placed")
    known = F.col("_known")
    new = {"seq": F.when(known, F.concat(
        F.repeat(F.lit("-"), ahead), F.substr("seq", drop + 1), F.repeat(F.lit("-"), after)
    )).otherwise(F.col("seq"))}
    if "qual" in df.columns:
        zero = F.lit(0).cast("tinyint")
        rest = F.slice("qual", drop + 1, F.greatest(F.size("qual") - drop, F.lit(0)))
        new["qual"] = F.when(known, F.concat(
            F.array_repeat(zero, ahead), rest, F.array_repeat(zero, after)
        )).otherwise(F.col("qual"))
    if keep == "fail":
        new = {}
    return joined.withColumns(new).select(
        *df.columns, *(["_pass"] if keep == "both" else []))
