"""Collapse duplicate reads, with missing characters as wildcards.

Reads are first reduced to distinct (sequence, uniq fields) in one pass that
also folds the copied fields, because equal sequences always end in the same
group.  Complete
sequences found their groups; a sequence with missing characters joins the
first group whose founder it agrees with.  The founder is looked up in an index
of anchors, stretches at fixed places: every complete sequence has the same
small number of them, and a sequence with missing characters probes the rarest
stretch it knows as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions import bases, quality
from vdjloom.functions import fields as fx
from vdjloom.functions.binding import let
from vdjloom.functions.durable import checkpoint, few, may_hold, stored
from vdjloom.operators.firstfit import first_fit
from vdjloom.sources.schema import require_field

MISSING = ".-N"
#: Anchors: a sequence is cut into so many stretches, once for each number.
ANCHOR_LEVELS = (2, 6)
RESIDUE_BLOCKS = 8
MOST_PLACES = 1_000_000  # order numbers of representatives that every task may hold
_SEP = "\x1f"


def collapse(df: DataFrame, max_missing: int = 0, uniq: tuple = (),
             copy: dict[str, str] | None = None, max_field: str | None = None,
             min_field: str | None = None, inner: bool = False,
             keep_missing: bool = False, output: str = "unique") -> DataFrame:
    """Unique sequences with DUPCOUNT.

    Sequences with more than ``max_missing`` missing characters are
    undetermined.  The representative has the fewest missing characters, then
    the highest ``max_field`` (lowest ``min_field``, or highest mean quality),
    then comes first.  ``copy`` reduces fields over the group.  ``output`` is
    ``unique``, ``duplicate`` or ``undetermined``; ``keep_missing`` adds the
    undetermined reads to the unique ones with DUPCOUNT 1.
    """
    copy = copy or {}
    require_field(df, *uniq, *copy, max_field, min_field)
    scope = F.btrim(F.col("seq"), F.lit(MISSING)) if inner else F.col("seq")
    keyed = df.withColumns({
        "_s": scope,
        "_u": F.concat_ws(_SEP, *[F.coalesce(fx.text(F.col(f)), F.lit("")) for f in uniq]),
        "_metric": _metric(df, max_field, min_field),
        "_no": _number(df),
        "_at": _place(),
    }).withColumn("_miss", bases.count_missing(F.col("_s"), MISSING))
    if output == "undetermined":
        return keyed.filter(F.col("_miss") > max_missing).select(*df.columns)

    determined = keyed.filter(F.col("_miss") <= max_missing)
    if output not in ("unique", "duplicate"):
        raise ValueError("output must be 'unique', 'duplicate' or 'undetermined'")
    copied = copy if output == "unique" else {}
    parts = _partial_groups(determined, copied)
    if copied or max_missing > 0:
        parts = stored(parts)
    exact = _exact_groups(parts) if copied else parts
    if max_missing > 0:
        founders = _founders(exact, max_missing)
        chosen = _representatives(exact.join(founders, ["_s", "_u"]))
    else:
        founders = exact.select("_s", "_u", F.col("_first").alias("_founder"))
        chosen = exact.select(F.col("_first").alias("_founder"), F.col("_best").alias("_rep"), F.col("_n").alias("_count"))
    chosen = checkpoint(chosen.select("_founder", "_count", F.col("_rep").alias("_no")))
    # Few reads have the order number of a representative: only they are told apart by their whole row.
    places = few(chosen.select(_leading(F.col("_no")).alias("_at")).distinct(), MOST_PLACES)
    may_be = may_hold(places, "_at", _place())
    equal = F.row_number().over(Window.partitionBy("_no").orderBy("_no"))  # reads equal in every column
    if output == "duplicate":
        reps = chosen.select("_no", F.lit(True).alias("_is_rep"))
        near = determined.filter(may_be).join(places, "_at", "left_semi").join(reps, "_no", "left").withColumn(
            "_equal", equal).filter(F.col("_is_rep").isNull() | (F.col("_equal") > 1))
        return determined.join(places, "_at", "left_anti").select(*df.columns).union(near.select(*df.columns))

    near = df.filter(may_be).withColumn("_at", _place()).join(places, "_at", "left_semi").withColumn("_no", _number(df))
    unique = near.drop("_at", *copy, "DUPCOUNT").join(chosen, "_no").withColumn("_equal", equal).filter("_equal = 1")
    for field, action in copy.items():
        reduced = _copied(determined, parts, founders, field, action)
        unique = unique.join(reduced, "_founder", "left")
    kept = [c for c in df.columns if c not in copy and c != "DUPCOUNT"]
    unique = unique.select(
        *kept, *copy, F.array(F.col("_count").cast("string")).alias("DUPCOUNT"))
    if keep_missing:
        rest = keyed.filter(F.col("_miss") > max_missing).select(
            *kept, *copy, F.array(F.lit("1")).alias("DUPCOUNT"))
        unique = unique.unionByName(rest)
    return unique


def _number(df: DataFrame) -> Column:
    """Input order that tells every read from every other.

    ``seq_no`` repeats when files are read apart and united, or when both mates
    are in one table; a hash of the whole read then sets them apart.  Only reads
    that are equal in every column share a number, and any of them will do.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    order = wide(F.coalesce(F.col("seq_no"), F.lit(-1)))
    own = wide(F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), 1))  # below 10^19
    return (order * F.lit(str(10 ** 19)).cast("decimal(20,0)") + own).cast("decimal(38,0)")


def _place() -> Column:
    """The leading part of ``_number``, for which no other column is made."""
    return F.coalesce(F.col("seq_no").cast("bigint"), F.lit(-1))


def _leading(number: Column) -> Column:
    """``_place`` of a ``_number``: its other part is below 10^19."""
    return F.floor(number / F.lit(str(10 ** 19)).cast("decimal(20,0)")).cast("bigint")


def _metric(df: DataFrame, max_field, min_field) -> Column:
    if max_field is not None:
        return fx.number(fx.text(F.col(max_field)))
    if min_field is not None:
        return -fx.number(fx.text(F.col(min_field)))
    if "qual" in df.columns:
        return F.coalesce(quality.mean(F.col("qual")), F.lit(0.0))
    return F.lit(0.0)


def _partial_groups(determined: DataFrame, copy: dict[str, str]) -> DataFrame:
    """Distinct sequences, once for each value of the fields copied by value: count, first
    read, best metric and its first read, and the copied numbers so far.

    Aggregating with the metric before without it keeps every buffer of fixed
    width, so both steps are hash aggregates with map-side combine.
    """
    values = [F.col(f).alias(f"_value_{f}") for f, action in copy.items() if action in _BY_VALUE]
    rows, folds = {}, {}
    for f, action in copy.items():
        if action in _FOLDS:
            numbers = F.filter(F.transform(f, fx.number), lambda x: x.isNotNull())
            rows |= {f"_fold_{f}": _FOLDS[action][0](numbers), f"_some_{f}": F.coalesce(F.size(f) > 0, F.lit(False))}
            folds |= {f"_fold_{f}": _FOLDS[action][1], f"_some_{f}": F.bool_or}
        elif action == "last":
            rows["_last"], folds["_last"] = F.col("_no"), F.max
        elif action not in (*_BY_VALUE, "cat"):
            raise ValueError(f"unknown copy action {action!r}")
    folded = [fold(name).alias(name) for name, fold in folds.items()]
    keys = ["_s", "_u", "_miss", *[f"_value_{f}" for f, action in copy.items() if action in _BY_VALUE]]
    by_metric = determined.select("_s", "_u", "_miss", "_metric", "_no", *values, *[
        x.alias(name) for name, x in rows.items()]).groupBy(*keys, "_metric").agg(
        F.count("*").alias("_n"), F.min("_no").alias("_no"), *folded)
    return by_metric.groupBy(*keys).agg(
        F.sum("_n").alias("_n"), F.min("_no").alias("_first"),
        F.max("_metric").alias("_metric"), F.max_by("_no", "_metric").alias("_best"), *folded)


def _added(numbers: Column) -> Column:
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x))


#: Copy actions on numbers: within a read, over reads.
_FOLDS = {"min": (F.array_min, F.min), "max": (F.array_max, F.max), "sum": (_added, F.sum)}
_BY_VALUE = ("set", "first", "last")


def _exact_groups(parts: DataFrame) -> DataFrame:
    """Distinct sequences: count, first read, best metric and its first read."""
    lowest = parts.groupBy("_s", "_u", "_miss", "_metric").agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.min("_best").alias("_best"))
    return lowest.groupBy("_s", "_u", "_miss").agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"),
        F.max("_metric").alias("_metric"), F.max_by("_best", "_metric").alias("_best"))


def _representatives(groups: DataFrame) -> DataFrame:
    """(_founder, _rep, _count): members with the fewest missing characters
    compete for the representative, all members count."""
    lowest = groups.groupBy("_founder", "_miss", "_metric").agg(
        F.sum("_n").alias("_n"), F.min("_best").alias("_best"))
    by_level = lowest.groupBy("_founder", "_miss").agg(
        F.sum("_n").alias("_n"), F.max_by("_best", "_metric").alias("_best"))
    return by_level.groupBy("_founder").agg(
        F.sum("_n").alias("_count"), F.min_by("_best", "_miss").alias("_rep"))


def _copied(determined: DataFrame, parts: DataFrame, founders: DataFrame, field: str, action: str) -> DataFrame:
    """(_founder, field) reduced over all members of the group."""
    if action == "cat":
        values = determined.select("_s", "_u", "_miss", "_no", F.posexplode(field).alias("_at", "_v"))
        return values.withColumn("_o", F.struct("_miss", "_no", "_at")).join(founders, ["_s", "_u"]).groupBy("_founder").agg(
            F.array(F.array_join(F.sort_array(F.collect_list(F.struct("_o", "_v")))["_v"], "")).alias(field))
    grouped = parts.join(founders, ["_s", "_u"])
    if action in _FOLDS:
        return grouped.filter(f"`_some_{field}`").groupBy("_founder").agg(
            F.array(fx.compact(_FOLDS[action][1](f"_fold_{field}"))).alias(field))
    values = grouped.select("*", F.posexplode(f"_value_{field}").alias("_at", "_v"))
    order = F.struct("_miss", "_last" if action == "last" else "_first", "_at")
    if action == "set":
        return values.groupBy("_founder", "_v").agg(F.min(order).alias("_o")).groupBy("_founder").agg(
            F.sort_array(F.collect_list(F.struct("_o", "_v")))["_v"].alias(field))
    pick = F.min_by if action == "first" else F.max_by
    return values.groupBy("_founder").agg(F.array(pick("_v", order)).alias(field))


# -- wildcard groups -------------------------------------------------------------

# One non-zero digit per nucleotide code, missing characters are 0.
_CODES = "ACGTRYSWKMBDHVU"
_DIGITS = "123456789ABCDEF"


def _words(seq: Column) -> Column:
    digits = F.translate(F.upper(seq), _CODES + "N.-", _DIGITS + "000")
    return let(digits, lambda d: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(d) - 1) / bases.CHUNK).cast("int")),
        lambda i: bases.pack_chunk(F.substr(d, i * bases.CHUNK + 1, F.lit(bases.CHUNK)))))


def _occupied(word: Column) -> Column:
    """The lowest bit of every digit that is not zero."""
    return (
        word.bitwiseOR(F.shiftright(word, 1)).bitwiseOR(F.shiftright(word, 2))
        .bitwiseOR(F.shiftright(word, 3)).bitwiseAND(F.lit(int("1" * bases.CHUNK, 16)))
    )


def _agree(a: Column, b: Column) -> Column:
    """Equal at every place where both sequences have a base."""
    clash = F.zip_with(a, b, lambda x, y: _occupied(x).bitwiseAND(_occupied(y)).bitwiseAND(
        _occupied(x.bitwiseXOR(y))))
    return ~F.exists(clash, lambda w: w != 0)


def _blocks(length: Column, count: int) -> Column:
    """(start, len) of ``count`` nearly equal blocks of a sequence."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(
        (F.floor(i * length / count) + 1).cast("int").alias("start"),
        (F.floor((i + 1) * length / count) - F.floor(i * length / count)).cast("int")
        .alias("len")))
    return F.filter(edges, lambda b: b["len"] > 0)


def _complete(seq: Column, block: Column) -> Column:
    return ~F.substr(seq, block["start"], block["len"]).rlike("[N.-]")


def anchor_levels(max_missing: int) -> list[int]:
    """Numbers of stretches that sequences are cut into; by the last one, a stretch is whole whatever is missing."""
    return [*ANCHOR_LEVELS, *([max_missing + 1] if max_missing >= max(ANCHOR_LEVELS) else [])]


def _anchors(seq: Column, levels: list[int], whole: bool) -> Column:
    """Keys of the stretches of ``seq`` (a row with _u and _len); with ``whole`` of those without missing characters."""
    keys = []
    for n in levels:
        cut = _blocks(F.col("_len"), n)
        if whole:
            cut = F.filter(cut, lambda b: _complete(seq, b))
        keys.append(_named(cut, seq, n))
    return F.concat(*keys)


def _named(cut: Column, seq: Column, level: int) -> Column:
    return F.transform(cut, lambda b: F.xxhash64(
        "_u", "_len", F.lit(level), b["start"], F.substr(seq, b["start"], b["len"])))


def _founders(exact: DataFrame, max_missing: int) -> DataFrame:
    """(_s, _u, _founder) for every distinct sequence; the founder is named by
    the number of its first read."""
    exact = exact.withColumn("_len", F.length("_s"))
    clean = exact.filter(F.col("_miss") == 0)
    levels, seq = anchor_levels(max_missing), F.col("_s")
    known = _anchors(seq, levels[:len(ANCHOR_LEVELS)], whole=True)
    if len(levels) > len(ANCHOR_LEVELS):
        known = let(known, lambda keys: F.when(F.size(keys) > 0, keys).otherwise(_anchors(seq, levels[-1:], whole=True)))
    vague = exact.filter(F.col("_miss") > 0).select(
        "_s", "_u", "_len", "_miss", "_first", _words(seq).alias("_w"), known.alias("_keys"))

    # Of the complete sequences' anchors, those that some other sequence asks for.
    asked = vague.select("_s", "_u", F.explode("_keys").alias("_key"))
    posted = checkpoint(clean.select(
        "_u", "_len", F.col("_first").alias("_clean"), _words(seq).alias("_cw"),
        F.explode(_anchors(seq, levels, whole=False)).alias("_key")).join(asked.select("_key").distinct(), "_key"))
    counts = posted.groupBy("_key").agg(F.count("*").alias("_n"))
    # A stretch that no complete sequence has is the rarest: the sequence agrees with none.
    rarest = F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key"))
    probes = asked.join(counts, "_key", "left").groupBy("_s", "_u").agg(rarest.alias("_key"))
    hits = (
        vague.drop("_keys").join(probes, ["_s", "_u"]).join(posted, ["_key", "_u", "_len"])
        .filter(_agree(F.col("_w"), F.col("_cw")))
        .groupBy("_s", "_u").agg(F.min("_clean").alias("_founder"))
    )
    # Nothing known at all: any complete sequence of the length will do.
    classes = clean.groupBy("_u", "_len").agg(F.min("_first").alias("_founder"))
    blank = vague.filter(F.size("_keys") == 0).join(classes, ["_u", "_len"]).select("_s", "_u", "_founder")
    resolved = checkpoint(
        vague.drop("_keys").join(hits.unionByName(blank), ["_s", "_u"], "left"))
    found = clean.select("_s", "_u", F.col("_first").alias("_founder")).union(
        resolved.filter("_founder IS NOT NULL").select("_s", "_u", "_founder"))
    residue = resolved.filter("_founder IS NULL")
    if not residue.limit(1).count():
        return found
    return found.union(_residue_founders(residue))


def _residue_founders(residue: DataFrame) -> DataFrame:
    """First fit among sequences that agree with no complete one.

    Keys are the complete blocks.  Two sequences that both know more than half
    of the blocks share one; when a (length, fields) class has a sequence that
    knows less, the whole class also shares one common key.
    """
    blocks = residue.withColumn("_blocks", _blocks(F.col("_len"), RESIDUE_BLOCKS))
    known = blocks.withColumn("_known", F.filter(
        F.col("_blocks"), lambda b: _complete(F.col("_s"), b)))
    little = F.size("_known") * 2 <= F.size("_blocks")
    classes = known.groupBy("_u", "_len").agg(F.bool_or(little).alias("_vague"))
    common = F.when(F.col("_vague"), F.array(F.lit("*"))).otherwise(
        F.array().cast("array<string>"))
    named = F.transform(F.col("_known"), lambda b: F.concat_ws(
        ":", b["start"], F.substr("_s", b["start"], b["len"])))
    keyed = known.join(classes, ["_u", "_len"]).withColumn(
        "keys", F.transform(F.concat(named, common), lambda k: F.concat_ws(
            _SEP, F.col("_len"), F.col("_u"), k)))
    ordered = checkpoint(
        keyed.select("_s", "_u", "_first", "keys", F.col("_w").alias("data"), "_miss")
        .orderBy("_miss", "_first").withColumn("rank", F.monotonically_increasing_id()))
    fit = first_fit(ordered, _agree)
    names = ordered.select(F.col("rank").alias("founder"), F.col("_first").alias("_founder"))
    return ordered.select("_s", "_u", "rank").join(fit, "rank").join(names, "founder").select(
        "_s", "_u", "_founder")


def count_outputs(df: DataFrame, **options) -> DataFrame:
    """Number of reads per output of ``collapse``."""
    kinds = [
        collapse(df, output=k, **options).select(F.lit(k).alias("kind"))
        for k in ("unique", "duplicate", "undetermined")]
    return kinds[0].union(kinds[1]).union(kinds[2]).groupBy("kind").agg(
        F.count("*").alias("reads"))
