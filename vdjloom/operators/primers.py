"""Primers and barcodes: find a primer in each read, annotate, cut or mask.

Primers are a small mapping name -> IUPAC bases.  They become literals in the
plan: scoring at a fixed place is bit arithmetic on packed bases, with no join
and no row per (read, primer).

Modes: ``cut`` drops the primer and what lies before it, ``mask`` turns it
into N and drops what lies before it, ``trim`` keeps it and drops what lies
before it, ``tag`` leaves the sequence alone.  With ``rev_primer`` the primer
sits at the tail and "before" means after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions import bases
from vdjloom.functions.binding import bind
from vdjloom.functions.durable import few
from vdjloom.operators.filters import split_on
from vdjloom.operators.gapped import best_alignment

MODES = ("cut", "mask", "trim", "tag")
MOST_REGIONS = 1_000_000  # distinct regions with their hit that every task may hold
MAX_PRIMERS = 2000  # primers are plan literals; larger sets: primerjoin.py

Primers = dict[str, str]


def _checked(primers: Primers, rev_primer: bool) -> list[tuple[str, str]]:
    if not primers:
        raise ValueError("no primers given")
    if len(primers) > MAX_PRIMERS:
        raise ValueError(f"{len(primers)} primers; at most {MAX_PRIMERS} go into the plan, primers_score_many takes more")
    out = []
    for name, seq in primers.items():
        seq = seq.upper()
        unknown = set(seq) - set(bases.IUPAC)
        if not seq or unknown:
            raise ValueError(f"primer {name!r} has unknown bases {sorted(unknown)}")
        if rev_primer:
            table = str.maketrans(bases.COMPLEMENT_FROM, bases.COMPLEMENT_TO)
            seq = seq.translate(table)[::-1]
        out.append((name, seq))
    return out


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def finish(df: DataFrame, found: Column, start: Column, end: Column, mode: str,
            rev_primer: bool, annotate: dict[str, Column], barcode: bool,
            barcode_length: int | None, barcode_field: str, keep: str) -> DataFrame:
    """Apply the mode to [start, end) and add annotations where found."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    length = F.length("seq")
    df = bind(df, {
        "_ok": F.coalesce(found, F.lit(False)),
        "_a": F.greatest(F.least(start, length), F.lit(0)),
        "_b": F.greatest(F.least(end, length), F.lit(0))})
    seq, a, b = F.col("seq"), F.col("_a"), F.col("_b")
    masked = F.repeat(F.lit("N"), b - a)
    if rev_primer:
        spans = {"cut": (F.lit(0), a), "mask": (F.lit(0), a), "trim": (F.lit(0), b)}
    else:
        spans = {"cut": (b, length), "mask": (b, length), "trim": (a, length)}
    new = {}
    if mode != "tag":
        low, high = spans[mode]
        body = F.substr(seq, low + 1, high - low)
        if mode == "mask":
            body = F.concat(body, masked) if rev_primer else F.concat(masked, body)
        new["seq"] = body
        if "qual" in df.columns:
            rest = F.slice("qual", low + 1, high - low)
            zeros = F.array_repeat(F.lit(0).cast("tinyint"), b - a)
            if mode == "mask":
                rest = F.concat(rest, zeros) if rev_primer else F.concat(zeros, rest)
            new["qual"] = rest
    if barcode:
        if rev_primer:
            code = F.substr(seq, b + 1)
            if barcode_length:
                code = F.substr(code, F.lit(1), F.lit(barcode_length))
        else:
            code = F.substr(seq, F.lit(1), a)
            if barcode_length:
                code = F.right(code, F.lit(barcode_length))
        annotate = {**annotate, barcode_field: F.array(code)}
    ok = F.col("_ok")
    kept = length > 0
    if mode != "tag":
        kept = high > low if mode != "mask" else (high - low) + (b - a) > 0
    final = df.withColumn("_hit", ok & kept)
    changed = {k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}
    tags = {k: F.when(F.col("_hit"), v) for k, v in annotate.items()}
    if keep == "fail":
        changed = {}
        tags = {}
    return split_on(final.withColumns({**changed, **tags}), F.col("_hit"), keep).drop(
        "_ok", "_a", "_b", "_hit")


def primers_extract(df: DataFrame, length: int, start: int = 0, mode: str = "mask",
                    rev_primer: bool = False, barcode: bool = False,
                    barcode_length: int | None = None, barcode_field: str = "BARCODE",
                    primer_field: str = "PRIMER", keep: str = "pass") -> DataFrame:
    """Annotate the region [start, start + length) and apply the mode."""
    size = F.length("seq")
    if rev_primer:
        end = F.greatest(size - start, F.lit(0))
        begin = F.greatest(end - length, F.lit(0))
    else:
        begin = F.least(F.lit(start), size)
        end = F.least(F.lit(start + length), size)
    region = F.substr("seq", begin + 1, end - begin)
    return finish(df, F.lit(True), begin, end, mode, rev_primer,
                   {primer_field: F.array(region)}, barcode, barcode_length,
                   barcode_field, keep)


def score_fixed(primers: list[tuple[str, str]], rev_primer: bool, words: list[Column]
                ) -> Column:
    """struct(error, ord) of the best primer given the packed window."""
    width = max(len(p) for _, p in primers)
    options = []
    for ord_, (_, p) in enumerate(primers):
        blank = "-" * (width - len(p))
        literal = bases.pack_literal(blank + p if rev_primer else p + blank)
        matches = sum(
            (bases.word_matches(w, F.lit(v)) for w, v in zip(words, literal) if v), F.lit(0))
        options.append(F.struct(
            (1 - matches / F.lit(len(p))).alias("error"), F.lit(ord_).alias("ord")))
    return F.array_min(F.array(*options))


def primers_score(df: DataFrame, primers: Primers, start: int = 0, max_error: float = 0.2,
                  mode: str = "mask", rev_primer: bool = False, barcode: bool = False,
                  barcode_length: int | None = None, barcode_field: str = "BARCODE",
                  primer_field: str = "PRIMER", keep: str = "pass") -> DataFrame:
    """Best primer at a fixed offset by its share of mismatches.

    An ambiguity code in the primer matches the bases it stands for; a missing
    base in the read matches nothing.  The first primer wins a tie.
    """
    table = _checked(primers, rev_primer)
    width = max(len(p) for _, p in table)
    size, seq = F.length("seq"), F.col("seq")
    if rev_primer:
        window = F.substr(seq, F.lit(1), F.greatest(size - start, F.lit(0)))
        digits = F.lpad(F.right(bases.hex_bases(window, False), F.lit(width)), width, "0")
    else:
        window = F.substr(seq, F.lit(start + 1), F.lit(width))
        digits = F.rpad(bases.hex_bases(window, False), width, "0")
    count = -(-width // bases.CHUNK)
    scored = bind(bind(df, {"_digits": digits}), {
        f"_w{i}": bases.pack_chunk(F.substring("_digits", i * bases.CHUNK + 1, bases.CHUNK))
        for i in range(count)})
    words = [F.col(f"_w{i}") for i in range(count)]
    scored = bind(scored, {"_best": score_fixed(table, rev_primer, words)})
    length = _pick([len(p) for _, p in table], F.col("_best.ord"))
    end = size - start if rev_primer else F.lit(start) + length
    begin = end - length if rev_primer else F.lit(start)
    out = finish(
        scored, (size > 0) & (F.col("_best.error") <= max_error), begin, end, mode, rev_primer,
        {primer_field: F.array(_pick([n for n, _ in table], F.col("_best.ord")))},
        barcode, barcode_length, barcode_field, keep)
    return out.drop("_digits", "_best", *[f"_w{i}" for i in range(count)])


_HIT = "struct<error:double,strand:int,ord:int,begin:int,end:int>"


def _exact(region: Column, table, strand: int) -> list[Column]:
    """One hit struct (or NULL) per primer, found by regular expression."""
    hits = []
    for ord_, (_, p) in enumerate(table):
        at = F.regexp_instr(region, F.lit(bases.iupac_regex(p)))
        hits.append(F.when(at > 0, F.struct(
            F.lit(0.0).alias("error"), F.lit(strand).alias("strand"), F.lit(ord_).alias("ord"),
            (at - 1).alias("begin"), (at - 1 + len(p)).alias("end"))))
    return hits


def primers_align(df: DataFrame, primers: Primers, max_error: float = 0.2, max_len: int = 50,
                  rev_primer: bool = False, skip_rc: bool = False,
                  gap_penalty: tuple[float, float] | None = (1, 1), mode: str = "mask",
                  barcode: bool = False, barcode_length: int | None = None,
                  barcode_field: str = "BARCODE", primer_field: str = "PRIMER",
                  keep: str = "pass") -> DataFrame:
    """Find the best primer anywhere in the first (last) ``max_len`` bases.

    Regions that read alike are placed once: the distinct ones are written with
    their hit, and reads look theirs up, where they lie if there are few.  Exact
    hits are found by regular expressions.  Only regions without one go
    through the alignment helper, in Arrow batches: the whole primer is placed
    in the region, a match scores 1, a mismatch 0 and a gap costs
    ``gap_penalty`` (open, extend; None allows no gaps); the error is
    1 - score / length.  Ties go to the forward strand, the first primer and
    the leftmost place.  Without ``skip_rc`` both strands are tried, reads hit
    on the reverse strand are turned, and SEQORIENT (F or RC) is added.
    """
    table = _checked(primers, rev_primer)

    def region(seq: Column) -> Column:
        return F.right(seq, F.lit(max_len)) if rev_primer else F.left(seq, F.lit(max_len))

    names = {"_fwd": F.upper(region(F.col("seq")))}
    exact = _exact(F.col("_fwd"), table, 0)
    if not skip_rc:
        names["_rc"] = F.upper(region(bases.revcomp(F.col("seq"))))
        exact += _exact(F.col("_rc"), table, 1)
    distinct = df.select(*[c.alias(n) for n, c in names.items()]).filter(F.length("_fwd") > 0).distinct()
    prepared = bind(distinct, {"_exact": F.coalesce(*exact).cast(_HIT)})

    align = best_alignment([p for _, p in table], gap_penalty, max_len)
    missed = F.col("_exact").isNull()
    ask_fwd = F.when(missed, F.col("_fwd"))
    ask_rc = F.lit(None).cast("string") if skip_rc else F.when(missed, F.col("_rc"))
    placed = bind(prepared.withColumn("_near", align(ask_fwd, ask_rc)), {
        "_hit0": F.coalesce("_exact", F.when(~F.isnan("_near.error"), F.col("_near")))}).select(*names, "_hit0")
    if keep == "pass":  # only regions with a hit are looked up
        placed = placed.filter(F.col("_hit0.error") <= max_error)
    aligned = df.withColumns(names).join(few(placed, MOST_REGIONS), list(names), "inner" if keep == "pass" else "left")

    hit = F.col("_hit0")
    reverse = hit["strand"] == 1
    offset = F.length("seq") - F.length("_fwd") if rev_primer else F.lit(0)
    found = hit.isNotNull() & (hit["error"] <= max_error)
    annotate = {primer_field: F.array(_pick([n for n, _ in table], hit["ord"]))}
    if not skip_rc:
        annotate["SEQORIENT"] = F.array(F.when(reverse, F.lit("RC")).otherwise(F.lit("F")))
        turn = found & reverse if keep != "fail" else F.lit(False)
        aligned = aligned.withColumn(
            "seq", F.when(turn, bases.revcomp(F.col("seq"))).otherwise(F.col("seq")))
        if "qual" in df.columns:
            aligned = aligned.withColumn(
                "qual", F.when(turn, F.reverse("qual")).otherwise(F.col("qual")))
    out = finish(aligned, found, hit["begin"] + offset, hit["end"] + offset, mode, rev_primer,
                  annotate, barcode, barcode_length, barcode_field, keep)
    return out.drop("_fwd", "_rc", "_hit0")
