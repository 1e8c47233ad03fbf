"""Primer sets of any size at a fixed place, as a join.

The window of a read and a primer differ in at most ``e`` bases if the primer is
to be found, so of ``e + 2`` parts of the primer at least two agree whole (of a
primer with ``e + 1`` places other than N, one place of as many).  A
part holds an equal share of the primer's places other than N and is represented
by the longest run of plain bases in it, as (begin, length, bases), or without
one by each base its first place allows.  Windows look up the same pairs of runs, so candidates come from an equi join; each is then scored by bit
arithmetic on packed bases and the best one is kept by hash aggregation.  Equal
windows are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjloom.functions import bases
from vdjloom.functions.binding import bind
from vdjloom.functions.durable import checkpoint
from vdjloom.operators.primers import finish

_CODES = "".join(bases.IUPAC)


def _words(digits: str, width: int, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{i}": bases.pack_chunk(F.substring(digits, i * bases.CHUNK + 1, bases.CHUNK))
            for i in range(-(-width // bases.CHUNK))}


def _prepared(primers: DataFrame, max_error: float, rev_primer: bool) -> tuple[DataFrame, int]:
    """Primers as hex digits padded to one width."""
    seq = F.upper("seq")
    table = primers.select(
        F.col("ord").cast("bigint").alias("_ord"), F.col("name").alias("_name"),
        (bases.revcomp(seq) if rev_primer else seq).alias("_primer")).withColumns({
            "_size": F.length("_primer"),
            "_misses": F.floor(F.length("_primer") * max_error + F.lit(1e-9)).cast("int"),
            "_named": F.length(F.translate("_primer", "N", ""))})
    bad = ~F.coalesce(F.translate("_primer", _CODES, "") == "", F.lit(False)) | (F.col("_size") == 0)
    facts = table.agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.max("_size").alias("width"),
        F.count("_ord").alias("ords"), F.count_if(F.col("_named") <= F.col("_misses")).alias("loose")).first()
    if not facts["n"]:
        raise ValueError("no primers given")
    if facts["bad"] or facts["ords"] < facts["n"]:
        raise ValueError(f"{facts['bad']} primers have no or unknown bases, {facts['n'] - facts['ords']} no ord")
    if facts["loose"]:
        raise ValueError(f"{facts['loose']} primers have no more bases other than N than max_error lets differ")
    width = facts["width"]
    digits = bases.hex_bases(F.col("_primer"), True)
    padded = F.lpad(digits, width, "0") if rev_primer else F.rpad(digits, width, "0")
    # Primers that read alike find the same windows with the same error, and the smallest ord is taken.
    row = F.struct("_ord", "_name", "_primer", "_size", "_misses", "_named")
    return checkpoint(table.groupBy(padded.alias("_pd")).agg(F.min(row).alias("_row")).select("_row.*", "_pd")), width


def _keys(table: DataFrame, width: int) -> DataFrame:
    """(_ord, _begin, _len, _begin2, _len2, _bases): what a window must hold that agrees with two parts of a primer.

    A primer of too few places for two parts has (0, 0) as its second run.
    """
    places = F.filter(F.sequence(F.lit(1), F.lit(width)),
                      lambda i: ~F.substr(F.col("_pd"), i, F.lit(1)).isin("0", "F"))
    count = F.size("_places")
    parts = table.withColumn("_places", places).withColumn("_parts", F.least(F.col("_misses") + 2, count)).select(
        "_ord", "_pd", "_places", "_parts", (F.col("_parts") > F.col("_misses") + 1).alias("_two"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    low = F.floor(F.col("_part") * count / F.col("_parts")).cast("int")
    high = F.floor((F.col("_part") + 1) * count / F.col("_parts")).cast("int")
    first, last = F.get("_places", low), F.get("_places", high - 1)
    stretch = parts.select("_ord", "_two", "_part", first.alias("_first"), F.substr("_pd", first, last - first + 1).alias("_stretch"))
    runs = F.regexp_extract_all("_stretch", F.lit("[1248]+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))
    begin = F.col("_first") + F.instr("_stretch", longest["run"]) - 1
    digit = F.conv(F.substr("_stretch", F.lit(1), F.lit(1)), 16, 10).cast("int")
    allowed = F.filter(F.array(*[F.lit(b) for b in (1, 2, 4, 8)]), lambda b: digit.bitwiseAND(b) != 0)
    single = stretch.select("_ord", "_two", "_part", F.inline(F.when(F.size(runs) > 0, F.array(F.struct(
        begin.alias("_begin"), longest["n"].alias("_len"), longest["run"].alias("_bases")))).otherwise(
        F.transform(allowed, lambda b: F.struct(
            F.col("_first").alias("_begin"), F.lit(1).alias("_len"), b.cast("string").alias("_bases"))))))
    other = single.filter("_two").select("_ord", F.col("_part").alias("_part2"), F.col("_begin").alias("_begin2"),
                                         F.col("_len").alias("_len2"), F.col("_bases").alias("_bases2"))
    pairs = single.filter("_two").join(other, "_ord").filter("_part < _part2").select(
        "_ord", "_begin", "_len", "_begin2", "_len2", F.concat("_bases", "_bases2").alias("_bases"))
    return pairs.unionByName(single.filter("NOT _two").select(
        "_ord", "_begin", "_len", F.lit(0).alias("_begin2"), F.lit(0).alias("_len2"), "_bases"))


def best_primers(windows: DataFrame, primers: DataFrame, max_error: float, rev_primer: bool, width: int
                 ) -> DataFrame:
    """``_digits`` (distinct in ``windows``) with ``_best``: struct(error, ord, size, name)."""
    keys = _keys(primers, width)
    # Places and lengths of two runs: their number depends on the width and the errors, not on how many primers there are.
    at = ["_begin", "_len", "_begin2", "_len2"]
    shapes = [list(r) for r in keys.select(*at).distinct().sort(*at).collect()]
    looked = windows.withColumns(_words("_digits", width, "_w")).withColumn("_shape", F.explode(F.lit(shapes)))
    begin, length, begin2, length2 = (F.get("_shape", F.lit(i)) for i in range(4))
    held = F.concat(F.substr("_digits", begin, length), F.substr("_digits", begin2, length2))
    looked = looked.select("*", *[F.get("_shape", F.lit(i)).alias(n) for i, n in enumerate(at)], held.alias("_bases")).drop(
        "_shape").filter(~F.col("_bases").contains("0"))
    index = keys.join(primers.select("_ord", "_name", "_size", *[
        c.alias(n) for n, c in _words("_pd", width, "_p").items()]), "_ord")
    count = -(-width // bases.CHUNK)
    matches = sum((bases.word_matches(F.col(f"_w{i}"), F.col(f"_p{i}")) for i in range(count)), F.lit(0))
    error = 1 - matches / F.col("_size")
    return looked.join(index, [*at, "_bases"]).select(
        "_digits", F.struct(error.alias("error"), F.col("_ord").alias("ord"), F.col("_size").alias("size"),
                            F.col("_name").alias("name")).alias("_hit")).filter(
        F.col("_hit.error") <= max_error).groupBy("_digits").agg(F.min("_hit").alias("_best"))


def primers_score_many(df: DataFrame, primers: DataFrame, start: int = 0, max_error: float = 0.2,
                       mode: str = "mask", rev_primer: bool = False, barcode: bool = False,
                       barcode_length: int | None = None, barcode_field: str = "BARCODE",
                       primer_field: str = "PRIMER", keep: str = "pass") -> DataFrame:
    """``primers_score`` with primers as a DataFrame (ord, name, seq) of any number of rows.

    The primer of the smallest error is taken, of equal ones that of the smallest
    ``ord`` (numbers in any type that casts to BIGINT; they should differ).  Primers
    without a name can be found too, those without bases or ord are refused, and so
    are primers whose bases other than N may all differ, as those match almost any
    read.  Null and empty sequences find nothing.
    """
    table, width = _prepared(primers, max_error, rev_primer)
    size, seq = F.length("seq"), F.col("seq")
    if rev_primer:
        window = F.substr(seq, F.lit(1), F.greatest(size - start, F.lit(0)))
        digits = F.lpad(F.right(bases.hex_bases(window, False), F.lit(width)), width, "0")
    else:
        digits = F.rpad(bases.hex_bases(F.substr(seq, F.lit(start + 1), F.lit(width)), False), width, "0")
    reads = bind(df, {"_digits": F.when(size > 0, digits)})
    windows = reads.select("_digits").filter("_digits IS NOT NULL").distinct()
    best = best_primers(windows, table, max_error, rev_primer, width)
    length = F.col("_best.size")
    end = size - start if rev_primer else F.lit(start) + length
    begin = end - length if rev_primer else F.lit(start)
    out = finish(reads.join(best, "_digits", "left"), F.col("_best").isNotNull(), begin, end, mode, rev_primer,
                 {primer_field: F.array("_best.name")}, barcode, barcode_length, barcode_field, keep)
    return out.drop("_digits", "_best")
