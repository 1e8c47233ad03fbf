from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import SCORES, r1, with_reads
from vdjloom.functions import bases, quality
from vdjloom.operators import filters as op
from vdjloom.sources import derived

_INNER = "trim(seq, 'Nn.-')"
_INNER_SCORES = (
    f"list_slice({SCORES}, length(seq) - length(ltrim(seq, 'Nn.-')) + 1, "
    f"length(seq) - length(ltrim(seq, 'Nn.-')) + length({_INNER}))"
)


def _ids(df):
    return df.select("read_id", "seq")


def _with_qual(df):
    return df.select("read_id", "seq", quality.encode(F.col("qual")).alias("qual"))


def _trim_sql(reverse: bool) -> str:
    scores = f"list_reverse({SCORES})" if reverse else SCORES
    seq = "right(seq, k)" if reverse else "left(seq, k)"
    qual = "right(qual, k)" if reverse else "left(qual, k)"
    return with_reads(f"""
, s AS (SELECT read_id, seq, qual, {scores} AS sc FROM r1),
low AS (
  SELECT read_id, seq, qual, list_filter(range(1, length(seq) + 1),
      lambda i: list_sum(list_slice(sc, i, i + 9)) < 25 * len(list_slice(sc, i, i + 9))) AS hit
  FROM s),
cut AS (SELECT *, coalesce(hit[1], length(seq) + 1) - 1 AS k FROM low)
SELECT read_id, {seq} AS seq, {qual} AS qual FROM cut WHERE k > 0""")


QUERIES = {
    "flt1_filter_length": (
        lambda s, d: _ids(op.filter_length(r1(s, d), 40)),
        with_reads(f"SELECT read_id, seq FROM r1 WHERE length({_INNER}) >= 40"),
    ),
    "flt1_filter_length_fail": (
        lambda s, d: _ids(op.filter_length(r1(s, d), 40, keep="fail")),
        with_reads(f"SELECT read_id, seq FROM r1 WHERE length({_INNER}) < 40"),
    ),
    "flt2_filter_quality": (
        lambda s, d: _ids(op.filter_quality(r1(s, d), 25)),
        with_reads(f"SELECT read_id, seq FROM r1 WHERE list_sum({_INNER_SCORES}) "
                   f">= 25 * len({_INNER_SCORES})"),
    ),
    "flt3_filter_missing": (
        lambda s, d: _ids(op.filter_missing(r1(s, d), 0)),
        with_reads(f"SELECT read_id, seq FROM r1 WHERE length({_INNER}) - "
                   f"length(translate({_INNER}, 'Nn.-', '')) <= 0"),
    ),
    "flt4_filter_repeats": (
        lambda s, d: _ids(op.filter_repeats(r1(s, d), 4)),
        with_reads("SELECT read_id, seq FROM r1 WHERE NOT "
                   f"regexp_matches({_INNER}, 'A{{5,}}|C{{5,}}|G{{5,}}|T{{5,}}')"),
    ),
    "flt5_trim_quality": (
        lambda s, d: _with_qual(op.trim_quality(r1(s, d), 25, 10)), _trim_sql(False)),
    "flt5_trim_quality_head": (
        lambda s, d: _with_qual(op.trim_quality(r1(s, d), 25, 10, reverse=True)),
        _trim_sql(True),
    ),
    "flt6_mask_quality": (
        lambda s, d: _ids(op.mask_quality(r1(s, d), 20)),
        with_reads("""
SELECT read_id, string_agg(CASE WHEN ord(q) - 33 < 20 THEN 'N' ELSE b END, '' ORDER BY i) AS seq
FROM (SELECT read_id, unnest(string_split(seq, '')) AS b, unnest(string_split(qual, '')) AS q,
             unnest(range(1, length(seq) + 1)) AS i FROM r1) x
GROUP BY read_id"""),
    ),
    "flt7_valid_sequence": (
        lambda s, d: _ids(op.valid_sequence(
            r1(s, d).withColumn("seq", F.when(
                F.col("seq_no") % 7 == 0, F.concat("seq", F.lit("*"))).otherwise(F.col("seq"))))),
        with_reads("SELECT read_id, seq FROM r1 WHERE seq_no % 7 <> 0 AND "
                   "regexp_matches(seq, '^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]+$')"),
    ),
    "flt8_first_by_id": (
        lambda s, d: op.first_by_id(
            r1(s, d).withColumn("read_id", F.element_at("BARCODE", 1))
        ).select("read_id", "seq", "seq_no"),
        with_reads("""
SELECT barcode AS read_id, seq, seq_no FROM (
  SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY seq_no) AS rn FROM r1) x
WHERE rn = 1"""),
    ),
    "flt8_first_by_id_two_files": (
        # Both mates number their records alike, as two files do: read 1 and read 2 tie in id and seq_no.
        lambda s, d: op.first_by_id(r1(s, d).unionByName(derived.mate(s, d, 2)), keep="both").groupBy("read_id").agg(
            F.count("*").alias("reads"), F.count_if("_pass").alias("firsts")),
        with_reads("SELECT read_id, count(*) AS reads, 1 AS firsts FROM reads GROUP BY read_id"),
    ),
    "prm4_revcomp": (
        lambda s, d: derived.mate(s, d, 2).select(
            "read_id", bases.revcomp(F.col("seq")).alias("seq"),
            quality.encode(F.reverse("qual")).alias("qual")),
        with_reads("SELECT read_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS seq, "
                   "reverse(qual) AS qual FROM r2"),
    ),
}
