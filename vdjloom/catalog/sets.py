from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import SCORES, r1, with_reads
from vdjloom.functions import fields as fx
from vdjloom.functions import quality
from vdjloom.operators import sets as op


def _bases(group: str, source: str = "r1") -> str:
    """CTEs exploding reads to positions and counting bases per group."""
    return f"""
, e AS (SELECT {group}, unnest(range(1, length(seq) + 1)) AS pos,
               unnest(string_split(seq, '')) AS base, unnest({SCORES}) AS q FROM {source}),
c AS (SELECT {group}, pos, count(*) AS n,
        count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c,
        count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t,
        count(*) FILTER (base IN ('-', '.')) AS gaps,
        coalesce(sum(q) FILTER (base = 'A'), 0) AS q_a, coalesce(sum(q) FILTER (base = 'C'), 0) AS q_c,
        coalesce(sum(q) FILTER (base = 'G'), 0) AS q_g, coalesce(sum(q) FILTER (base = 'T'), 0) AS q_t
      FROM e GROUP BY {group}, pos)"""


def _freq_calls(group: str) -> str:
    return f""",
w AS (SELECT *, n_a + n_c + n_g + n_t AS called, greatest(n_a, n_c, n_g, n_t) AS top FROM c),
k AS (SELECT *, CASE WHEN called = 0 OR top / called < 0.6 THEN 'N' WHEN n_a = top THEN 'A'
        WHEN n_c = top THEN 'C' WHEN n_g = top THEN 'G' ELSE 'T' END AS b FROM w),
f AS (SELECT {group}, string_agg(b, '' ORDER BY pos) AS seq,
        coalesce(sum(called - top) FILTER (b <> 'N') / sum(called) FILTER (b <> 'N'), 0) AS error,
        coalesce(1 - sum(n_a*(n_a-1) + n_c*(n_c-1) + n_g*(n_g-1) + n_t*(n_t-1))
                 / nullif(sum(called * (called - 1)), 0), 0) AS diversity
      FROM k GROUP BY {group})"""


def _qual_calls(group: str) -> str:
    return f""",
w AS (SELECT *, n_a + n_c + n_g + n_t AS called, greatest(q_a, q_c, q_g, q_t) AS top,
             q_a + q_c + q_g + q_t AS tot FROM c),
x AS (SELECT *, CASE WHEN q_a = top THEN 'A' WHEN q_c = top THEN 'C' WHEN q_g = top THEN 'G'
                ELSE 'T' END AS win FROM w),
y AS (SELECT *, CASE win WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g ELSE n_t END AS votes,
             least(top - (tot - top), 90) AS score FROM x),
k AS (SELECT *, called > 0 AND votes / called >= 0.6 AND score >= 20 AND score > 0 AS ok FROM y),
f AS (SELECT {group}, string_agg(CASE WHEN ok THEN win ELSE 'N' END, '' ORDER BY pos) AS seq,
        string_agg(chr(CAST(CASE WHEN ok THEN score ELSE 0 END AS INT) + 33), '' ORDER BY pos) AS qual,
        coalesce(sum(called - votes) FILTER (ok) / sum(called) FILTER (ok), 0) AS error
      FROM k GROUP BY {group})"""


def _offsets(spark):
    return spark.createDataFrame([("IGH", 0), ("IGK", 2), ("IGL", 5)], "primer string, offset int")


_OFFSET_SQL = ", o AS (SELECT * FROM (VALUES ('IGH', 0), ('IGK', 2), ('IGL', 5)) t(primer, off))"


def _aligned(df):
    return df.select("read_id", "seq", quality.encode(F.col("qual")).alias("qual"))


def _full_consensus(s, d):
    return op.build_consensus(
        r1(s, d), min_count=2, min_qual=20, primer_field="PRIMER", primer_freq=0.4,
        max_gap=0.5, max_error=0.1, copy=[("SAMPLE", "set")],
    ).select(
        "read_id", "seq", quality.encode(F.col("qual")).alias("qual"),
        *[fx.text(F.col(f)).alias(f.lower()) for f in (
            "CONSCOUNT", "PRCONS", "PRFREQ", "SAMPLE", "SAMPLE_COUNT")])


QUERIES = {
    "agg1_build_consensus": (
        _full_consensus,
        with_reads(f"""
, p AS (SELECT barcode, primer, count(*) AS n FROM r1 GROUP BY barcode, primer),
m AS (SELECT barcode, primer, n, freq FROM (
   SELECT *, n / sum(n) OVER (PARTITION BY barcode) AS freq,
          row_number() OVER (PARTITION BY barcode ORDER BY n DESC, primer) AS rn FROM p) z
   WHERE rn = 1 AND freq >= 0.4 AND n >= 2),
kept AS (SELECT r1.* FROM r1 JOIN m ON r1.barcode = m.barcode AND r1.primer = m.primer)
{_bases('barcode', 'kept')}{_qual_calls('barcode')},
s AS (SELECT barcode, string_agg(sample, ',' ORDER BY sample) AS sample,
             string_agg(CAST(n AS VARCHAR), ',' ORDER BY sample) AS sample_count
      FROM (SELECT barcode, sample, count(*) AS n FROM kept GROUP BY barcode, sample) z GROUP BY barcode)
SELECT m.barcode AS read_id, f.seq, f.qual, CAST(m.n AS VARCHAR) AS conscount, m.primer AS prcons,
       CAST(CAST(m.freq AS DOUBLE) AS VARCHAR) AS prfreq, s.sample, s.sample_count
FROM m JOIN f ON m.barcode = f.barcode JOIN s ON m.barcode = s.barcode
WHERE f.error <= 0.1"""),
    ),
    "agg2_field_consensus": (
        lambda s, d: op.field_consensus(r1(s, d), "BARCODE", "PRIMER").select(
            "set", F.array_join("values", ",").alias("vals"),
            F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"),
            "cons", F.round("freq", 6).alias("freq")),
        with_reads("""
, p AS (SELECT barcode, primer, count(*) AS n FROM r1 GROUP BY barcode, primer)
SELECT barcode AS set, string_agg(primer, ',' ORDER BY primer) AS vals,
       string_agg(CAST(n AS VARCHAR), ',' ORDER BY primer) AS counts,
       first(primer ORDER BY n DESC, primer) AS cons, round(max(n) / sum(n), 6) AS freq
FROM p GROUP BY barcode"""),
    ),
    "agg3_primer_filter": (
        lambda s, d: op.build_consensus(
            r1(s, d), primer_field="PRIMER", primer_freq=0.5, use_quality=False, keep="both",
        ).select("read_id", "reason", F.element_at("CONSCOUNT", 1).alias("conscount"),
                 F.element_at("PRCONS", 1).alias("prcons")),
        with_reads("""
, p AS (SELECT barcode, primer, count(*) AS n FROM r1 GROUP BY barcode, primer)
SELECT barcode AS read_id, CASE WHEN freq < 0.5 THEN 'PRIMER' END AS reason,
       CAST(n AS VARCHAR) AS conscount, primer AS prcons
FROM (SELECT *, n / sum(n) OVER (PARTITION BY barcode) AS freq,
             row_number() OVER (PARTITION BY barcode ORDER BY n DESC, primer) AS rn FROM p) z
WHERE rn = 1"""),
    ),
    "agg3_primer_list": (
        lambda s, d: op.build_consensus(
            r1(s, d), primer_field="PRIMER", use_quality=False,
        ).select("read_id", fx.text(F.col("PRIMER")).alias("primer"),
                 fx.text(F.col("PRCOUNT")).alias("prcount")),
        with_reads("""
, p AS (SELECT barcode, primer, count(*) AS n FROM r1 GROUP BY barcode, primer)
SELECT barcode AS read_id, string_agg(primer, ',' ORDER BY primer) AS primer,
       string_agg(CAST(n AS VARCHAR), ',' ORDER BY primer) AS prcount
FROM p GROUP BY barcode"""),
    ),
    "agg4_set_size_gate": (
        lambda s, d: op.build_consensus(
            r1(s, d), min_count=9, use_quality=False, keep="both",
        ).select("read_id", "reason", F.element_at("CONSCOUNT", 1).alias("conscount")),
        with_reads("""
SELECT barcode AS read_id, CASE WHEN count(*) < 9 THEN 'CONSCOUNT' END AS reason,
       CAST(count(*) AS VARCHAR) AS conscount FROM r1 GROUP BY barcode"""),
    ),
    "agg5_freq_consensus": (
        lambda s, d: op.build_consensus(r1(s, d), use_quality=False).select("read_id", "seq"),
        with_reads(_bases("barcode") + _freq_calls("barcode")
                   + "\nSELECT barcode AS read_id, seq FROM f"),
    ),
    "agg6_qual_consensus": (
        lambda s, d: op.build_consensus(r1(s, d), min_qual=20).select(
            "read_id", "seq", quality.encode(F.col("qual")).alias("qual")),
        with_reads(_bases("barcode") + _qual_calls("barcode")
                   + "\nSELECT barcode AS read_id, seq, qual FROM f"),
    ),
    "agg6_qual_consensus_dependent": (
        # The highest score of a base instead of the sum.
        lambda s, d: op.build_consensus(r1(s, d), min_qual=20, dependent=True).select(
            "read_id", "seq", quality.encode(F.col("qual")).alias("qual")),
        with_reads(_bases("barcode").replace("sum(q)", "max(q)")
                   + _qual_calls("barcode").replace("least(top - (tot - top), 90)", "top")
                   + "\nSELECT barcode AS read_id, seq, qual FROM f"),
    ),
    "agg7_gap_positions": (
        lambda s, d: op.build_consensus(
            op.align_offset(r1(s, d), _offsets(s)), max_gap=0.3, use_quality=False,
        ).select("read_id", "seq"),
        with_reads(_OFFSET_SQL + """
, u AS (SELECT r1.*, off, length(seq) + off AS placed FROM r1 JOIN o ON r1.primer = o.primer),
a AS (SELECT barcode, qual, rpad(concat(repeat('-', off), seq),
        CAST(max(placed) OVER (PARTITION BY barcode) AS INT), '-') AS seq FROM u),
e AS (SELECT barcode, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS base FROM a),
c AS (SELECT barcode, pos, count(*) AS n,
        count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c,
        count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t,
        count(*) FILTER (base = '-') AS gaps FROM e GROUP BY barcode, pos
      HAVING count(*) FILTER (base = '-') / count(*) <= 0.3)""" + _freq_calls("barcode")
                   + "\nSELECT barcode AS read_id, seq FROM f"),
    ),
    "agg8_set_diversity": (
        lambda s, d: op.set_diversity(r1(s, d)).select(
            "set", F.round("diversity", 6).alias("diversity")),
        with_reads(_bases("barcode") + _freq_calls("barcode")
                   + "\nSELECT barcode AS set, round(diversity, 6) AS diversity FROM f"),
    ),
    "agg9_set_error": (
        lambda s, d: op.set_error(r1(s, d)).select("set", F.round("error", 6).alias("error")),
        with_reads(_bases("barcode") + _freq_calls("barcode")
                   + "\nSELECT barcode AS set, round(error, 6) AS error FROM f"),
    ),
    "agg10_copy_fields": (
        lambda s, d: op.build_consensus(
            r1(s, d).withColumns({
                "PART": F.slice(F.split("read_id", "[.]"), 3, 1),
                "SUPP": F.slice(F.split("read_id", "[.]"), 4, 1),
                "LINE": F.slice(F.split("read_id", "[.]"), 2, 1)}),
            use_quality=False,
            copy=[("PART", "sum"), ("SUPP", "max"), ("LINE", "min"), ("PRIMER", "majority"),
                  ("SAMPLE", "set")],
        ).select("read_id", *[fx.text(F.col(f)).alias(f.lower()) for f in (
            "PART", "SUPP", "LINE", "PRIMER", "PRIMER_FREQ", "SAMPLE", "SAMPLE_COUNT")]),
        with_reads("""
, v AS (SELECT *, list_transform(string_split(read_id, '.'), lambda x: CAST(x AS BIGINT)) AS x FROM r1),
g AS (SELECT barcode, CAST(CAST(sum(x[3]) AS BIGINT) AS VARCHAR) AS part, CAST(max(x[4]) AS VARCHAR) AS supp,
             CAST(min(x[2]) AS VARCHAR) AS line FROM v GROUP BY barcode),
p AS (SELECT barcode, primer, count(*) AS n FROM r1 GROUP BY barcode, primer),
pm AS (SELECT barcode, first(primer ORDER BY n DESC, primer) AS primer,
              CAST(CAST(max(n) / sum(n) AS DOUBLE) AS VARCHAR) AS primer_freq FROM p GROUP BY barcode),
s AS (SELECT barcode, string_agg(sample, ',' ORDER BY sample) AS sample,
             string_agg(CAST(n AS VARCHAR), ',' ORDER BY sample) AS sample_count
      FROM (SELECT barcode, sample, count(*) AS n FROM r1 GROUP BY barcode, sample) z GROUP BY barcode)
SELECT g.barcode AS read_id, part, supp, line, primer, primer_freq, sample, sample_count
FROM g JOIN pm ON g.barcode = pm.barcode JOIN s ON g.barcode = s.barcode"""),
    ),
    "agg10_copy_without_set": (
        lambda s, d: op.build_consensus(
            r1(s, d).withColumn("BARCODE", F.when(F.col("seq_no") % 10 != 0, F.col("BARCODE"))), min_count=3,
            copy=[("SAMPLE", "set"), ("PRIMER", "majority")], keep="both",
        ).select("read_id", "reason", *[fx.text(F.col(f)).alias(f.lower()) for f in ("CONSCOUNT", "SAMPLE", "SAMPLE_COUNT", "PRIMER")]),
        with_reads("""
, g AS (SELECT CASE WHEN seq_no % 10 <> 0 THEN barcode END AS b, sample, primer FROM r1),
n AS (SELECT b, count(*) AS n FROM g GROUP BY b),
p AS (SELECT b, first(primer ORDER BY n DESC, primer) AS primer FROM (
        SELECT b, primer, count(*) AS n FROM g GROUP BY b, primer) y GROUP BY b),
s AS (SELECT b, string_agg(sample, ',' ORDER BY sample) AS sample, string_agg(CAST(n AS VARCHAR), ',' ORDER BY sample) AS sample_count
      FROM (SELECT b, sample, count(*) AS n FROM g GROUP BY b, sample) z GROUP BY b)
SELECT n.b AS read_id, CASE WHEN n.b IS NULL THEN 'BARCODE' WHEN n < 3 THEN 'CONSCOUNT' END AS reason,
       CAST(n AS VARCHAR) AS conscount, sample, sample_count, primer
FROM n JOIN p ON n.b IS NOT DISTINCT FROM p.b JOIN s ON n.b IS NOT DISTINCT FROM s.b"""),
    ),
    "jn9_align_offset_pad": (
        lambda s, d: _aligned(op.align_offset(r1(s, d), _offsets(s))),
        with_reads(_OFFSET_SQL + """
, u AS (SELECT r1.*, off, length(seq) + off AS placed FROM r1 JOIN o ON r1.primer = o.primer),
m AS (SELECT *, CAST(max(placed) OVER (PARTITION BY barcode) AS INT) AS width FROM u)
SELECT read_id, rpad(concat(repeat('-', off), seq), width, '-') AS seq,
       rpad(concat(repeat('!', off), qual), width, '!') AS qual FROM m"""),
    ),
    "jn9_align_offset_cut": (
        lambda s, d: _aligned(op.align_offset(
            r1(s, d), _offsets(s).filter("primer <> 'IGK'"), mode="cut")),
        with_reads(_OFFSET_SQL + """
, u AS (SELECT r1.*, 5 - off AS cut FROM r1 LEFT JOIN (SELECT * FROM o WHERE primer <> 'IGK') o
        ON r1.primer = o.primer),
m AS (SELECT *, CAST(max(length(seq) - cut) OVER (PARTITION BY barcode) AS INT) AS width,
             bool_and(cut IS NOT NULL) OVER (PARTITION BY barcode) AS known FROM u)
SELECT read_id, rpad(substr(seq, cut + 1), width, '-') AS seq,
       rpad(substr(qual, cut + 1), width, '!') AS qual FROM m WHERE known"""),
    ),
}
