from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog import cells as cell_queries
from vdjloom.catalog.common import r1, r2, with_reads
from vdjloom.operators import cells, checks as op, filters, split


def _edited(df):
    """A changed copy: some reads gone, some altered, some renamed."""
    kept = df.filter("seq_no % 11 <> 0")
    return kept.withColumns({
        "seq": F.when(F.col("seq_no") % 7 == 0, F.concat("seq", F.lit("A"))).otherwise(F.col("seq")),
        "qual": F.when(F.col("seq_no") % 5 == 0, F.reverse("qual")).otherwise(F.col("qual")),
        "SAMPLE": F.when(F.col("seq_no") % 3 == 0, F.array(F.lit("Z"))).otherwise(F.col("SAMPLE")),
        "read_id": F.when(F.col("seq_no") % 13 == 0, F.concat("read_id", F.lit("x"))).otherwise(
            F.col("read_id"))})


def _steps(s, d):
    a, b = r1(s, d), r2(s, d)
    a1, b1 = filters.filter_missing(a, 0), filters.filter_missing(b, 0)
    a2, b2 = filters.filter_length(a1, 40), filters.filter_length(b1, 40)
    return op.step_stats([("missing", 1, a, a1), ("missing", 2, b, b1)]).withColumn(
        "idx", F.lit(1)).union(op.step_stats([("length", 1, a1, a2), ("length", 2, b1, b2)])
                               .withColumn("idx", F.lit(2)))


def _rows(df):
    return df.select("BARCODE", "SAMPLE", "PRIMER").select(
        *[F.element_at(c, 1).alias(c.lower()) for c in ("BARCODE", "SAMPLE", "PRIMER")])


def _labelled(df, label):
    return df.withColumn("CLUSTER", F.array(label))


_STATS = """
, i AS (SELECT mate, trim(seq, 'Nn.-') AS seq FROM reads),
s AS (SELECT 1 AS idx, 'missing' AS step, mate AS lane, count(*) AS before,
             count(*) FILTER (NOT contains(seq, 'N')) AS remaining FROM i GROUP BY mate
      UNION ALL
      SELECT 2, 'length', mate, count(*) FILTER (NOT contains(seq, 'N')),
             count(*) FILTER (NOT contains(seq, 'N') AND length(seq) >= 40) FROM i GROUP BY mate)"""

_EDITED = """
, e AS (SELECT CASE WHEN seq_no % 13 = 0 THEN concat(read_id, 'x') ELSE read_id END AS read_id, seq_no,
        CASE WHEN seq_no % 7 = 0 THEN concat(seq, 'A') ELSE seq END AS seq,
        CASE WHEN seq_no % 5 = 0 THEN reverse(qual) ELSE qual END AS qual,
        CASE WHEN seq_no % 3 = 0 THEN 'Z' ELSE sample END AS sample, barcode, primer
      FROM r1 WHERE seq_no % 11 <> 0)"""

QUERIES = {
    "sta1_step_stats": (
        lambda s, d: _steps(s, d),
        with_reads(_STATS + "SELECT idx, step, lane, before, before - remaining AS failed, remaining FROM s"),
    ),
    "sta2_retention": (
        lambda s, d: op.retention(_steps(s, d)).select(
            "idx", "step", "before", "remaining", F.round("step_retention", 6).alias("step_retention"),
            F.round("cumulative", 6).alias("cumulative")),
        with_reads(_STATS + """,
t AS (SELECT idx, step, sum(before) AS before, sum(remaining) AS remaining FROM s GROUP BY idx, step)
SELECT idx, step, CAST(before AS BIGINT) AS before, CAST(remaining AS BIGINT) AS remaining,
       round(remaining / before, 6) AS step_retention,
       round(remaining / first_value(before) OVER (ORDER BY idx), 6) AS cumulative FROM t"""),
    ),
    "sta3_lane_totals": (
        lambda s, d: op.lane_totals(_steps(s, d)),
        with_reads(_STATS + """
SELECT idx, step, CAST(sum(before) AS BIGINT) AS before, CAST(sum(before - remaining) AS BIGINT) AS failed,
       CAST(sum(remaining) AS BIGINT) AS remaining FROM s GROUP BY idx, step"""),
    ),
    "val1_compare_records": (
        lambda s, d: op.compare_records(r1(s, d), _edited(r1(s, d))),
        with_reads(_EDITED + """
SELECT count(a.read_id) AS records_a, count(e.read_id) AS records_b, 0 AS duplicate_ids_a,
       0 AS duplicate_ids_b, count(*) FILTER (e.read_id IS NULL) AS missing,
       count(*) FILTER (a.read_id IS NULL) AS additional,
       count(*) FILTER (a.seq <> e.seq) AS sequence_differs,
       count(*) FILTER (a.qual <> e.qual) AS quality_differs,
       count(*) FILTER (a.sample <> e.sample) AS annotations_differ,
       count(*) FILTER (a.seq = e.seq AND a.qual = e.qual AND a.sample = e.sample) AS identical
FROM r1 a FULL JOIN e ON a.read_id = e.read_id"""),
    ),
    "val2_compare_tables": (
        lambda s, d: op.compare_tables(_rows(r1(s, d)), _rows(r2(s, d))),
        with_reads("""
, a AS (SELECT barcode, sample, primer, count(*) AS n FROM r1 GROUP BY ALL),
b AS (SELECT barcode, sample, primer, count(*) AS n FROM r2 GROUP BY ALL),
j AS (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (barcode, sample, primer))
SELECT CAST(sum(least(x, y)) AS BIGINT) AS identical, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS only_a,
       CAST(sum(greatest(y - x, 0)) AS BIGINT) AS only_b FROM j"""),
    ),
    "val3_same_partition": (
        lambda s, d: op.same_partition(
            _labelled(r1(s, d), F.element_at("BARCODE", 1)),
            _labelled(r1(s, d), F.when(F.col("seq_no") % 5 == 0, F.lit("odd")).otherwise(
                F.md5(F.element_at("BARCODE", 1))))),
        with_reads("""
, x AS (SELECT read_id, barcode AS a, CASE WHEN seq_no % 5 = 0 THEN 'odd' ELSE md5(barcode) END AS b FROM r1),
y AS (SELECT min(read_id) OVER (PARTITION BY a) AS la, min(read_id) OVER (PARTITION BY b) AS lb FROM x)
SELECT count(DISTINCT la) AS clusters_a, count(DISTINCT lb) AS clusters_b,
       count(*) FILTER (la <> lb) AS moved, count(*) FILTER (la <> lb) = 0 AS same FROM y"""),
    ),
    "val4_check_sidecar": (
        lambda s, d: op.check_sidecar(
            cells.from_contigs(cell_queries._fasta(s, d), cell_queries._table(s, d)),
            cells.merge_annotations([(cell_queries._table(s, d), "contig_id")]),
            ["chain", "v_gene", "gone"]),
        with_reads("""
, t AS (SELECT seq_no % 17 <> 0 AS side, seq_no % 17 <> 0 AND seq_no % 11 <> 0 AND seq_no % 13 <> 0 AS rec FROM r1)
SELECT count(*) FILTER (side) AS "rows", count(*) FILTER (side) AS distinct_ids, 0 AS duplicate_ids,
       count(*) FILTER (side AND NOT rec) AS rows_without_record,
       count(*) FILTER (rec AND NOT side) AS records_without_row, 1 AS columns_missing FROM t"""),
    ),
    "val5_compare_fields": (
        lambda s, d: op.compare_fields(
            r1(s, d).select("read_id", "seq", F.element_at("SAMPLE", 1).alias("sample")),
            _edited(r1(s, d)).select("read_id", "seq", F.element_at("SAMPLE", 1).alias("sample")),
            ["seq", "sample"], "read_id"),
        with_reads(_EDITED + """,
j AS (SELECT a.seq <> e.seq AS s, a.sample <> e.sample AS m FROM r1 a JOIN e ON a.read_id = e.read_id)
SELECT 'seq' AS field, count(*) FILTER (s) AS mismatches FROM j
UNION ALL SELECT 'sample', count(*) FILTER (m) FROM j"""),
    ),
    "val6_check_sample": (
        lambda s, d: op.check_sample(
            split.sample_reads(r1(s, d), [200], seed=1).select("read_id", "seq"),
            r1(s, d).select("read_id", "seq")),
        "SELECT 200 AS records, 0 AS duplicates, 0 AS not_in_source",
    ),
    "val7_compare_parts": (
        lambda s, d: op.compare_parts(
            split.split_group(r1(s, d), "BARCODE").select("read_id", "seq", "part"),
            split.split_group(r1(s, d), "BARCODE").filter("seq_no % 50 <> 0").select(
                "read_id", "seq", F.md5("part").alias("part"))),
        with_reads("""
, g AS (SELECT barcode, count(*) FILTER (seq_no % 50 = 0) AS lost, count(*) AS n FROM r1 GROUP BY barcode)
SELECT count(*) AS parts_a, count(*) FILTER (lost < n) AS parts_b, count(*) FILTER (lost = 0) AS matched FROM g"""),
    ),
    "set1_common_rows": (
        lambda s, d: op.common_rows(_rows(r1(s, d)), _rows(r2(s, d))),
        with_reads("SELECT barcode, sample, primer FROM r1 INTERSECT ALL SELECT barcode, sample, primer FROM r2"),
    ),
    "set1_extra_rows": (
        lambda s, d: op.extra_rows(_rows(r1(s, d)), _rows(r2(s, d))),
        with_reads("SELECT barcode, sample, primer FROM r1 EXCEPT ALL SELECT barcode, sample, primer FROM r2"),
    ),
}
