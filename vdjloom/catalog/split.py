from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import MATES, r1, r2, with_reads
from vdjloom.functions import fields as fx
from vdjloom.functions import ordering
from vdjloom.operators import split as op


def _with_line(df):
    """A numeric field of few values and one of many, from the read id."""
    return df.withColumns({
        "LINE": F.slice(F.split("read_id", "[.]"), 2, 1),
        "PKEY": F.slice(F.split("read_id", "[.]"), 3, 1)})


def _greedy(key: str, limit: int, numeric: bool) -> str:
    """Greedy parts by recursion over the ordered distinct values."""
    k = f"CAST({key} AS DOUBLE)" if numeric else key
    return f"""
, t AS (SELECT *, {k} AS k FROM r1),
g AS (SELECT k, count(*) AS n, row_number() OVER (ORDER BY k) AS i FROM t GROUP BY k),
f AS (SELECT k, n, i, 1 AS part, n AS used FROM g WHERE i = 1
      UNION ALL
      SELECT g.k, g.n, g.i, CASE WHEN f.used + g.n > {limit} THEN f.part + 1 ELSE f.part END,
             CASE WHEN f.used + g.n > {limit} THEN g.n ELSE f.used + g.n END
      FROM f JOIN g ON g.i = f.i + 1)
SELECT t.read_id, CAST(f.part AS BIGINT) AS part FROM t JOIN f ON t.k = f.k"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH reads", "WITH RECURSIVE reads", 1)




def _two_values(spark, sf_dir):
    """Both mates with a field of several values, which is absent in every seventh read."""
    both = r1(spark, sf_dir).withColumns({"mate": F.lit(1), "TAG": F.concat("SAMPLE", F.array(F.lit("x")))}).unionByName(
        r2(spark, sf_dir).withColumns({"mate": F.lit(2), "TAG": F.concat("PRIMER", F.array(F.lit("x")))}))
    return both.withColumn("TAG", F.when(F.col("seq_no") % 7 != 0, F.col("TAG")))


QUERIES = {
    "win1_split_count": (
        lambda s, d: op.split_count(r1(s, d), 1000).select("read_id", "part"),
        with_reads("SELECT read_id, (row_number() OVER (ORDER BY seq_no) - 1) // 1000 + 1 AS part FROM r1"),
    ),
    "win2_split_group": (
        lambda s, d: op.split_group(r1(s, d), "SAMPLE").select("read_id", "part"),
        with_reads("SELECT read_id, sample AS part FROM r1"),
    ),
    "win3_split_threshold": (
        lambda s, d: op.mark_threshold(_with_line(r1(s, d)), "PKEY", 100).select("read_id", "part"),
        with_reads("SELECT read_id, CASE WHEN CAST(string_split(read_id, '.')[3] AS INT) < 100 "
                   "THEN 'under' ELSE 'atleast' END AS part FROM r1"),
    ),
    "win3_split_threshold_atleast": (
        lambda s, d: op.split_threshold(_with_line(r1(s, d)), "PKEY", 100)["atleast"].select(
            "read_id", "seq"),
        with_reads("SELECT read_id, seq FROM r1 WHERE CAST(string_split(read_id, '.')[3] AS INT) >= 100"),
    ),
    "win4_sample_reads": (
        lambda s, d: op.sample_reads(r1(s, d), [100, 2500], seed=7).select("read_id", "sample_size"),
        with_reads("""
, o AS (SELECT read_id, row_number() OVER (ORDER BY md5(concat('7:', read_id)), read_id) AS rn FROM r1)
SELECT read_id, n AS sample_size FROM o JOIN (VALUES (100), (2500)) v(n) ON rn <= n"""),
    ),
    "win5_sample_per_group": (
        lambda s, d: op.sample_reads(r1(s, d), [50], field="PRIMER", seed=7).select(
            "read_id", fx.text(F.col("PRIMER")).alias("primer")),
        with_reads("""
SELECT read_id, primer FROM (
  SELECT read_id, primer, row_number() OVER (PARTITION BY primer
         ORDER BY md5(concat('7:', read_id)), read_id) AS rn FROM r1) x WHERE rn <= 50"""),
    ),
    "win6_sample_pairs": (
        lambda s, d: (lambda p: p[0].select("read_id", "seq", F.lit(1).alias("mate")).union(
            p[1].select("read_id", "seq", F.lit(2).alias("mate"))))(
            op.sample_pairs(r1(s, d), r2(s, d), [200], seed=3)),
        with_reads(MATES + """
, k AS (SELECT * FROM mates ORDER BY md5(concat('3:', read_id)), read_id LIMIT 200)
SELECT read_id, unnest([s1, s2]) AS seq, unnest([1, 2]) AS mate FROM k"""),
    ),
    "win7_sort_text": (
        lambda s, d: op.split_count(ordering.renumber(
            op.sort_reads(r1(s, d), "BARCODE"), "seq_no"), 500).select("read_id", "part"),
        with_reads("SELECT read_id, (row_number() OVER (ORDER BY barcode, seq_no) - 1) // 500 + 1 AS part FROM r1"),
    ),
    "win7_sort_numeric": (
        lambda s, d: op.split_count(ordering.renumber(
            op.sort_reads(_with_line(r1(s, d)), "PKEY", numeric=True), "seq_no"), 500).select("read_id", "part"),
        with_reads("SELECT read_id, (row_number() OVER (ORDER BY CAST(string_split(read_id, '.')[3] "
                   "AS DOUBLE), seq_no) - 1) // 500 + 1 AS part FROM r1"),
    ),
    "win8_sort_partition_numeric": (
        lambda s, d: op.sort_reads(_with_line(r1(s, d)), "PKEY", numeric=True, max_count=200
                                   ).select("read_id", "part"),
        _recursive(with_reads(_greedy("string_split(read_id, '.')[3]", 200, True))),
    ),
    "win8_sort_partition_text": (
        lambda s, d: op.sort_reads(r1(s, d), "BARCODE", max_count=100).select("read_id", "part"),
        _recursive(with_reads(_greedy("barcode", 100, False))),
    ),
    "win9_sample_values": (
        lambda s, d: op.sample_reads(
            r1(s, d), [300], field="PRIMER", values=["IGH", "IGL"], seed=5).select(
            "read_id", fx.text(F.col("PRIMER")).alias("primer")),
        with_reads("""
SELECT read_id, primer FROM r1 WHERE primer IN ('IGH', 'IGL')
ORDER BY md5(concat('5:', read_id)), read_id LIMIT 300"""),
    ),
    "jn8_select_list": (
        lambda s, d: op.select_reads(r1(s, d), "PRIMER", ["IGH", "IGK"]).select("read_id", "seq"),
        with_reads("SELECT read_id, seq FROM r1 WHERE primer IN ('IGH', 'IGK')"),
    ),
    "jn8_select_table": (
        lambda s, d: op.select_reads(
            r1(s, d).withColumn("PRIMER", F.concat("PRIMER", "SAMPLE")), "PRIMER",
            s.read.parquet(f"{d}/supplier.parquet").filter("s_suppkey < 2").select(
                F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")).alias("PRIMER")),
            negate=True).select("read_id", "seq"),
        with_reads("""
SELECT read_id, seq FROM r1 WHERE sample NOT IN (
  SELECT concat('S', CAST(s_suppkey % 3 AS VARCHAR)) FROM supplier WHERE s_suppkey < 2)"""),
    ),
    "jn8_select_both_mates": (
        # Mate 1 has other values than mate 2 under the same read id.
        lambda s, d: op.select_reads(
            _two_values(s, d), "TAG", s.createDataFrame([("S0",), ("IGL",)], "v string")).select("read_id", "mate", "seq"),
        with_reads("""
SELECT read_id, mate, seq FROM reads
WHERE CASE WHEN mate = 1 THEN sample = 'S0' ELSE primer = 'IGL' END AND seq_no % 7 <> 0"""),
    ),
    "jn8_select_table_negate": (
        lambda s, d: op.select_reads(
            _two_values(s, d), "TAG", s.createDataFrame([("S0",), ("IGL",)], "v string"), negate=True).select("read_id", "mate", "seq"),
        with_reads("""
SELECT read_id, mate, seq FROM reads
WHERE NOT (CASE WHEN mate = 1 THEN sample = 'S0' ELSE primer = 'IGL' END AND seq_no % 7 <> 0)"""),
    ),
    "jn8_select_barcodes": (
        lambda s, d: op.select_reads(
            r1(s, d), "BARCODE",
            r2(s, d).filter(F.col("seq").contains("N")).select(F.element_at("BARCODE", 1))
        ).select("read_id", "seq"),
        with_reads("""
, m AS (SELECT *, bool_or(mate = 2 AND contains(seq, 'N')) OVER (PARTITION BY barcode) AS hit FROM reads)
SELECT read_id, seq FROM m WHERE mate = 1 AND hit"""),
    ),
}
