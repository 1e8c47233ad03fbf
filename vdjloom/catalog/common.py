"""Shared SQL of the registered queries: the derived reads as CTEs."""

from __future__ import annotations

from vdjloom.sources import derived

READS = """
SELECT read_id, seq_no, barcode, sample, primer, mate,
       CASE WHEN mate = 1 THEN r1 ELSE r2 END AS seq,
       translate(substr(concat(h, h), 1, 40), '0123456789abcdef', '+-/13579;=?ACEGI') AS qual
FROM (
 SELECT read_id, seq_no, barcode, sample, primer, mate, h,
        concat(substr(a, 1, p - 1), b, substr(a, p + 1)) AS r1,
        concat(substr(z, 1, p - 1), b, substr(z, p + 1)) AS r2
 FROM (
  SELECT k AS read_id, n AS seq_no,
         translate(substr(md5(concat('b', g)), 1, 12), '0123456789abcdef', 'ACGTACGTACGTACGT') AS barcode,
         concat('S', CAST(l_suppkey % 3 AS VARCHAR)) AS sample,
         concat('IG', substr('HKL', CAST(l_suppkey % 3 AS INT) + 1, 1)) AS primer,
         m AS mate, md5(concat('q', k)) AS h,
         substr(f, 1, 40) AS a,
         reverse(translate(substr(f, 25, 40), 'ACGT', 'TGCA')) AS z,
         CAST(l_partkey % 40 AS INT) + 1 AS p,
         substr('ACGTN', CAST(l_partkey % 5 AS INT) + 1, 1) AS b
  FROM (
   SELECT *, translate(concat(md5(concat('f', g)), md5(concat('g', g))),
                       '0123456789abcdef', 'ACGTACGTACGTACGT') AS f
   FROM (
    SELECT l_partkey, l_suppkey, min(l_returnflag) AS rf,
           concat(CAST(l_orderkey AS VARCHAR), '.', CAST(l_linenumber AS VARCHAR), '.',
                  CAST(l_partkey AS VARCHAR), '.', CAST(l_suppkey AS VARCHAR)) AS k,
           ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS n,
           CAST(l_orderkey % 4999 AS VARCHAR) AS g
    FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey
   ) d
  ) t
  CROSS JOIN (SELECT 1 AS m UNION ALL SELECT 2 AS m) mm
  WHERE NOT (m = 2 AND rf = 'R')
 ) u
) v
"""

# Scores of a Phred+33 text as a list.
SCORES = "list_transform(string_split(qual, ''), lambda c: ord(c) - 33)"


def with_reads(body: str) -> str:
    """``body`` after the CTEs reads, r1 and r2; it may open with more CTEs."""
    return (
        f"WITH reads AS MATERIALIZED ({READS}),\n"
        "r1 AS (SELECT * FROM reads WHERE mate = 1),\n"
        f"r2 AS (SELECT * FROM reads WHERE mate = 2)\n{body}"
    )


#: Read and mate side by side, found by one grouping: r1 joined with r2 on read_id.
MATES = """
, mates AS (SELECT read_id, min(barcode) AS barcode, min(sample) AS sample,
       min(seq) FILTER (WHERE mate = 1) AS s1, min(seq) FILTER (WHERE mate = 2) AS s2,
       min(qual) FILTER (WHERE mate = 1) AS q1, min(qual) FILTER (WHERE mate = 2) AS q2
  FROM reads GROUP BY read_id HAVING count(DISTINCT mate) = 2)"""


def r1(spark, sf_dir):
    return derived.mate(spark, sf_dir, 1)


def r2(spark, sf_dir):
    return derived.mate(spark, sf_dir, 2)


def both(spark, sf_dir):
    """r1 and r2 in one table, made in one pass over lineitem."""
    return derived.reads(spark, sf_dir).drop("mate")
