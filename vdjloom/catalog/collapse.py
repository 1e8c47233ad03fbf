from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import SCORES, both, r1, with_reads
from vdjloom.functions import fields as fx
from vdjloom.operators import collapse as op
from vdjloom.operators import split
from vdjloom.plans import flagship

_CLEAN = "c AS (SELECT *, list_sum({s}) / 40.0 AS m FROM r1 WHERE NOT contains(seq, 'N'))".format(
    s=SCORES)
_RANKED = f""", {_CLEAN},
k AS (SELECT *, count(*) OVER (PARTITION BY seq, sample) AS n,
             row_number() OVER (PARTITION BY seq, sample ORDER BY m DESC, seq_no) AS rn FROM c)"""


def _numbers(df):
    return df.withColumns({
        "LINE": F.slice(F.split("read_id", "[.]"), 2, 1),
        "SUPP": F.slice(F.split("read_id", "[.]"), 4, 1)})


def _show(df, *fields):
    return df.select("read_id", "seq", *[fx.text(F.col(f)).alias(f.lower()) for f in fields])


def _missing_sql(scope: str, group: str, show: str) -> str:
    """Wildcard collapse of reads with at most one N: complete sequences found their groups, a sequence
    with an N joins the first it agrees with, and what is left is taken one by one in order."""
    thirds = "(SELECT unnest([1, 14, 27]) AS t)"
    masked = "concat(substr({a}.s, 1, {b}.p - 1), 'N', substr({a}.s, {b}.p + 1))"
    return with_reads(f"""
, v AS (SELECT *, {scope} AS s, {group} AS u, list_sum({SCORES}) / 40.0 AS m, instr({scope}, 'N') AS p FROM r1),
e AS (SELECT s, u, p, min(seq_no) AS f FROM v GROUP BY s, u, p),
h AS (SELECT a.s, a.u, min(c.f) AS g FROM e a JOIN e c ON a.p > 0 AND c.p = 0 AND c.u = a.u AND length(c.s) = length(a.s)
        AND CASE WHEN a.p > 20 THEN substr(a.s, 1, 20) = substr(c.s, 1, 20) ELSE substr(a.s, 21) = substr(c.s, 21) END
        AND concat(substr(c.s, 1, a.p - 1), 'N', substr(c.s, a.p + 1)) = a.s GROUP BY a.s, a.u),
r AS (SELECT e.*, row_number() OVER (ORDER BY e.f) AS k FROM e ANTI JOIN h ON e.s = h.s AND e.u = h.u WHERE e.p > 0),
d AS (SELECT r.*, t, substr(s, t, 13) AS part FROM r, {thirds} x WHERE p NOT BETWEEN t AND t + 12),
n AS (SELECT DISTINCT a.k AS a, b.k AS b FROM d a JOIN d b ON a.u = b.u AND a.t = b.t AND a.part = b.part AND a.k < b.k
      WHERE length(a.s) = length(b.s) AND {masked.format(a='a', b='b')} = {masked.format(a='b', b='a')}),
x AS (SELECT b AS k, list(a) AS prev, row_number() OVER (ORDER BY b) AS i FROM n GROUP BY b),
w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS mem UNION ALL
      SELECT x.i, CASE WHEN len(list_filter(x.prev, lambda q: NOT list_contains(w.mem, q))) > 0 THEN list_append(w.mem, x.k)
                       ELSE w.mem END FROM w JOIN x ON x.i = w.i + 1),
l AS (SELECT mem FROM w ORDER BY i DESC LIMIT 1),
y AS (SELECT r.s, r.u, coalesce(b.f, r.f) AS g FROM r LEFT JOIN x ON x.k = r.k LEFT JOIN r b
        ON b.k = (SELECT list_min(list_filter(x.prev, lambda q: NOT list_contains(l.mem, q))) FROM l)),
z AS (SELECT s, u, f AS g FROM e WHERE p = 0 UNION ALL SELECT s, u, g FROM h UNION ALL SELECT s, u, g FROM y),
j AS (SELECT v.*, z.g, CASE WHEN p > 0 THEN 1 ELSE 0 END AS miss FROM v JOIN z ON v.s = z.s AND v.u = z.u),
k AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY miss, m DESC, seq_no) AS rn FROM j){show}""").replace(
        "WITH reads", "WITH RECURSIVE reads", 1)


QUERIES = {
    "flagship_unique_consensus": (
        flagship.unique_consensus,
        with_reads(f"""
, q AS (SELECT *, length(seq) - length(ltrim(seq, 'Nn.-')) AS lead, length(trim(seq, 'Nn.-')) AS len FROM r1),
e AS (SELECT barcode, seq_no, unnest(range(1, length(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS base
      FROM q WHERE list_sum(list_slice({SCORES}, lead + 1, lead + len)) >= 24 * len),
c AS (SELECT barcode, pos, count(*) AS n, min(seq_no) AS first,
        count(*) FILTER (base = 'A') AS n_a, count(*) FILTER (base = 'C') AS n_c,
        count(*) FILTER (base = 'G') AS n_g, count(*) FILTER (base = 'T') AS n_t
      FROM e GROUP BY barcode, pos),
w AS (SELECT *, n_a + n_c + n_g + n_t AS called, greatest(n_a, n_c, n_g, n_t) AS top FROM c),
b AS (SELECT *, CASE WHEN called = 0 OR top / called < 0.6 THEN 'N' WHEN n_a = top THEN 'A'
        WHEN n_c = top THEN 'C' WHEN n_g = top THEN 'G' ELSE 'T' END AS b FROM w),
f AS (SELECT barcode, min(first) AS first, max(n) AS n, string_agg(b, '' ORDER BY pos) AS seq FROM b GROUP BY barcode),
g AS (SELECT first(barcode ORDER BY first) AS id, sum(n) AS n, count(*) AS dups FROM f
      GROUP BY seq, CASE WHEN contains(seq, 'N') THEN barcode END)
SELECT id AS "ID", CAST(CAST(n AS BIGINT) AS VARCHAR) AS "CONSCOUNT", CAST(dups AS VARCHAR) AS "DUPCOUNT"
FROM g WHERE n >= 2"""),
    ),
    "agg11_collapse": (
        lambda s, d: _show(op.collapse(
            _numbers(r1(s, d)), uniq=("SAMPLE",), copy={"SUPP": "sum", "LINE": "max"}),
            "SAMPLE", "SUPP", "LINE", "DUPCOUNT"),
        with_reads(_RANKED + """,
a AS (SELECT seq, sample, sum(CAST(string_split(read_id, '.')[4] AS BIGINT)) AS supp,
             max(CAST(string_split(read_id, '.')[2] AS BIGINT)) AS line FROM c GROUP BY seq, sample)
SELECT k.read_id, k.seq, k.sample, CAST(CAST(a.supp AS BIGINT) AS VARCHAR) AS supp,
       CAST(a.line AS VARCHAR) AS line, CAST(k.n AS VARCHAR) AS dupcount
FROM k JOIN a ON k.seq = a.seq AND k.sample = a.sample WHERE rn = 1"""),
    ),
    "agg11_collapse_set": (
        lambda s, d: _show(op.collapse(
            r1(s, d), copy={"SAMPLE": "set", "PRIMER": "first"}, max_field=None),
            "SAMPLE", "PRIMER", "DUPCOUNT"),
        with_reads(f"""
, {_CLEAN},
k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY m DESC, seq_no) AS rn FROM c),
s AS (SELECT seq, string_agg(sample, ',' ORDER BY f) AS sample FROM (
        SELECT seq, sample, min(seq_no) AS f FROM c GROUP BY seq, sample) z GROUP BY seq),
g AS (SELECT seq, count(*) AS n, first(primer ORDER BY seq_no) AS primer FROM c GROUP BY seq)
SELECT k.read_id, k.seq, s.sample, g.primer, CAST(g.n AS VARCHAR) AS dupcount
FROM k JOIN s ON k.seq = s.seq JOIN g ON k.seq = g.seq WHERE rn = 1"""),
    ),
    "agg13_representative_max": (
        lambda s, d: _show(op.collapse(_numbers(r1(s, d)), max_field="SUPP"), "DUPCOUNT"),
        with_reads("""
, k AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n, row_number() OVER (PARTITION BY seq
          ORDER BY CAST(string_split(read_id, '.')[4] AS INT) DESC, seq_no) AS rn
        FROM r1 WHERE NOT contains(seq, 'N'))
SELECT read_id, seq, CAST(n AS VARCHAR) AS dupcount FROM k WHERE rn = 1"""),
    ),
    "agg13_representative_min": (
        lambda s, d: _show(op.collapse(_numbers(r1(s, d)), min_field="SUPP"), "DUPCOUNT"),
        with_reads("""
, k AS (SELECT *, count(*) OVER (PARTITION BY seq) AS n, row_number() OVER (PARTITION BY seq
          ORDER BY CAST(string_split(read_id, '.')[4] AS INT), seq_no) AS rn
        FROM r1 WHERE NOT contains(seq, 'N'))
SELECT read_id, seq, CAST(n AS VARCHAR) AS dupcount FROM k WHERE rn = 1"""),
    ),
    "agg14_duplicates": (
        lambda s, d: op.collapse(r1(s, d), uniq=("SAMPLE",), output="duplicate").select(
            "read_id", "seq"),
        with_reads(_RANKED + "\nSELECT read_id, seq FROM k WHERE rn > 1"),
    ),
    "agg14_undetermined": (
        lambda s, d: op.collapse(r1(s, d), output="undetermined").select("read_id", "seq"),
        with_reads("SELECT read_id, seq FROM r1 WHERE contains(seq, 'N')"),
    ),
    "set4_keep_missing": (
        lambda s, d: _show(op.collapse(r1(s, d), uniq=("SAMPLE",), keep_missing=True), "DUPCOUNT"),
        with_reads(_RANKED + """
SELECT read_id, seq, CAST(n AS VARCHAR) AS dupcount FROM k WHERE rn = 1
UNION ALL SELECT read_id, seq, '1' FROM r1 WHERE contains(seq, 'N')"""),
    ),
    "agg12_collapse_missing": (
        lambda s, d: _show(op.collapse(r1(s, d), max_missing=1, uniq=("SAMPLE",)),
                           "SAMPLE", "DUPCOUNT"),
        _missing_sql("seq", "sample", "\nSELECT read_id, seq, sample, CAST(n AS VARCHAR) AS dupcount FROM k WHERE rn = 1"),
    ),
    "agg12_collapse_missing_inner": (
        lambda s, d: _show(op.collapse(r1(s, d), max_missing=5, inner=True,
                                       copy={"SAMPLE": "set"}), "SAMPLE", "DUPCOUNT"),
        _missing_sql("trim(seq, 'N')", "''", """,
o AS (SELECT g, string_agg(sample, ',' ORDER BY o) AS sample FROM (
        SELECT g, sample, min(miss * 1000000000000000000 + seq_no) AS o FROM k GROUP BY g, sample) q GROUP BY g)
SELECT k.read_id, k.seq, o.sample, CAST(k.n AS VARCHAR) AS dupcount FROM k JOIN o ON k.g = o.g WHERE rn = 1"""),
    ),
    "agg11_collapse_both_mates": (
        lambda s, d: op.collapse(both(s, d)).select(
            "seq", fx.text(F.col("DUPCOUNT")).alias("dupcount")),
        with_reads("SELECT seq, CAST(count(*) AS VARCHAR) AS dupcount FROM reads "
                   "WHERE NOT contains(seq, 'N') GROUP BY seq"),
    ),
    "agg14_duplicates_both_mates": (
        lambda s, d: op.collapse(both(s, d), output="duplicate")
        .groupBy("seq").agg(F.count("*").alias("reads")),
        with_reads("SELECT seq, count(*) - 1 AS reads FROM reads "
                   "WHERE NOT contains(seq, 'N') GROUP BY seq HAVING count(*) > 1"),
    ),
    "agg11_threshold_after_collapse": (
        lambda s, d: split.split_threshold(
            op.collapse(r1(s, d)), "DUPCOUNT", 2)["atleast"].select(
            "seq", fx.text(F.col("DUPCOUNT")).alias("dupcount")),
        with_reads("SELECT seq, CAST(count(*) AS VARCHAR) AS dupcount FROM r1 "
                   "WHERE NOT contains(seq, 'N') GROUP BY seq HAVING count(*) >= 2"),
    ),
}
