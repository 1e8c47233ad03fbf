from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import SCORES, r1, with_reads
from vdjloom.operators import errors as op

_CELLS = f"""
, sets AS (SELECT barcode, count(*) AS n FROM r1 GROUP BY barcode HAVING count(*) >= 5),
e AS (SELECT r1.barcode, sets.n, unnest(range(0, length(seq))) AS pos, unnest(string_split(seq, '')) AS obs,
             unnest({SCORES}) AS q FROM r1 JOIN sets ON r1.barcode = sets.barcode),
c AS (SELECT barcode, pos, count(*) FILTER (obs = 'A') AS n_a, count(*) FILTER (obs = 'C') AS n_c,
        count(*) FILTER (obs = 'G') AS n_g, count(*) FILTER (obs = 'T') AS n_t FROM e GROUP BY barcode, pos),
w AS (SELECT *, n_a + n_c + n_g + n_t AS called, greatest(n_a, n_c, n_g, n_t) AS top FROM c),
k AS (SELECT barcode, pos, CASE WHEN called = 0 OR top / called < 0.6 THEN 'N' WHEN n_a = top THEN 'A'
        WHEN n_c = top THEN 'C' WHEN n_g = top THEN 'G' ELSE 'T' END AS ref FROM w),
b AS (SELECT e.*, ref FROM e JOIN k ON e.barcode = k.barcode AND e.pos = k.pos
      WHERE ref <> 'N' AND obs <> 'N')"""

# The same with the consensus called from summed scores.
_QUAL_CELLS = _CELLS.replace(" AS n_t FROM e", """ AS n_t,
        coalesce(sum(q) FILTER (obs = 'A'), 0) AS q_a, coalesce(sum(q) FILTER (obs = 'C'), 0) AS q_c,
        coalesce(sum(q) FILTER (obs = 'G'), 0) AS q_g, coalesce(sum(q) FILTER (obs = 'T'), 0) AS q_t FROM e""").replace(
    "greatest(n_a, n_c, n_g, n_t) AS top", "greatest(q_a, q_c, q_g, q_t) AS top").replace(
    "CASE WHEN called = 0 OR top / called < 0.6 THEN 'N' WHEN n_a = top THEN 'A'",
    """CASE WHEN called = 0 OR 2 * top <= q_a + q_c + q_g + q_t OR CASE WHEN q_a = top THEN n_a WHEN q_c = top THEN n_c
          WHEN q_g = top THEN n_g ELSE n_t END / called < 0.6 THEN 'N' WHEN q_a = top THEN 'A'""").replace(
    "WHEN n_c = top THEN 'C' WHEN n_g = top", "WHEN q_c = top THEN 'C' WHEN q_g = top")


def _rates(key: str, source: str) -> str:
    err = "CASE WHEN mismatch = 0 THEN 1e-9 ELSE mismatch / total END"
    return (f"SELECT {key}, mismatch, total, round(q_sum / total, 6) AS rep_q, "
            f"round({err}, 9) AS error, round(-10 * log10({err}), 6) AS emp_q FROM {source}")


def _sql(key: str, name: str) -> str:
    return with_reads(_CELLS + f""",
t AS (SELECT {key} AS {name}, count(*) FILTER (ref <> obs) AS mismatch, count(*) AS total,
             sum(q) AS q_sum FROM b GROUP BY {key})
{_rates(name, 't')}""")


#: The table by position as it is written: six decimals.
POSITION_TEXT = with_reads(_CELLS + """,
t AS (SELECT pos AS position, count(*) FILTER (ref <> obs) AS mismatch, count(*) AS total FROM b GROUP BY pos)
SELECT CAST(position AS VARCHAR) AS position, CAST(mismatch AS VARCHAR) AS mismatch, CAST(total AS VARCHAR) AS total,
       printf('%.6f', CASE WHEN mismatch = 0 THEN 1e-9 ELSE CAST(mismatch AS DOUBLE) / total END) AS error FROM t""")


def _show(df):
    keys = [c for c in df.columns if c not in ("mismatch", "total", "rep_q", "error", "emp_q")]
    return df.select(*keys, "mismatch", "total", F.round("rep_q", 6).alias("rep_q"),
                     F.round("error", 9).alias("error"), F.round("emp_q", 6).alias("emp_q"))


def _table(name):
    return lambda s, d: _show(op.error_profile(r1(s, d), min_count=5)[name])


_DISTANCE = "CAST(40 - list_sum(list_transform(range(1, 41), lambda i: CASE WHEN substr(a.seq, i, 1) = substr(b.seq, i, 1) THEN 1 ELSE 0 END)) AS INT)"

_SET_HIST = f"""
, sets AS (SELECT barcode FROM r1 GROUP BY barcode HAVING count(*) >= 5),
u AS (SELECT r1.barcode, seq, count(*) AS n FROM r1 JOIN sets ON r1.barcode = sets.barcode GROUP BY r1.barcode, seq),
p AS (SELECT {_DISTANCE} AS d, a.n * b.n AS n FROM u a JOIN u b ON a.barcode = b.barcode AND a.seq < b.seq
      UNION ALL SELECT 0, n * (n - 1) // 2 FROM u),
h AS (SELECT CAST(least(d * 50 // 40, 49) AS INT) AS bin, sum(n) AS pairs FROM p GROUP BY 1),
hist AS (SELECT i AS bin, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs
         FROM (SELECT CAST(unnest(range(0, 50)) AS INT) AS i) z LEFT JOIN h ON h.bin = z.i)"""

_BARCODE_HIST = """
, u AS (SELECT barcode AS seq, count(*) AS n FROM r1 GROUP BY barcode),
p AS (SELECT hamming(a.seq, b.seq) AS d, a.n * b.n AS n FROM u a JOIN u b ON a.seq < b.seq
      UNION ALL SELECT 0, n * (n - 1) // 2 FROM u),
h AS (SELECT d AS bin, sum(n) AS pairs FROM p GROUP BY d),
hist AS (SELECT i AS bin, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs
         FROM (SELECT CAST(unnest(range(0, 13)) AS INT) AS i) z LEFT JOIN h ON h.bin = z.i)"""


def _threshold(after_mode: bool, legacy: bool = False) -> str:
    start = ("(SELECT min(bin) FROM hist WHERE pairs = (SELECT max(pairs) FROM hist))"
             if after_mode else "0")
    back = "0" if legacy else "s"
    return f""",
x AS (SELECT *, {start} AS s, count(*) OVER () AS bins FROM hist),
y AS (SELECT * FROM x WHERE bin >= s AND bin < s + floor((bins - s) * 0.75)),
z AS (SELECT * FROM y WHERE pairs = (SELECT min(pairs) FROM y))
SELECT round((floor(avg(bin - s)) + max({back})) / max(bins), 6) AS threshold FROM z"""


def _rounded(df):
    return df.select(F.round("threshold", 6).alias("threshold"))


QUERIES = {
    "agg15_error_position": (_table("position"), _sql("pos", "position")),
    "agg15_error_quality": (
        lambda s, d: _show(op.error_profile(r1(s, d), min_count=5)["quality"]),
        with_reads(_CELLS + f""",
t AS (SELECT q, count(*) FILTER (ref <> obs) AS mismatch, count(*) AS total, sum(q) AS q_sum FROM b GROUP BY q),
s AS ({_rates('q', 't')})
SELECT i AS q, coalesce(mismatch, 0) AS mismatch, coalesce(total, 0) AS total, rep_q, error, emp_q
FROM (SELECT unnest(range(0, 94)) AS i) z LEFT JOIN s ON s.q = z.i"""),
    ),
    "agg15_error_nucleotide": (
        _table("nucleotide"),
        with_reads(_CELLS + f""",
l AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x),
m AS (SELECT ref, obs, count(*) AS mismatch FROM b WHERE ref <> obs GROUP BY ref, obs),
o AS (SELECT obs, count(*) AS total, sum(q) AS q_sum FROM b GROUP BY obs),
t AS (SELECT a.x AS reference, c.x AS observed, coalesce(mismatch, 0) AS mismatch, total, q_sum
      FROM l a JOIN l c ON a.x <> c.x LEFT JOIN m ON m.ref = a.x AND m.obs = c.x LEFT JOIN o ON o.obs = a.x)
{_rates('reference, observed', 't')}"""),
    ),
    "agg15_error_set": (_table("set"), _sql("n", "set_count")),
    "agg15_error_summary": (
        lambda s, d: op.error_summary(op.error_counts(r1(s, d), min_count=5)).select(
            "name", F.round("error", 6).alias("error")),
        with_reads(_CELLS + """,
a AS (SELECT count(*) FILTER (ref <> obs) AS m, count(*) AS t FROM b)
SELECT name, round(m / t, 6) AS error FROM a CROSS JOIN
  (SELECT unnest(['position', 'quality', 'nucleotide', 'set']) AS name) n"""),
    ),
    "agg15_error_position_qual": (
        lambda s, d: op.error_profile(r1(s, d), min_count=5, mode="qual")["position"].select(
            "position", "mismatch", "total"),
        with_reads(_QUAL_CELLS + """
SELECT pos AS position, count(*) FILTER (ref <> obs) AS mismatch, count(*) AS total FROM b GROUP BY pos"""),
    ),
    "agg16_set_distance_hist": (
        lambda s, d: op.set_distance_hist(r1(s, d), min_count=5),
        with_reads(_SET_HIST + "\nSELECT bin, pairs FROM hist"),
    ),
    "agg17_barcode_distance_hist": (
        lambda s, d: op.barcode_distance_hist(r1(s, d)),
        with_reads(_BARCODE_HIST + "\nSELECT bin, pairs FROM hist"),
    ),
    "agg17_barcode_distance_subsets": (
        lambda s, d: op.barcode_distance_hist(
            r1(s, d).withColumn("BARCODE", F.array(F.left(F.element_at("BARCODE", 1), F.lit(8)))),
            method="subsets"),
        with_reads(_BARCODE_HIST.replace("barcode AS seq", "left(barcode, 8) AS seq").replace(
            "GROUP BY barcode)", "GROUP BY left(barcode, 8))").replace("range(0, 13)", "range(0, 9)")
            + "\nSELECT bin, pairs FROM hist"),
    ),
    "agg18_threshold_sets": (
        lambda s, d: _rounded(op.distance_threshold(
            op.set_distance_hist(r1(s, d), min_count=5), after_mode=True)),
        with_reads(_SET_HIST + _threshold(True)),
    ),
    "agg18_threshold_sets_legacy": (
        lambda s, d: _rounded(op.distance_threshold(
            op.set_distance_hist(r1(s, d), min_count=5), after_mode=True, legacy=True)),
        with_reads(_SET_HIST + _threshold(True, True)),
    ),
    "agg18_threshold_barcodes": (
        lambda s, d: _rounded(op.distance_threshold(op.barcode_distance_hist(r1(s, d)))),
        with_reads(_BARCODE_HIST + _threshold(False)),
    ),
}
