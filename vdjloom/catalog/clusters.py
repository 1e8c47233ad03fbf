from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, with_reads
from vdjloom.functions import fields as fx
from vdjloom.operators import clusters as op


def _short(df, n):
    """Barcodes cut to ``n`` bases, so that near ones are common."""
    return df.withColumn("BARCODE", F.array(F.left(F.element_at("BARCODE", 1), F.lit(n))))


def _show(df):
    return df.select("read_id", fx.text(F.col("CLUSTER")).alias("cluster"))


def _lossy(df):
    """Every fifth barcode without its third base."""
    whole = F.element_at("BARCODE", 1)
    lost = F.concat(F.left(whole, F.lit(2)), F.substr(whole, F.lit(4)))
    return df.withColumn("BARCODE", F.when(F.col("seq_no") % 5 == 0, F.array(lost)).otherwise(F.col("BARCODE")))


def _barcode_sql(barcode: str, prefix: str) -> str:
    """First fit by falling count among barcodes one edit apart; such two are equal after one deletion in each."""
    return with_reads(f"""
, a AS (SELECT read_id, {barcode} AS s FROM r1),
c AS (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) AS k FROM a GROUP BY s),
d AS (SELECT k, s, unnest(list_concat([s], list_transform(range(1, length(s) + 1),
        lambda i: concat(substr(s, 1, i - 1), substr(s, i + 1))))) AS part FROM c),
e AS (SELECT DISTINCT f.k AS f, g.k AS g FROM d f JOIN d g ON f.part = g.part AND f.k < g.k WHERE levenshtein(f.s, g.s) <= 1),
x AS (SELECT g AS k, list(f) AS prev, row_number() OVER (ORDER BY g) AS i FROM e GROUP BY g),
w AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS mem UNION ALL
      SELECT x.i, CASE WHEN len(list_filter(x.prev, lambda q: NOT list_contains(w.mem, q))) > 0 THEN list_append(w.mem, x.k)
                       ELSE w.mem END FROM w JOIN x ON x.i = w.i + 1),
l AS (SELECT mem FROM w ORDER BY i DESC LIMIT 1),
o AS (SELECT c.s, c.k, coalesce((SELECT list_min(list_filter(x.prev, lambda q: NOT list_contains(l.mem, q))) FROM l), c.k) AS o
      FROM c LEFT JOIN x ON x.k = c.k),
p AS (SELECT o, row_number() OVER (ORDER BY o) AS n FROM o GROUP BY o)
SELECT a.read_id, concat('{prefix}', CAST(p.n AS VARCHAR)) AS cluster FROM a JOIN o ON a.s = o.s JOIN p ON p.o = o.o""").replace(
        "WITH reads", "WITH RECURSIVE reads", 1)


QUERIES = {
    "agg19_cluster_barcodes": (
        lambda s, d: _show(op.cluster_barcodes(r1(s, d), ident=0.9)), _barcode_sql("barcode", "")),
    "agg19_cluster_barcodes_lost_base": (
        lambda s, d: _show(op.cluster_barcodes(_lossy(r1(s, d)), ident=0.9)),
        _barcode_sql("CASE WHEN seq_no % 5 = 0 THEN concat(left(barcode, 2), substr(barcode, 4)) ELSE barcode END", "")),
    "agg19_cluster_barcodes_short": (
        lambda s, d: _show(op.cluster_barcodes(_short(r1(s, d), 6), ident=0.8, prefix="U")), _barcode_sql("left(barcode, 6)", "U")),
    "agg20_cluster_all": (
        lambda s, d: _show(op.cluster_all(r1(s, d), ident=0.9)), None),
    "agg21_cluster_sets": (
        lambda s, d: _show(op.cluster_sets(r1(s, d), ident=0.95)), None),
    "agg22_count_reads": (
        lambda s, d: r1(s, d).agg(
            F.count("*").alias("reads"),
            F.count_distinct(fx.text(F.col("BARCODE"))).alias("barcodes")),
        with_reads("SELECT count(*) AS reads, count(DISTINCT barcode) AS barcodes FROM r1"),
    ),
}
