from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, with_reads
from vdjloom.functions import fields as fx
from vdjloom.operators import headers as op
from vdjloom.operators import sets


def _show(df, *fields):
    return df.select("read_id", *[fx.text(F.col(f)).alias(f.lower()) for f in fields])


def _counts(df):
    """A multi-valued numeric field taken from the read id's numbers."""
    return df.withColumn("COUNTS", F.slice(F.split("read_id", "[.]"), 2, 3))


_PART = "string_split(read_id, '.')"

QUERIES = {
    "hdr1_add_fields": (
        lambda s, d: _show(op.add_fields(r1(s, d), {"RUN": "A1", "SAMPLE": "X"}),
                           "RUN", "SAMPLE"),
        with_reads("SELECT read_id, 'A1' AS run, concat(sample, ',X') AS sample FROM r1"),
    ),
    "hdr2_collapse_fields": (
        lambda s, d: (lambda df: df.select(
            "read_id",
            *[fx.text(fx.collapse(F.col("COUNTS"), a)).alias(f"v_{a}") for a in fx.ACTIONS],
            fx.text(fx.collapse(F.transform("COUNTS", lambda x: (
                x.cast("double") / 7).cast("string")), "sum")).alias("v_ratio"),
        ))(_counts(r1(s, d))),
        with_reads(f"""
, p AS (SELECT read_id, list_slice({_PART}, 2, 4) AS c,
               list_transform(list_slice({_PART}, 2, 4), lambda x: CAST(x AS DOUBLE)) AS v FROM r1)
SELECT read_id, printf('%.12g', list_min(v)) AS v_min, printf('%.12g', list_max(v)) AS v_max,
       printf('%.12g', list_sum(v)) AS v_sum, c[1] AS v_first, c[3] AS v_last,
       CASE WHEN c[1] = c[2] AND c[2] = c[3] THEN c[1]
            WHEN c[1] = c[2] OR c[2] = c[3] THEN concat(c[1], ',', c[3])
            WHEN c[1] = c[3] THEN concat(c[1], ',', c[2])
            ELSE array_to_string(c, ',') END AS v_set,
       array_to_string(c, '') AS v_cat,
       printf('%.12g', v[1] / 7 + v[2] / 7 + v[3] / 7) AS v_ratio
FROM p"""),
    ),
    "hdr3_copy_fields": (
        lambda s, d: _show(op.copy_fields(r1(s, d), {"SAMPLE": "PRIMER", "BARCODE": "UMI"}),
                           "SAMPLE", "PRIMER", "UMI"),
        with_reads("SELECT read_id, sample, concat(primer, ',', sample) AS primer, "
                   "barcode AS umi FROM r1"),
    ),
    "hdr4_delete_fields": (
        lambda s, d: op.delete_fields(r1(s, d), ["SAMPLE"]).select(
            "read_id", op.flatten_header(op.delete_fields(r1(s, d), ["SAMPLE"])).alias("header")),
        with_reads("SELECT read_id, concat(read_id, '|BARCODE=', barcode, '|PRIMER=', primer) "
                   "AS header FROM r1"),
    ),
    "hdr5_expand_field": (
        lambda s, d: _show(op.expand_field(_counts(r1(s, d)), "COUNTS"),
                           "COUNTS1", "COUNTS2", "COUNTS3"),
        with_reads(f"SELECT read_id, {_PART}[2] AS counts1, {_PART}[3] AS counts2, "
                   f"{_PART}[4] AS counts3 FROM r1"),
    ),
    "hdr6_merge_fields": (
        lambda s, d: _show(op.merge_fields(r1(s, d), ["SAMPLE", "PRIMER"], "MERGED",
                                           delete=True), "MERGED"),
        with_reads("SELECT read_id, concat(sample, ',', primer) AS merged FROM r1"),
    ),
    "hdr7_rename_fields": (
        lambda s, d: _show(op.rename_fields(r1(s, d), {"SAMPLE": "LIB", "PRIMER": "BARCODE"},
                                            [None, "last"]), "LIB", "BARCODE"),
        with_reads("SELECT read_id, sample AS lib, primer AS barcode FROM r1"),
    ),
    "hdr8_header_table": (
        lambda s, d: op.header_table(r1(s, d), ["ID", "PRIMER", "BARCODE"]),
        with_reads('SELECT read_id AS "ID", primer AS "PRIMER", barcode AS "BARCODE" FROM r1'),
    ),
    "hdr9_unify_consensus": (
        lambda s, d: _show(sets.unify_consensus(r1(s, d), "BARCODE", "SAMPLE"), "SAMPLE"),
        with_reads("""
, c AS (SELECT barcode, sample, count(*) AS n FROM r1 GROUP BY barcode, sample),
m AS (SELECT barcode, sample FROM (
  SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY n DESC, sample) AS rn FROM c) x
  WHERE rn = 1)
SELECT r1.read_id, m.sample FROM r1 JOIN m ON r1.barcode = m.barcode"""),
    ),
    "hdr10_unify_delete": (
        lambda s, d: sets.unify_delete(r1(s, d), "BARCODE", "PRIMER", keep="both").select(
            "read_id", F.col("_pass").alias("passed")),
        with_reads("""
, c AS (SELECT barcode, count(DISTINCT primer) AS n FROM r1 GROUP BY barcode)
SELECT read_id, n = 1 AS passed FROM r1 JOIN c ON r1.barcode = c.barcode"""),
    ),
    "hdr11_field_values": (
        lambda s, d: op.field_values(r1(s, d), "BARCODE"),
        with_reads("SELECT DISTINCT barcode AS value FROM r1"),
    ),
}
