from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, with_reads
from vdjloom.functions import fields as fx
from vdjloom.operators import vendors as op


def _headers(s, d):
    """A header of every vendor, made from the numbers of the read id; every
    seventh read has a header that fits none of them."""
    p = F.split("read_id", "[.]")
    a, b, c, e = (p[i] for i in range(4))
    broken = F.col("seq_no") % 7 == 0

    def made(*parts):
        text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
        return F.when(broken, F.lit("")).otherwise(text)

    return r1(s, d).select(
        "read_id", "seq",
        made("read", a, " sample=S", b, " lane:1").alias("generic"),
        made("GX", a, " length=", c).alias("454"),
        F.when(F.col("seq_no") % 2 == 0, made("gi|", a, "|gb|MK", c, ".1| Homo sapiens IGH, partial"))
        .otherwise(made("MK", c, ".1 Homo sapiens IGH mRNA")).alias("genbank"),
        made("MISEQ:132:A2F3U:1:", a, ":", c, " ", (e.cast("int") % 2 + 1).cast("string"),
             ":N:0:ATCACG").alias("illumina"),
        made("X", a, "|IGHV1-", b, "*01|Homo sapiens|F|V-REGION|142..417|296 nt|1| | | | |296+24=320|"
             "partial in 3'| |").alias("imgt"),
        made("MIG UMI:", F.element_at("BARCODE", 1), ":", e).alias("migec"),
        made("SRR", b, ".", a, " ", c, " length=40").alias("sra"))


def _convert(vendor, *fields, **options):
    def run(s, d):
        df = _headers(s, d).select("seq", F.col(vendor).alias("header"), F.lit("").alias("read_id"))
        out = op.convert_headers(df, vendor, **options)
        return out.select("read_id", "seq", *[fx.text(F.col(f)).alias(f.lower()) for f in fields])
    return run


_SRC = """
, n AS (SELECT seq, seq_no, barcode, string_split(read_id, '.') AS p FROM r1 WHERE seq_no % 7 <> 0)"""

QUERIES = {
    "cnv1_generic": (
        _convert("generic", "DESC"),
        with_reads(_SRC + "SELECT concat('read', p[1]) AS read_id, seq, "
                   "concat('sample_S', p[2], '_lane:1') AS \"desc\" FROM n"),
    ),
    "cnv2_454": (
        _convert("454", "LENGTH"),
        with_reads(_SRC + "SELECT concat('GX', p[1]) AS read_id, seq, p[3] AS length FROM n"),
    ),
    "cnv3_genbank": (
        _convert("genbank", "DESC", "GI", "SOURCE"),
        with_reads(_SRC + """
SELECT concat('MK', p[3], '.1') AS read_id, seq,
       CASE WHEN seq_no % 2 = 0 THEN 'Homo_sapiens_IGH_partial' ELSE 'Homo_sapiens_IGH_mRNA' END AS "desc",
       CASE WHEN seq_no % 2 = 0 THEN p[1] END AS gi, CASE WHEN seq_no % 2 = 0 THEN 'gb' END AS source FROM n"""),
    ),
    "cnv4_illumina": (
        _convert("illumina", "READ", "INDEX"),
        with_reads(_SRC + """
SELECT concat('MISEQ:132:A2F3U:1:', p[1], ':', p[3]) AS read_id, seq,
       CAST(CAST(p[4] AS INT) % 2 + 1 AS VARCHAR) AS read, 'ATCACG' AS index FROM n"""),
    ),
    "cnv5_imgt": (
        _convert("imgt", "SPECIES", "REGION", "FUNCTIONALITY", "PARTIAL", "ACCESSION"),
        with_reads(_SRC + """
SELECT concat('IGHV1-', p[2], '*01') AS read_id, seq, 'Homo_sapiens' AS species, 'V-REGION' AS region,
       'F' AS functionality, 'partial_in_3''' AS partial, concat('X', p[1]) AS accession FROM n"""),
    ),
    "cnv5_imgt_simple": (
        _convert("imgt", simple=True),
        with_reads(_SRC + "SELECT concat('IGHV1-', p[2], '*01') AS read_id, seq FROM n"),
    ),
    "cnv6_migec": (
        _convert("migec", "UMI", "COUNT"),
        with_reads(_SRC + "SELECT barcode AS read_id, seq, barcode AS umi, p[4] AS \"count\" FROM n"),
    ),
    "cnv7_sra": (
        _convert("sra", "DESC"),
        with_reads(_SRC + "SELECT concat('SRR', p[2], '.', p[1]) AS read_id, seq, "
                   "concat(p[3], '_length_40') AS \"desc\" FROM n"),
    ),
}
