from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, r2, with_reads
from vdjloom.functions import fields as fx
from vdjloom.operators import pairs as op


def _both(pair):
    def show(df, mate):
        return df.select("read_id", F.lit(mate).alias("mate"), "seq",
                         fx.text(F.col("BARCODE")).alias("barcode"),
                         fx.text(F.col("SAMPLE")).alias("sample"))
    return show(pair[0], 1).union(show(pair[1], 2))


def _vendor_ids(df):
    """Headers of several machines made from the read id."""
    number = F.regexp_extract("read_id", r"^(\d+)", 1)
    return df.select(
        "read_id",
        F.concat(F.lit("SRR1."), number, F.lit(" 1 length=40")).alias("sra"),
        F.concat(F.lit("MISEQ:1:"), number, F.lit(":7 1:N:0:ATC")).alias("illumina"),
        F.concat(F.lit("HWI_"), number, F.lit("#0/1")).alias("solexa"),
        F.concat(F.lit("GX"), number, F.lit(" length=40")).alias("454"),
        F.concat(F.col("read_id"), F.lit("|A=1")).alias("presto"))


QUERIES = {
    "jn1_pair_reads": (
        lambda s, d: _both(op.pair_reads(r1(s, d), r2(s, d), ("BARCODE",), ("SAMPLE",))),
        with_reads("""
SELECT r1.read_id, r1.mate, r1.seq, r1.barcode, concat(r1.sample, ',', r2.sample) AS sample
FROM r1 JOIN r2 ON r1.read_id = r2.read_id
UNION ALL
SELECT r2.read_id, r2.mate, r2.seq, concat(r1.barcode, ',', r2.barcode), r2.sample
FROM r1 JOIN r2 ON r1.read_id = r2.read_id"""),
    ),
    "jn2_unpaired": (
        lambda s, d: op.unpaired(r1(s, d), r2(s, d)).select("read_id", "seq"),
        with_reads("SELECT read_id, min(seq) AS seq FROM reads GROUP BY read_id HAVING max(mate) = 1"),
    ),
    "jn7_assert_synced": (
        lambda s, d: op.mismatched_keys(r1(s, d), r2(s, d)),
        with_reads("""
SELECT count(*) FILTER (b.read_id IS NULL) AS only_head, count(*) FILTER (a.read_id IS NULL) AS only_tail
FROM r1 a FULL JOIN r2 b ON a.read_id = b.read_id"""),
    ),
    "cnv8_coord_key": (
        lambda s, d: _vendor_ids(r1(s, d)).select("read_id", *[
            op.coord_key(F.col(k), k).alias(f"k_{k}") for k in op.COORDINATE_TAILS]),
        with_reads("""
, n AS (SELECT read_id, string_split(read_id, '.')[1] AS o FROM r1)
SELECT read_id, read_id AS k_presto, concat('MISEQ:1:', o, ':7') AS k_illumina,
       concat('HWI_', o, '#0') AS k_solexa, concat('SRR1.', o) AS k_sra, concat('GX', o) AS k_454 FROM n"""),
    ),
    "set2_key_intersection": (
        lambda s, d: r1(s, d).select("read_id").intersect(r2(s, d).select("read_id")),
        with_reads("SELECT read_id FROM r1 INTERSECT SELECT read_id FROM r2"),
    ),
    "set3_unpaired_difference": (
        lambda s, d: r1(s, d).select("read_id").subtract(r2(s, d).select("read_id")),
        with_reads("SELECT read_id FROM r1 EXCEPT SELECT read_id FROM r2"),
    ),
}
