from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, with_reads
from vdjloom.functions import fields as fx
from vdjloom.functions.durable import shared_dir, stored
from vdjloom.operators import cells as op
from vdjloom.operators import sidecars
from vdjloom.sources import sinks, text


def _when(mod, rest, value, other):
    return F.when(F.col("seq_no") % mod == rest, F.lit(value)).otherwise(other)


def _fasta(s, d):
    """Contigs with their cell in the header; one in thirteen is absent."""
    return r1(s, d).filter("seq_no % 13 <> 0").select(
        F.col("read_id").alias("sequence_id"),
        F.concat("read_id", F.lit(" bc="), F.element_at("BARCODE", 1)).alias("header"),
        F.col("seq").alias("sequence"), "seq_no")


def _table(s, d):
    p = F.split("read_id", "[.]")
    return r1(s, d).select(
        _when(11, 0, "", F.concat(F.element_at("BARCODE", 1), F.lit("-1"))).alias("barcode"),
        _when(3, 0, "True", _when(3, 1, "false", F.lit(""))).alias("is_cell"),
        _when(17, 0, "", F.col("read_id")).alias("contig_id"),
        _when(2, 0, "TRUE", F.lit("?")).alias("high_confidence"),
        F.lit("40").alias("length"), F.element_at("PRIMER", 1).alias("chain"),
        F.concat(F.lit("IGHV"), p[1]).alias("v_gene"), F.lit("").alias("d_gene"),
        _when(5, 0, "yes", F.lit("no")).alias("productive"),
        F.concat(p[2], F.lit(".7")).alias("reads"), _when(7, 0, "x", p[3]).alias("umis"), "seq_no")


def _airr(s, d):
    t = _table(s, d)
    return t.select(
        F.col("barcode").alias("cell_id"), F.col("contig_id").alias("Sequence_ID"),
        F.lit("ACGT").alias("sequence"), F.col("reads").alias("consensus_count"),
        F.col("umis").alias("duplicate_count"), F.col("is_cell"), "seq_no")


def _map(s, d):
    """Two rows per id for some reads; the later one wins."""
    base = r1(s, d).filter("seq_no % 4 <> 0").select(
        F.col("read_id").alias("sequence_id"), F.lit("OLD").alias("cell_id"),
        F.lit("1").alias("umi_count"), F.lit("2").alias("read_count"), "seq_no")
    return base.union(base.filter("seq_no % 3 = 0").select(
        "sequence_id", F.lit("NEW"), F.lit("3"), F.lit("4.9"), F.col("seq_no") + 1))


def _report(s, d):
    """A barcode report: each read is the chain of a cell, some name no contig."""
    name = _when(9, 0, "unknown", F.col("read_id"))
    chain = F.concat(F.lit("IGHV1,*,IGHJ4,IGHM,TGT,CAR,"), F.split("read_id", "[.]")[2], F.lit(".00,"),
                     name, F.lit(",97.5,1"))
    return r1(s, d).select(
        _when(10, 0, "", F.element_at("BARCODE", 1)).alias("#barcode"), F.lit("B").alias("cell_type"),
        _when(2, 0, "*", chain).alias("chain1"), F.lit("*").alias("chain2"),
        F.when(F.col("seq_no") % 2 == 0, chain).otherwise(F.lit("*")).alias("secondary_chain1"),
        F.lit("-").alias("secondary_chain2"), "seq_no")


def _same_cells(s, d):
    """The AIRR table with the cells of the report."""
    return _airr(s, d).withColumn("cell_id", F.regexp_replace("cell_id", "-1$", ""))


def _assembler_sidecar(s, d):
    parts = _fasta(s, d), _report(s, d), _same_cells(s, d)
    named = stored(op.named_contigs(parts[1], parts[0].select("sequence_id").distinct()))
    return sidecars.assembler_annotations(op.from_assembler(*parts, named=named), *parts, named).select(
        "sequence_id", "annot_header", F.col("`barcode_report.#barcode`").alias("report_barcode"),
        F.col("`barcode_report.cell_type`").alias("report_cell_type"),
        F.col("`barcode_report.chain1`").alias("report_chain1"),
        F.col("`barcode_report.chain2`").alias("report_chain2"),
        F.col("`barcode_airr.Sequence_ID`").alias("airr_sequence_id"),
        F.col("`barcode_airr.consensus_count`").alias("airr_consensus_count"))


def _fasta_sidecar(s, d):
    """A map with columns of the user's own; the later row of an id is empty in one of them."""
    mapping = _map(s, d).withColumns({
        "sample": F.concat(F.lit("S"), F.col("seq_no") % 5),
        "note": F.when(F.col("cell_id") == "OLD", F.lit("first")).otherwise(F.lit(""))})
    return sidecars.fasta_annotations(
        op.from_fasta(_fasta(s, d), mapping, r"bc=(\S+)"), _fasta(s, d), mapping)


def _shown(df):
    return df.select(*op.RECORD)


_TABLE = """
, t AS (SELECT read_id, seq, seq_no, barcode AS bc,
   CASE WHEN seq_no % 11 = 0 THEN NULL ELSE concat(barcode, '-1') END AS cell,
   CASE WHEN seq_no % 17 = 0 THEN NULL ELSE read_id END AS contig,
   CASE seq_no % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_cell,
   CASE WHEN seq_no % 2 = 0 THEN TRUE END AS high_confidence,
   seq_no % 5 = 0 AS productive,
   CAST(string_split(read_id, '.')[3] AS BIGINT) AS reads,
   CASE WHEN seq_no % 7 = 0 THEN NULL ELSE CAST(string_split(read_id, '.')[4] AS BIGINT) END AS umis FROM r1)"""

_RECORDS = """
SELECT contig AS sequence_id, seq AS sequence, cell AS cell_id, umis AS umi_count, reads AS read_count,
       is_cell, high_confidence, {productive} AS productive
FROM t WHERE contig IS NOT NULL AND cell IS NOT NULL AND seq_no % 13 <> 0"""


def _written_metadata(s, d):
    path = f"{shared_dir(s)}/vdjloom-metadata-{uuid.uuid4().hex}"
    sinks.write_metadata(_shown(op.from_contigs(_fasta(s, d), _table(s, d))), path)
    return text._table(s, path, "\t").select(
        "sequence_id", "cell_id", F.coalesce("umi_count", F.lit("")).alias("umi_count"),
        F.coalesce("is_cell", F.lit("")).alias("is_cell"))


def _round_trip(s, d):
    path = f"{shared_dir(s)}/vdjloom-contigs-{uuid.uuid4().hex}"
    _table(s, d).drop("seq_no").write.csv(path, header=True, emptyValue="")
    return _shown(op.from_contigs(_fasta(s, d), text.read_contig_csv(s, path)))


def _airr_trip(s, d):
    path = f"{shared_dir(s)}/vdjloom-airr-{uuid.uuid4().hex}"
    _airr(s, d).drop("seq_no").write.csv(path, header=True, sep="\t", emptyValue="")
    return _shown(op.from_airr(text.read_airr_tsv(s, path)))


def _map_trip(s, d):
    path = f"{shared_dir(s)}/vdjloom-map-{uuid.uuid4().hex}.tsv"
    _map(s, d).filter("cell_id = 'NEW'").drop("seq_no").write.csv(path, header=True, sep="\t")
    return _shown(op.from_fasta(_fasta(s, d), text.read_barcode_map(s, path), r"bc=(\S+)"))


def _report_trip(s, d):
    path = f"{shared_dir(s)}/vdjloom-report-{uuid.uuid4().hex}"
    _report(s, d).drop("seq_no").write.csv(path, header=True, sep="\t", emptyValue="")
    return _shown(op.from_assembler(_fasta(s, d), text.read_barcode_report(s, path), check=False))


_AIRR_SQL = with_reads(_TABLE + """
SELECT contig AS sequence_id, 'ACGT' AS sequence, cell AS cell_id, umis AS umi_count, reads AS read_count,
       is_cell, CAST(NULL AS BOOLEAN) AS high_confidence, CAST(NULL AS BOOLEAN) AS productive
FROM t WHERE contig IS NOT NULL AND cell IS NOT NULL""")

_ASSEMBLER_SQL = with_reads("""
SELECT read_id AS sequence_id, seq AS sequence, barcode AS cell_id, CAST(NULL AS BIGINT) AS umi_count,
       CAST(string_split(read_id, '.')[3] AS BIGINT) AS read_count, CAST(NULL AS BOOLEAN) AS is_cell,
       CAST(NULL AS BOOLEAN) AS high_confidence, CAST(NULL AS BOOLEAN) AS productive
FROM r1 WHERE seq_no % 13 <> 0 AND seq_no % 9 <> 0 AND seq_no % 10 <> 0""")

QUERIES = {
    "sc1_from_contigs": (
        lambda s, d: _shown(op.from_contigs(_fasta(s, d), _table(s, d))),
        with_reads(_TABLE + _RECORDS.format(productive="CAST(NULL AS BOOLEAN)")),
    ),
    "sc1_from_contigs_productive": (
        lambda s, d: _shown(op.from_contigs(_fasta(s, d), _table(s, d), allow_productive=True)),
        with_reads(_TABLE + _RECORDS.format(productive="productive")),
    ),
    "src5_read_contig_csv": (
        _round_trip, with_reads(_TABLE + _RECORDS.format(productive="CAST(NULL AS BOOLEAN)"))),
    "sc10_parse_report": (
        lambda s, d: op.contig_report(_fasta(s, d), _table(s, d)),
        with_reads(_TABLE + """
SELECT count(*) AS annotation_rows, count(*) FILTER (contig IS NULL) AS rows_without_contig_id,
       count(*) FILTER (contig IS NOT NULL AND seq_no % 13 = 0) AS rows_without_fasta_sequence,
       count(*) FILTER (contig IS NOT NULL AND seq_no % 13 <> 0 AND cell IS NULL) AS rows_without_barcode,
       count(*) FILTER (contig IS NOT NULL AND seq_no % 13 <> 0 AND cell IS NOT NULL) AS records_written,
       count(*) FILTER (seq_no % 13 <> 0) AS fasta_records,
       count(*) FILTER (seq_no % 13 <> 0 AND contig IS NULL) AS fasta_records_without_annotation FROM t"""),
    ),
    "sc2_from_airr": (lambda s, d: _shown(op.from_airr(_airr(s, d))), _AIRR_SQL),
    "sc2_airr_report": (
        lambda s, d: op.airr_report(_airr(s, d)),
        with_reads(_TABLE + """
SELECT count(*) AS airr_rows, count(*) FILTER (contig IS NULL) AS rows_without_sequence,
       count(*) FILTER (contig IS NOT NULL AND cell IS NULL) AS rows_without_barcode,
       count(*) FILTER (contig IS NOT NULL AND cell IS NOT NULL) AS records_written FROM t"""),
    ),
    "src6_read_airr_tsv": (_airr_trip, _AIRR_SQL),
    "sc3_from_fasta": (
        lambda s, d: _shown(op.from_fasta(_fasta(s, d), _map(s, d), r"bc=(\S+)")),
        with_reads("""
SELECT read_id AS sequence_id, seq AS sequence,
       CASE WHEN seq_no % 4 = 0 THEN barcode WHEN seq_no % 3 = 0 THEN 'NEW' ELSE 'OLD' END AS cell_id,
       CAST(CASE WHEN seq_no % 4 = 0 THEN NULL WHEN seq_no % 3 = 0 THEN 3 ELSE 1 END AS BIGINT) AS umi_count,
       CAST(CASE WHEN seq_no % 4 = 0 THEN NULL WHEN seq_no % 3 = 0 THEN 4 ELSE 2 END AS BIGINT) AS read_count,
       CAST(NULL AS BOOLEAN) AS is_cell, CAST(NULL AS BOOLEAN) AS high_confidence,
       CAST(NULL AS BOOLEAN) AS productive FROM r1 WHERE seq_no % 13 <> 0"""),
    ),
    "sc3_fasta_report": (
        lambda s, d: op.fasta_report(_fasta(s, d), _map(s, d)),
        with_reads("""
SELECT count(*) AS fasta_records, count(*) FILTER (seq_no % 4 <> 0) AS barcodes_from_map,
       count(*) FILTER (seq_no % 4 = 0) AS records_without_barcode,
       count(*) FILTER (seq_no % 4 <> 0) AS records_written FROM r1 WHERE seq_no % 13 <> 0"""),
    ),
    "src7_read_barcode_map": (
        _map_trip,
        with_reads("""
, m AS (SELECT *, seq_no % 4 <> 0 AND seq_no % 3 = 0 AS mapped FROM r1 WHERE seq_no % 13 <> 0)
SELECT read_id AS sequence_id, seq AS sequence, CASE WHEN mapped THEN 'NEW' ELSE barcode END AS cell_id,
       CAST(CASE WHEN mapped THEN 3 END AS BIGINT) AS umi_count,
       CAST(CASE WHEN mapped THEN 4 END AS BIGINT) AS read_count, CAST(NULL AS BOOLEAN) AS is_cell,
       CAST(NULL AS BOOLEAN) AS high_confidence, CAST(NULL AS BOOLEAN) AS productive FROM m"""),
    ),
    "sc4_from_assembler": (
        lambda s, d: _shown(op.from_assembler(_fasta(s, d), _report(s, d))), _ASSEMBLER_SQL),
    "src8_read_barcode_report": (_report_trip, _ASSEMBLER_SQL),
    "sc5_contig_cells": (
        lambda s, d: op.contig_cells(
            _fasta(s, d), _report(s, d), _airr(s, d).withColumn(
                "cell_id", F.regexp_replace("cell_id", "-1$", ""))),
        with_reads(_TABLE + """,
a AS (SELECT read_id AS contig, bc AS cell, reads FROM t WHERE seq_no % 13 <> 0 AND seq_no % 9 <> 0 AND seq_no % 10 <> 0
      UNION ALL SELECT read_id, bc, NULL FROM t WHERE contig IS NOT NULL AND cell IS NOT NULL AND seq_no % 13 <> 0)
SELECT contig, min(cell) AS cell, count(DISTINCT cell) AS n_cells, count(*) AS mappings,
       max(reads) AS read_count FROM a GROUP BY contig"""),
    ),
    "sc5_assembler_report": (
        lambda s, d: op.assembler_report(_fasta(s, d), _report(s, d)),
        with_reads("""
SELECT count(*) FILTER (seq_no % 10 <> 0 AND seq_no % 9 <> 0 AND seq_no % 13 <> 0) AS report_chain_fields_parsed,
       count(*) FILTER (seq_no % 10 <> 0 AND (seq_no % 9 = 0 OR seq_no % 13 = 0)) AS report_chain_fields_unmatched,
       count(*) AS report_rows, count(*) FILTER (seq_no % 10 = 0) AS report_rows_without_barcode,
       count(*) FILTER (seq_no % 13 <> 0) AS annot_contigs, 0 AS conflicting_contigs,
       count(*) FILTER (seq_no % 13 <> 0 AND (seq_no % 10 = 0 OR seq_no % 9 = 0)) AS contigs_not_in_cell_report,
       count(*) FILTER (seq_no % 13 <> 0 AND seq_no % 10 <> 0 AND seq_no % 9 <> 0) AS contigs_placed FROM r1"""),
    ),
    "sc10_mapping_report": (
        lambda s, d: op.mapping_report(
            _fasta(s, d), _report(s, d), _airr(s, d).withColumn("cell_id", _when(
                7, 0, F.lit("other"), F.regexp_replace("cell_id", "-1$", "")))),
        with_reads(_TABLE + """,
a AS (SELECT read_id AS contig, bc AS cell, 0 AS o FROM t WHERE seq_no % 13 <> 0 AND seq_no % 9 <> 0 AND seq_no % 10 <> 0
      UNION ALL SELECT read_id, CASE WHEN seq_no % 7 = 0 THEN 'other' ELSE bc END, 1 FROM t
      WHERE contig IS NOT NULL AND (cell IS NOT NULL OR seq_no % 7 = 0) AND seq_no % 13 <> 0),
f AS (SELECT *, first(cell) OVER (PARTITION BY contig ORDER BY o) AS held FROM a),
m AS (SELECT contig, min(held) AS cell, count(*) AS n, count(*) FILTER (cell <> held) AS others FROM f GROUP BY contig)
SELECT CAST(sum(n - 1 - others) AS BIGINT) AS duplicate_mappings, CAST(sum(others) AS BIGINT) AS conflicting_mappings,
       count(*) FILTER (others = 0) AS records_written, count(DISTINCT cell) FILTER (others = 0) AS cells,
       (SELECT count(*) FROM t) AS airr_rows, (SELECT count(*) FROM a WHERE o = 1) AS airr_rows_with_cell_id FROM m"""),
    ),
    "sc6_strip_annotation_columns": (
        lambda s, d: op.strip_annotation_columns(_table(s, d).select(
            "contig_id", "chain", "v_gene", "productive", "length", F.lit("x").alias("V_Call"))),
        with_reads("SELECT CASE WHEN seq_no % 17 = 0 THEN '' ELSE read_id END AS contig_id, "
                   "'40' AS length FROM r1"),
    ),
    "sc7_first_present": (
        lambda s, d: (lambda t: t.select("seq_no", text.first_present(
            t, ["nothing", "CONTIG_ID", "chain"]).alias("found")))(_table(s, d)),
        with_reads("SELECT seq_no, CASE WHEN seq_no % 17 = 0 THEN primer ELSE read_id END AS found FROM r1"),
    ),
    "sc8_lenient_values": (
        lambda s, d: _table(s, d).select(
            "seq_no", fx.to_bool(F.col("is_cell")).alias("is_cell"),
            fx.to_bool(F.col("high_confidence")).alias("high_confidence"),
            fx.to_int(F.col("reads")).alias("reads"), fx.to_int(F.col("umis")).alias("umis")),
        with_reads(_TABLE + "SELECT seq_no, is_cell, high_confidence, reads, umis FROM t"),
    ),
    "sc9_validate_records": (
        lambda s, d: _shown(op.validate_records(op.from_contigs(
            _fasta(s, d).withColumn("sequence", F.when(
                F.col("seq_no") % 19 == 0, F.lit("AC GT")).otherwise(F.col("sequence"))),
            _table(s, d).union(_table(s, d).withColumn("seq_no", F.col("seq_no") + 1)))))
        .select("sequence_id", "sequence", "cell_id"),
        with_reads(_TABLE + """
SELECT contig AS sequence_id, seq AS sequence, cell AS cell_id FROM t
WHERE contig IS NOT NULL AND cell IS NOT NULL AND seq_no % 13 <> 0 AND seq_no % 19 <> 0"""),
    ),
    "snk3_write_metadata": (
        _written_metadata,
        with_reads(_TABLE + """
SELECT contig AS sequence_id, cell AS cell_id, coalesce(CAST(umis AS VARCHAR), '') AS umi_count,
       coalesce(CAST(is_cell AS VARCHAR), '') AS is_cell
FROM t WHERE contig IS NOT NULL AND cell IS NOT NULL AND seq_no % 13 <> 0"""),
    ),
    "snk4_source_annotations": (
        lambda s, d: op.source_annotations(
            op.from_contigs(_fasta(s, d), _table(s, d)), [(_table(s, d), "contig_id")]).select(
            "sequence_id", "barcode", "chain", "v_gene", "d_gene", "productive", "reads"),
        with_reads(_TABLE + """
SELECT contig AS sequence_id, cell AS barcode,
       (SELECT primer FROM r1 WHERE r1.read_id = t.read_id) AS chain,
       concat('IGHV', string_split(read_id, '.')[2]) AS v_gene, '' AS d_gene,
       CASE WHEN productive THEN 'yes' ELSE 'no' END AS productive, concat(CAST(reads AS VARCHAR), '.7') AS reads
FROM t WHERE contig IS NOT NULL AND cell IS NOT NULL AND seq_no % 13 <> 0"""),
    ),
    "snk4_assembler": (
        _assembler_sidecar,
        with_reads(_TABLE + """,
p AS (SELECT *, seq_no % 9 <> 0 AND seq_no % 10 <> 0 AS r, contig IS NOT NULL AND cell IS NOT NULL AS a,
        concat('IGHV1,*,IGHJ4,IGHM,TGT,CAR,', CAST(reads AS VARCHAR), '.00,', read_id, ',97.5,1') AS chain
      FROM t WHERE seq_no % 13 <> 0)
SELECT read_id AS sequence_id, concat(read_id, ' bc=', bc) AS annot_header,
       CASE WHEN r THEN bc ELSE '' END AS report_barcode, CASE WHEN r THEN 'B' ELSE '' END AS report_cell_type,
       CASE WHEN NOT r THEN '' WHEN seq_no % 2 = 0 THEN '*' ELSE chain END AS report_chain1,
       CASE WHEN r THEN '*' ELSE '' END AS report_chain2, CASE WHEN a THEN contig ELSE '' END AS airr_sequence_id,
       CASE WHEN a THEN concat(CAST(reads AS VARCHAR), '.7') ELSE '' END AS airr_consensus_count
FROM p WHERE r OR a"""),
    ),
    "snk4_fasta": (
        _fasta_sidecar,
        with_reads("""
, m AS (SELECT *, seq_no % 4 <> 0 AS mapped, seq_no % 3 = 0 AS twice FROM r1 WHERE seq_no % 13 <> 0)
SELECT read_id AS sequence_id, concat(read_id, ' bc=', barcode) AS fasta_header,
       CASE WHEN NOT mapped THEN '' WHEN twice THEN 'NEW' ELSE 'OLD' END AS cell_id,
       CASE WHEN NOT mapped THEN '' WHEN twice THEN '3' ELSE '1' END AS umi_count,
       CASE WHEN NOT mapped THEN '' WHEN twice THEN '4.9' ELSE '2' END AS read_count,
       CASE WHEN NOT mapped THEN '' ELSE concat('S', CAST((seq_no + CASE WHEN twice THEN 1 ELSE 0 END) % 5 AS VARCHAR)) END AS sample,
       CASE WHEN mapped AND NOT twice THEN 'first' ELSE '' END AS note FROM m"""),
    ),
    "set5_merge_annotations": (
        lambda s, d: op.merge_annotations([
            (_table(s, d).select("contig_id", "chain", "is_cell", "seq_no"), "contig_id"),
            (_airr(s, d).select(F.col("Sequence_ID").alias("id"), "is_cell", "sequence", "seq_no")
             .withColumn("is_cell", F.when(F.col("seq_no") % 2 == 0, F.lit("B")).otherwise(F.lit(""))), "id"),
        ]).select("sequence_id", "chain", "is_cell", "sequence"),
        with_reads("""
SELECT read_id AS sequence_id, primer AS chain, CASE WHEN seq_no % 2 = 0 THEN 'B' WHEN seq_no % 3 = 0 THEN 'True'
       WHEN seq_no % 3 = 1 THEN 'false' ELSE '' END AS is_cell, 'ACGT' AS sequence
FROM r1 WHERE seq_no % 17 <> 0"""),
    ),
    "agg22_count_cells": (
        lambda s, d: op.count_cells(op.from_contigs(_fasta(s, d), _table(s, d))),
        with_reads(_TABLE + """
SELECT count(*) AS records, count(DISTINCT cell) AS cells
FROM t WHERE contig IS NOT NULL AND cell IS NOT NULL AND seq_no % 13 <> 0"""),
    ),
    "snk10_run_summary": (
        lambda s, d: sinks.run_summary(
            op.from_contigs(_fasta(s, d), _table(s, d)), op.contig_report(_fasta(s, d), _table(s, d)),
            sinks.fingerprint(s, [f"{d.removeprefix('file://')}/lineitem.parquet"]), {"format": "contigs"}),
        None,
    ),
}
