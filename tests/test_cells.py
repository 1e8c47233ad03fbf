"""Single-cell records: golden rows and refusals."""

import pytest

from vdjloom.operators import cells

FASTA = "sequence_id string, header string, sequence string, seq_no bigint"


def _fasta(spark, ids=("c1", "c2", "c3")):
    return spark.createDataFrame(
        [(i, f"{i} CB=AAA{n}", "ACGTACGTACGT", n) for n, i in enumerate(ids)], FASTA)


def test_productive_is_opt_in_and_unknown_stays_null(spark):
    table = spark.createDataFrame(
        [("AAA-1", "true", "c1", "", "True", "10", "2", 0), ("", "true", "c2", "", "", "1", "1", 1),
         ("AAA-1", "", "gone", "", "", "1", "1", 2)],
        "barcode string, is_cell string, contig_id string, high_confidence string, "
        "productive string, reads string, umis string, seq_no bigint")
    rows = cells.from_contigs(_fasta(spark), table).collect()
    assert len(rows) == 1 and rows[0].productive is None and rows[0].high_confidence is None
    assert (rows[0].umi_count, rows[0].read_count) == (2, 10)
    assert cells.from_contigs(_fasta(spark), table, allow_productive=True).first().productive
    report = cells.contig_report(_fasta(spark), table).first()
    assert (report.rows_without_barcode, report.rows_without_fasta_sequence,
            report.fasta_records_without_annotation) == (1, 1, 1)


def test_contig_and_airr_tables_agree(spark):
    table = spark.createDataFrame(
        [("AAA-1", "true", "c1", "10", "2", 0)],
        "barcode string, is_cell string, contig_id string, reads string, umis string, seq_no bigint")
    airr = spark.createDataFrame(
        [("AAA-1", "c1", "ACGTACGTACGT", "10", "2", "T", 0)],
        "cell_id string, sequence_id string, sequence string, consensus_count string, "
        "duplicate_count string, is_cell string, seq_no bigint")
    a = cells.from_contigs(_fasta(spark), table).drop("seq_no").collect()
    b = cells.from_airr(airr).drop("seq_no").collect()
    assert a == b


def test_partial_map_is_refused_or_topped_up(spark):
    mapping = spark.createDataFrame(
        [("c1", "CELL", "3", "4", 0)],
        "sequence_id string, cell_id string, umi_count string, read_count string, seq_no bigint")
    with pytest.raises(cells.UnresolvedCells, match="c2"):
        cells.from_fasta(_fasta(spark), mapping)
    rows = {r.sequence_id: r.cell_id for r in cells.from_fasta(
        _fasta(spark), mapping, r"CB=(\w+)").collect()}
    assert rows == {"c1": "CELL", "c2": "AAA1", "c3": "AAA2"}
    with pytest.raises(ValueError, match="barcode map"):
        cells.from_fasta(_fasta(spark))


REPORT = ("`#barcode` string, cell_type string, chain1 string, chain2 string, "
          "secondary_chain1 string, secondary_chain2 string, seq_no bigint")


def test_packed_chains(spark):
    chain = "IGHV1,*,IGHJ4,IGHM,TGT,CAR,12.00,{},97.5,1"
    report = spark.createDataFrame(
        [("AAA", "B", chain.format("c1"), "*", chain.format("c2"), "*", 0),
         ("BBB", "B", chain.format("other"), "*", "*", "*", 1)], REPORT)
    rows = {r.sequence_id: (r.cell_id, r.read_count) for r in cells.from_assembler(
        _fasta(spark), report).collect()}
    assert rows == {"c1": ("AAA", 12), "c2": ("AAA", 12)}
    counts = cells.assembler_report(_fasta(spark), report).first()
    assert (counts.report_chain_fields_unmatched, counts.contigs_not_in_cell_report) == (1, 1)


def test_two_cells_for_one_contig_stop_the_run(spark):
    chain = "V,D,J,C,nt,aa,12.00,c1,97.5,1"
    report = spark.createDataFrame(
        [("AAA", "B", chain, "*", "*", "*", 0), ("BBB", "B", chain, "*", "*", "*", 1)], REPORT)
    with pytest.raises(cells.UnresolvedCells, match="more than one cell"):
        cells.from_assembler(_fasta(spark), report)


def test_tables_of_another_run_are_refused(spark):
    report = spark.createDataFrame(
        [("AAA", "B", "V,D,J,C,nt,aa,12.00,elsewhere,97.5,1", "*", "*", "*", 0)], REPORT)
    with pytest.raises(cells.UnresolvedCells, match="no contig is placed"):
        cells.from_assembler(_fasta(spark), report)
    assert cells.from_assembler(_fasta(spark), report, check=False).count() == 0


def test_mapping_report_tells_duplicates_from_conflicts(spark):
    chain = "V,D,J,C,nt,aa,12.00,{},97.5,1"
    report = spark.createDataFrame(
        [("AAA", "B", chain.format("c1"), "*", chain.format("c2"), "*", 0)], REPORT)
    airr = spark.createDataFrame(
        [("AAA", "c1", 0), ("AAA", "c1", 1), ("BBB", "c2", 2), ("CCC", "c3", 3), ("", "c3", 4), ("CCC", "gone", 5)],
        "cell_id string, sequence_id string, seq_no bigint")
    row = cells.mapping_report(_fasta(spark), report, airr).first()
    assert (row.airr_rows, row.airr_rows_with_cell_id) == (6, 4)
    assert (row.duplicate_mappings, row.conflicting_mappings) == (2, 1)
    assert (row.records_written, row.cells) == (2, 2)
    alone = cells.mapping_report(_fasta(spark), report).first()
    assert (alone.airr_rows, alone.records_written, alone.duplicate_mappings) == (0, 2, 0)
    empty = cells.mapping_report(_fasta(spark), report.limit(0)).first()
    assert (empty.conflicting_mappings, empty.records_written, empty.cells) == (0, 0, 0)


def test_validation_keeps_the_first_and_refuses_nothing_left(spark):
    df = spark.createDataFrame(
        [("a", "ACGT", 1), ("a", "GGGG", 2), ("b", "AC T", 3), ("c", "", 4)],
        "sequence_id string, sequence string, seq_no bigint")
    assert [(r.sequence_id, r.sequence) for r in cells.validate_records(df).collect()] == [
        ("a", "ACGT")]
    report = cells.validation_report(df).first()
    assert (report.invalid, report.duplicates) == (2, 1)
    with pytest.raises(ValueError):
        cells.validate_records(df.filter("sequence_id = 'b'"))


def test_sidecar_is_lossless(spark):
    table = spark.createDataFrame(
        [("c1", "IGHV1", "", 0), ("c1", "", "x", 1), ("c2", "IGHV2", "", 2)],
        "contig_id string, v_gene string, d_gene string, seq_no bigint")
    records = spark.createDataFrame([("c1",), ("c3",)], "sequence_id string")
    rows = {r.sequence_id: (r.v_gene, r.d_gene) for r in cells.source_annotations(
        records, [(table, "contig_id")]).collect()}
    assert rows == {"c1": ("IGHV1", "x"), "c3": ("", "")}
