"""Sidecars of assembled contigs and of plain FASTA records."""

from __future__ import annotations

from vdjloom.operators import cells, sidecars
from vdjloom.sources import text


def _annot(spark):
    return spark.createDataFrame([
        ("c1", "c1 60 V9*01 * J7*01 CASSL", "ACGT", 0), ("c2", "c2 58 A12*01 * J33*01 CAVND", "GGCC", 1),
        ("c3", "c3 40 nothing", "TTTT", 2)], "sequence_id string, header string, sequence string, seq_no bigint")


REPORT = ("#barcode\tcell_type\tchain1\tchain2\tsecondary_chain1\n"
          "CELL1\tabT\tV9,*,J7,C,TGT,CASSL,12,c1,1.00,1\tA12,*,J33,C,TGT,CAVND,7,c2,0.98,0\t*\n"
          "CELL2\tB\tV1,*,J1,C,TGT,CAR,3,elsewhere,1.00,1\t*\t*\n")


def test_assembler_header_and_report_rows_stay(spark, tmp_path):
    path = tmp_path / "report.tsv"
    path.write_text(REPORT)
    report = text.read_barcode_report(spark, str(path))
    records = cells.from_assembler(_annot(spark), report)
    rows = {r.sequence_id: r.asDict() for r in sidecars.assembler_annotations(records, _annot(spark), report).collect()}
    assert set(rows) == {"c1", "c2"}
    assert "V9*01" in rows["c1"]["annot_header"]
    # Both contigs of the cell keep the whole row that placed them.
    for name in ("c1", "c2"):
        assert "CASSL" in rows[name]["barcode_report.chain1"]
        assert "CAVND" in rows[name]["barcode_report.chain2"]
        assert rows[name]["barcode_report.#barcode"] == "CELL1"
        assert rows[name]["barcode_report.secondary_chain1"] == "*"


def test_airr_rows_without_cell_or_contig_add_nothing(spark):
    airr = spark.createDataFrame([
        ("c3", "CELL9", "V3", 0), ("c1", None, "V1", 1), ("c9", "CELL9", "V9", 2), (None, "CELL9", "V0", 3)],
        "sequence_id string, cell_id string, v_call string, seq_no bigint")
    records = cells.from_assembler(_annot(spark), airr=airr)
    rows = sidecars.assembler_annotations(records, _annot(spark), airr=airr).collect()
    assert [(r.sequence_id, r["barcode_airr.v_call"]) for r in rows] == [("c3", "V3")]
    everything = cells.merge_annotations(sidecars.assembler_sources(_annot(spark), airr=airr))
    assert {(r.sequence_id, r["barcode_airr.v_call"]) for r in everything.collect()} == {
        ("c1", ""), ("c2", ""), ("c3", "V3")}


def test_map_columns_of_the_user_stay(spark, tmp_path):
    path = tmp_path / "map.tsv"
    path.write_text("Sequence_ID\tcell_id\tumi_count\tsample.name\tempty\n"
                    "c1\tX\t1\tS0\t\nc1\tX\t3\t\t\nc2\tY\t2\tS1\t\n")
    mapping = text.read_barcode_map(spark, str(path))
    records = cells.from_fasta(_annot(spark), mapping, r"^(\S+)")
    got = sidecars.fasta_annotations(records, _annot(spark), mapping)
    rows = {r.sequence_id: r.asDict() for r in got.collect()}
    assert got.columns == ["sequence_id", "fasta_header", "cell_id", "umi_count", "sample.name", "empty"]
    assert rows["c1"]["umi_count"] == "3" and rows["c1"]["sample.name"] == ""  # the last row, whole
    assert rows["c2"]["sample.name"] == "S1" and rows["c2"]["empty"] == ""
    assert rows["c3"]["fasta_header"] == "c3 40 nothing" and rows["c3"]["cell_id"] == ""


def test_without_a_map_and_with_empty_tables(spark):
    records = cells.from_fasta(_annot(spark), None, r"^(\S+)")
    assert sidecars.fasta_annotations(records, _annot(spark)).columns == ["sequence_id", "fasta_header"]
    none = _annot(spark).limit(0)
    assert sidecars.fasta_annotations(records.limit(0), none).count() == 0
