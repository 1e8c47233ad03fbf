"""Golden rows and properties of the read operators."""

import pytest
from pyspark.sql import functions as F

from vdjloom.functions import bases, quality
from vdjloom.functions import fields as fx
from vdjloom.operators import assembly, filters, headers, pairs, primers, sets
from vdjloom.operators.collapse import collapse
from vdjloom.sources import derived, text


def _reads(spark, rows, extra=""):
    return spark.createDataFrame(rows, "read_id string, seq string, seq_no bigint" + extra)


def test_revcomp_twice_is_identity(spark, sf_dir):
    df = derived.mate(spark, sf_dir, 1)
    twice = bases.revcomp(bases.revcomp(F.col("seq")))
    assert df.filter(twice != F.col("seq")).count() == 0


def test_quality_text_round_trip(spark, sf_dir):
    df = derived.mate(spark, sf_dir, 1)
    assert df.filter(~quality.decode(quality.encode(F.col("qual"))).eqNullSafe(
        F.col("qual"))).count() == 0


def test_pass_and_fail_are_the_input(spark, sf_dir):
    df = derived.mate(spark, sf_dir, 1)
    for step in (lambda k: filters.filter_quality(df, 25, keep=k),
                 lambda k: filters.filter_repeats(df, 4, keep=k),
                 lambda k: filters.trim_quality(df, 25, keep=k),
                 lambda k: primers.primers_score(df, {"P": "ACRT"}, 3, 0.4, keep=k)):
        counts = [step(k).count() for k in ("pass", "fail", "both")]
        assert counts[0] + counts[1] == counts[2] == df.count()


def test_empty_reads_fail(spark):
    df = _reads(spark, [("a", "", 1, []), ("b", "NNN", 2, [2, 2, 2])], ", qual array<tinyint>")
    for out in (filters.filter_length(df, 1), filters.filter_quality(df, 0),
                filters.filter_repeats(df, 2), filters.trim_quality(df, 20)):
        assert out.count() == 0


def test_partitioning_does_not_change_results(spark, sf_dir):
    df = derived.mate(spark, sf_dir, 1)
    for step in (lambda x: sets.build_consensus(x, primer_field="PRIMER", primer_freq=0.4),
                 lambda x: collapse(x, uniq=("SAMPLE",), copy={"PRIMER": "set"})):
        a, b = step(df.repartition(1)), step(df.repartition(8))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_unanimous_set_keeps_its_bases(spark):
    rows = [(f"r{i}", "ACGTN", i, [30] * 5, ["B"]) for i in range(4)]
    df = _reads(spark, rows, ", qual array<tinyint>, BARCODE array<string>")
    row = sets.build_consensus(df).first()
    assert row.seq == "ACGTN" and list(row.qual) == [90, 90, 90, 90, 0]
    dependent = sets.build_consensus(df, dependent=True).first()
    assert list(dependent.qual)[:4] == [30] * 4


def test_diversity_and_error_reject_a_mixed_set(spark):
    rows = [("a", "AAAA", 1, ["B"]), ("b", "AAAA", 2, ["B"]), ("c", "TTTT", 3, ["B"])]
    df = _reads(spark, rows, ", BARCODE array<string>")
    both = sets.build_consensus(df, max_diversity=0.5, max_error=0.1, keep="fail").first()
    assert both.reason == "DIVERSITY"
    assert sets.build_consensus(df, max_error=0.1, keep="fail").first().reason == "ERROR"
    assert sets.build_consensus(df, max_error=0.4).count() == 1


def test_assembled_header_merges_head_then_tail(spark):
    head = _reads(spark, [("READ1", "ACGT" * 15, 1, ["2"], ["IGHA"])],
                  ", CONSCOUNT array<string>, PRCONS array<string>")
    tail = _reads(spark, [("READ1", "TTTT" * 15, 1, ["3"])], ", CONSCOUNT array<string>")
    out = assembly.assemble_join(head, tail, head_fields=("CONSCOUNT", "PRCONS"),
                                 tail_fields=("CONSCOUNT",))
    text_ = out.select(headers.flatten_header(out)).first()[0]
    assert text_ == "READ1|CONSCOUNT=2,3|PRCONS=IGHA"


def test_mates_that_differ_stop_the_run(spark):
    a = _reads(spark, [("x", "ACGT", 1)])
    b = _reads(spark, [("y", "ACGT", 1)])
    with pytest.raises(ValueError, match="do not match"):
        assembly.assemble_join(a, b)


@pytest.mark.parametrize("kind,one,two,key", [
    ("sra", "ERR346600.1 1 length=250", "ERR346600.1 1 length=251", "ERR346600.1"),
    ("illumina", "READ1/1", "READ1/2", "READ1"),
    ("presto", "READ1|A=1", "READ1|B=2", "READ1")])
def test_coordinates(spark, kind, one, two, key):
    df = spark.createDataFrame([(one,), (two,)], "h string")
    assert {r[0] for r in df.select(pairs.coord_key(F.col("h"), kind)).collect()} == {key}


def test_numbers_are_compact(spark):
    values = [0.0, 3.0, 2.5, 1 / 3, 1e15, 1.5e-7, -2.25, 123456789012.0, 1234567.891]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fx.compact(F.col("v"))).collect()]
    assert got == ["%.12g" % v for v in values]


def test_unknown_fields_are_refused(spark, sf_dir):
    df = derived.mate(spark, sf_dir, 1)
    for call in (lambda: headers.collapse_fields(df, {"NOPE": "sum"}),
                 lambda: sets.build_consensus(df, barcode="NOPE"),
                 lambda: filters.filter_quality(df.drop("qual"))):
        with pytest.raises(ValueError):
            call()


def test_gapped_primer(spark):
    rows = [("exact", "TTACGTACGTTTTTTT", 1), ("insert", "TTACGTTACGTTTTTTT", 2),
            ("none", "GGGGGGGGGGGGGGGG", 3), ("turned", "AAAAAAACGTACGTAA", 4)]
    df = _reads(spark, rows)
    out = {r.read_id: (r.seq, r.SEQORIENT[0]) for r in primers.primers_align(
        df, {"P": "ACGTACGTTT"}, max_error=0.15, max_len=16, mode="cut").collect()}
    assert out["exact"] == ("TTTT", "F") and out["insert"] == ("TTTT", "F")
    assert "none" not in out and out["turned"][1] == "RC"


def test_reference_fills_the_gap(spark):
    ref = "ACGGTCATTGCAACGTTAGCCATAGGCTTACGATCCGTAAGCTTGGACCTA"
    refs = spark.createDataFrame([("V1", ref), ("V2", ref[::-1])], "name string, seq string")
    tail = bases.revcomp
    df = spark.createDataFrame([("p", ref[2:20], 1, ref[28:48])],
                               "read_id string, seq string, seq_no bigint, t string")
    head = df.select("read_id", "seq", "seq_no")
    back = df.select("read_id", tail(F.col("t")).alias("seq"), "seq_no")
    filled = assembly.assemble_reference(head, back, refs, step=1, fill=True).first()
    assert (filled.seq, filled.reference, filled.identity) == (ref[2:48], "V1", 1.0)
    gap = assembly.assemble_reference(head, back, refs, step=1).first()
    assert gap.seq == ref[2:20] + "N" * 8 + ref[28:48]


def test_tied_references_stay_until_the_mates_meet(spark):
    """150 alleles share what the head covers; the last by name alone fits the tail."""
    stem, ends = "ACGGTCATTGCAACGTTAGCCATAGG", ["GATTACCAGTCCATGACTGA", "CTTACGATCCGTAAGCTTGG"]
    refs = spark.createDataFrame(
        [(f"A{i:03d}", stem + ends[i == 149]) for i in range(150)], "name string, seq string")
    head = _reads(spark, [("p", stem[:22], 1)])
    tail = _reads(spark, [("p", ends[1], 1)])
    out = assembly.assemble_reference(head, tail, refs, rc="none", fill=True).first()
    assert (out.seq, out.reference, out.identity) == (stem + ends[1], "A149", 1.0)


def test_head_beyond_the_tail(spark):
    fragment = "ACGGTCATTGCAACGTTAGCCATAGG"
    head = _reads(spark, [("p", fragment + "TTTT", 1)])
    tail = _reads(spark, [("p", "CCCC" + fragment, 1)])
    out = assembly.assemble_align(head, tail, rc="none", scan_reverse=True).first()
    assert out.seq == "CCCC" + fragment + "TTTT" and out.overlap == len(fragment)
    assert assembly.assemble_align(head, tail, rc="none").count() == 0


def test_tags_and_layouts(spark):
    df = spark.createDataFrame(
        [("r1 CB:Z:AAAC-1 UB:Z:TTTT", "A"), ("r2 UB:Z:TT", "C"), ("r3 CB:Z:- UB:Z:T", "G"),
         ("r4 CB:Z:GGG-1", "T")], "header string, seq string")
    got = {r.read_id: (r.BARCODE[0], r.UMI[0]) for r in text.split_tags(df).collect()}
    assert got == {"r1": ("AAAC-1", "TTTT"), "r4": ("GGG-1", "N")}
    with pytest.raises(ValueError, match="inverted"):
        text.extract_10x_tags(df, df, ((5, 2), (6, 9)))
