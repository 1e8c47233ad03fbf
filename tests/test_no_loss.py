"""Reads without a field stay somewhere; what can't be read or paired is an error; samples do not depend on slices."""

import pytest
from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, r2
from vdjloom.operators import assembly, pairs, sets, split
from vdjloom.sources.fastq import read_fastq


@pytest.fixture(scope="module")
def gaps(spark, sf_dir):
    """Reads of which one in ten lacks its set."""
    reads = r1(spark, sf_dir)
    return reads.withColumn("BARCODE", F.when(F.crc32("read_id") % 10 > 0, F.col("BARCODE"))).cache()


def test_unify_keeps_reads_without_a_set(gaps):
    out = sets.unify_consensus(gaps)
    assert out.count() == gaps.count()
    lone = out.filter("BARCODE IS NULL").select("read_id", "SAMPLE").exceptAll(
        gaps.filter("BARCODE IS NULL").select("read_id", "SAMPLE"))
    assert lone.isEmpty()


def test_pass_and_fail_make_the_input(gaps, spark):
    n, lone = gaps.count(), gaps.filter("BARCODE IS NULL").count()
    assert lone > 0
    good, bad = (sets.unify_delete(gaps, keep=k) for k in ("pass", "fail"))
    assert good.count() + bad.count() == n and bad.filter("BARCODE IS NULL").count() == lone
    offsets = spark.createDataFrame([("IGH", 0), ("IGK", 2), ("IGL", 1)], "primer string, offset int")
    good, bad = (sets.align_offset(gaps, offsets, keep=k) for k in ("pass", "fail"))
    assert good.count() + bad.count() == n == sets.align_offset(gaps, offsets, keep="both").count()
    assert bad.filter("BARCODE IS NULL").count() == lone


def test_sorted_parts_keep_reads_without_the_field(gaps):
    assert split.sort_reads(gaps, "BARCODE", max_count=500).count() == gaps.count()


def test_cut_fastq_is_an_error(spark, tmp_path):
    whole = "@a\nACGT\n+\nIIII\n@b\nAC\n+\nII\n"
    for text, cut in ((whole, False), (whole + "\n\n", False), (whole + "@c\nACGT\n", True), ("@c\nAC", True)):
        path = tmp_path / f"{len(text)}.fastq"
        path.write_text(text)
        if cut:
            with pytest.raises(Exception, match="ends inside a record"):
                read_fastq(spark, f"file:{path}").collect()
        else:
            assert read_fastq(spark, f"file:{path}").count() == 2


def test_headers_of_many_parts(spark):
    from vdjloom.sources.text import parse_header
    head = "id|" + "|".join(f"K{i}=v{i}" for i in range(12_000))
    assert parse_header(spark.createDataFrame([(head,)], "header string"), ["K11999"]).first()["K11999"] == ["v11999"]


def test_collapse_counts_reads_that_share_a_number(spark):
    from vdjloom.operators.collapse import collapse
    rows = [(1, "a", "ACGT"), (1, "b", "ACGTA"), (1, "b", "ACGTA"), (1, "c", "ACGT"), (2, "d", "ACNT"), (None, "e", "ACGT")]
    reads = spark.createDataFrame(rows, "seq_no bigint, read_id string, seq string")
    for missing in (0, 1):
        unique = collapse(reads, max_missing=missing).collect()
        rest = collapse(reads, max_missing=missing, output="duplicate").count()
        none = collapse(reads, max_missing=missing, output="undetermined").count()
        assert {r["seq"]: r["DUPCOUNT"] for r in unique} == {"ACGT": ["4" if missing else "3"], "ACGTA": ["2"]}
        assert len(unique) + rest + none == len(rows)


def test_numbers_are_kept_or_refused(spark):
    reads = spark.createDataFrame([("a", ["1"]), ("b", None), ("c", [""]), ("d", ["7.5"])], "read_id string, N array<string>")
    parts = {r["read_id"]: r["part"] for r in split.mark_threshold(reads, "N", 2).collect()}
    assert parts == {"a": "under", "b": "under", "c": "under", "d": "atleast"}
    bad = reads.withColumn("N", F.when(F.col("read_id") == "a", F.array(F.lit("NA"))).otherwise(F.col("N")))
    for out in (split.mark_threshold(bad, "N", 2), *split.split_threshold(bad, "N", 2).values()):
        with pytest.raises(Exception, match="N is no number: NA"):
            out.collect()


def test_samples_of_groups_cut_into_slices(gaps, monkeypatch):
    def drawn(**of):
        return sorted((r["read_id"], r["sample_size"]) for r in split.sample_reads(
            gaps, [5, 130, 10 ** 9], seed=2, **of).select("read_id", "sample_size").collect())

    whole = [drawn(), drawn(field="BARCODE"), drawn(field="PRIMER"), drawn(field="PRIMER", values=["IGH"])]
    monkeypatch.setattr(split, "SLICE", 40)
    assert whole == [drawn(), drawn(field="BARCODE"), drawn(field="PRIMER"), drawn(field="PRIMER", values=["IGH"])]
    assert sum(size == 10 ** 9 for _, size in whole[1]) == gaps.count()


def test_a_coordinate_that_repeats_in_mate_1_is_an_error(spark, sf_dir):
    one, two = r1(spark, sf_dir), r2(spark, sf_dir)
    with pytest.raises(Exception, match="occurs more than once"):
        pairs.pair_reads(one.union(one.limit(5)), two)[1].collect()


def test_mates_that_no_rule_pairs_are_an_error(spark):
    def mates(*names):
        return spark.createDataFrame([(n, "ACGT", k) for k, n in enumerate(names)], "read_id string, seq string, seq_no bigint")

    out = assembly.assemble_join(mates("E.1 1 length=4", "E.2 1 length=4"), mates("E.2 2 length=4", "E.1 2 length=4"))
    assert sorted(r["read_id"] for r in out.collect()) == ["E.1", "E.2"]
    with pytest.raises(ValueError, match="mates do not match"):
        assembly.assemble_join(mates("E.1 1"), mates("E.2 2"))


def test_the_overlap_search_runs_once(spark, sf_dir):
    one, two = pairs.pair_reads(r1(spark, sf_dir), r2(spark, sf_dir))
    plan = assembly.assemble_align(one, two, check=False)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_paths_without_a_scheme(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@a\nACGT\n+\nIIII\n")
    assert read_fastq(spark, str(tmp_path)).count() == read_fastq(spark, f"{tmp_path}/a.fastq,{tmp_path}/a.fastq").count() - 1 == 1
