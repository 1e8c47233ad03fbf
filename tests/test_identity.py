"""Reads that share an id, a number or a coordinate, and reads without a field."""

import pytest
from pyspark.sql import functions as F

from vdjloom.operators import assembly, filters, sets, split
from vdjloom.sources import text

READ = "read_id string, seq string, qual array<tinyint>, seq_no bigint, TAG array<string>"


def reads(spark, *rows):
    return spark.createDataFrame([(i, seq, [40] * len(seq), no, tag) for i, seq, no, tag in rows], READ)


def test_one_first_record_per_id_whatever_ties(spark):
    df = reads(spark, ("a", "AC", 1, None), ("a", "GT", 1, None), ("a", "GT", 1, None), ("a", "AA", 0, ["x"]), ("a", "AA", 0, ["x"]),
               ("b", "AC", 5, None), (None, "CC", 2, None), (None, "CG", 1, None))
    passed, failed = (filters.first_by_id(df, keep=k) for k in ("pass", "fail"))
    assert sorted(map(tuple, passed.select("read_id", "seq").collect()), key=str) == [("a", "AA"), ("b", "AC"), (None, "CG")]
    assert passed.unionByName(failed).exceptAll(df).isEmpty() and passed.count() + failed.count() == df.count()
    both = filters.first_by_id(df, keep="both")
    assert both.count() == 8 and both.filter("_pass").count() == 3


@pytest.mark.parametrize("negate", [False, True])
def test_table_and_list_select_the_same_reads(spark, negate):
    df = reads(spark, ("a", "AC", 1, ["x", "y"]), ("a", "GT", 1, ["p", "q"]), ("a", "GG", 1, ["x"]), ("b", "AC", 1, None), ("c", "AC", 1, []),
               ("d", "AC", 1, ["p", None, "x"]), ("e", "AC", 1, [None]), ("e", "AC", 1, [None]))
    table = spark.createDataFrame([("x",), ("x",), (None,)], "v string")
    by_list, by_table = (split.select_reads(df, "TAG", v, negate) for v in (["x"], table))
    assert by_table.exceptAll(by_list).isEmpty() and by_list.exceptAll(by_table).isEmpty()
    assert by_list.count() == (5 if negate else 3)


def test_repeated_coordinates_stop_assembly(spark):
    once = reads(spark, ("a|X=1", "ACGTACGTACGT", 1, None), ("b|X=1", "ACGTACGTACGT", 2, None))
    twice = once.unionByName(reads(spark, ("a|X=2", "ACGTACGTACGT", 3, None)))
    assert assembly.assemble_join(once, once).count() == 2
    for head, tail in ((twice, once), (once, twice), (twice, twice)):
        for make in (assembly.assemble_join, assembly.assemble_align):
            with pytest.raises(ValueError, match="more than once"):
                make(head, tail)


def test_repeated_id_stops_tag_extraction(spark):
    r1 = reads(spark, ("a", "A" * 26, 1, None), ("b", "C" * 26, 2, None))
    assert text.extract_10x_tags(r1, r1).count() == 2
    with pytest.raises(Exception, match="more than once"):
        text.extract_10x_tags(r1.union(r1), r1).collect()


def test_reads_without_a_set_fail_as_one_in_every_copy_mode(spark):
    df = reads(spark, ("a", "AC", 1, ["x"]), ("b", "AC", 2, ["x"]), ("c", "AG", 3, ["y"]), ("d", "AG", 4, None)).withColumn(
        "BARCODE", F.when(F.col("seq_no") < 3, F.array(F.lit("u"))))
    for action in ("set", "majority"):
        out = {k: sets.build_consensus(df, copy=[("TAG", action)], keep=k) for k in ("pass", "fail", "both")}
        assert [r.read_id for r in out["pass"].collect()] == ["u"]
        assert [(r.read_id, r.reason, r.CONSCOUNT) for r in out["fail"].collect()] == [(None, "BARCODE", ["2"])]
        assert out["both"].count() == 2
