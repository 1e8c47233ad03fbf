"""Primer sets as a join: equal to the literal form, odd rows, refusals."""

import pytest
from pyspark.sql import functions as F

from vdjloom.catalog.primers import LONG, SHORT
from vdjloom.operators.primerjoin import primers_score_many
from vdjloom.operators.primers import primers_score
from vdjloom.sources import derived, text


def _table(spark, primers):
    return spark.createDataFrame(
        [(i, n, s) for i, (n, s) in enumerate(primers.items())], "ord int, name string, seq string")


@pytest.mark.parametrize("primers,options", [
    (SHORT, {"start": 3, "max_error": 0.2, "mode": "cut", "barcode": True}),
    (SHORT, {"start": 4, "max_error": 0.2, "mode": "mask", "rev_primer": True}),
    (LONG, {"start": 0, "max_error": 0.2, "mode": "trim"}),
    (LONG, {"start": 2, "max_error": 0.1, "mode": "tag", "rev_primer": True}),
])
def test_join_equals_literals(spark, sf_dir, primers, options):
    """Also with 60 primers cut out of reads, a quarter of them repeated, so that hits and ties occur."""
    df = derived.mate(spark, sf_dir, 1)
    begin = options["start"]
    cut = [r[0] for r in df.orderBy("seq_no").limit(60).select("seq").collect()]
    tail = options.get("rev_primer", False)
    more = {f"C{i}": s[begin:begin + 12 + i % 7].replace("N", "R") for i, s in enumerate(cut)}
    if tail:
        more = {f"C{i}": s[40 - begin - 12 - i % 7:40 - begin].translate(str.maketrans("ACGTN", "TGCAY"))[::-1]
                for i, s in enumerate(cut)}
    every = {**primers, **more, **{f"D{i}": more[f"C{i}"] for i in range(15)}}
    a = primers_score(df, every, keep="both", **options)
    b = primers_score_many(df, _table(spark, every), keep="both", **options)
    assert a.filter("_pass").count() > 60
    assert a.exceptAll(b.select(a.columns)).count() == 0 and b.select(a.columns).exceptAll(a).count() == 0


def test_odd_reads_and_primers(spark):
    df = spark.createDataFrame([("a", "ACGTACGTAA"), ("a", "ACGTACGTAA"), ("b", None), ("c", ""), ("d", "ACG"), (None, "NNNNNNNNNN")],
                               "read_id string, seq string").withColumn("name", F.lit("x")).withColumn("ord", F.lit(9))
    table = _table(spark, {"P": "ACGTACGT", "Q": "acgtacgu"})
    rows = primers_score_many(df, table, keep="both", mode="tag").collect()
    assert sorted((str(r.read_id), r._pass, r.PRIMER) for r in rows) == [
        ("None", False, None), ("a", True, ["P"]), ("a", True, ["P"]), ("b", False, None), ("c", False, None), ("d", False, None)]
    assert {r.name for r in rows} == {"x"} and {r.ord for r in rows} == {9}
    assert primers_score_many(df.limit(0), table, mode="tag").count() == 0
    for bad, message in (({}, "no primers"), ({"P": "ACX"}, "unknown"), ({"P": ""}, "unknown"), ({"P": "NNNNN"}, "other than N")):
        with pytest.raises(ValueError, match=message):
            primers_score_many(df, _table(spark, bad))


def test_primer_table_has_no_limit(spark, tmp_path):
    path = tmp_path / "p.fasta"
    path.write_text("".join(f">V{i}\nACGT{'ACGT'[i % 4]}C\n" for i in range(12_000)))
    table = text.read_primer_table(spark, str(path))
    assert table.count() == 12_000 and table.agg(F.count_distinct("ord")).first()[0] == 12_000
    assert table.orderBy("ord").select("name", "seq").first() == ("V0", "ACGTAC")
