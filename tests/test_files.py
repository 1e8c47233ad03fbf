"""FASTQ scan, streaming and plan shapes."""

import gzip

import pytest
from pyspark.sql import functions as F

from vdjloom import streaming
from vdjloom.functions import quality
from vdjloom.operators import filters, headers, primers, sets
from vdjloom.operators.collapse import collapse
from vdjloom.sources import derived, fastq, sinks, text


def _awkward(n=400):
    """Records whose qualities open with @ and +, and headers that hold an @."""
    out = []
    for i in range(n):
        size = 5 + i % 23
        out.append((f"M@X:{i}|BARCODE=AC,GT", "ACGT" * 8, ("@+I#" * 8)[i % 4:][:size]))
    return [(h, s[:len(q)], q) for h, s, q in out]


@pytest.mark.parametrize("split", [37, 100, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_split_finds_every_record(spark, tmp_path, split, end):
    rows = _awkward()
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@{h}{end}{s}{end}+{end}{q}{end}" for h, s, q in rows), newline="")
    df = fastq.read_fastq(spark, str(path), ["BARCODE"], split_bytes=split)
    got = df.orderBy("seq_no").select(
        "header", "seq", quality.encode(F.col("qual")).alias("q"), "BARCODE").collect()
    assert [(r.header, r.seq, r.q) for r in got] == rows
    assert got[0].BARCODE == ["AC", "GT"]


def test_gzip_and_broken_files(spark, tmp_path):
    rows = _awkward(50)
    body = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows)
    (tmp_path / "a.fastq.gz").write_bytes(gzip.compress(body.encode()))
    assert fastq.read_fastq(spark, str(tmp_path / "a.fastq.gz")).count() == 50
    (tmp_path / "b.fastq").write_text("@a\nACGT\n+\nIII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        fastq.read_fastq(spark, str(tmp_path / "b.fastq")).collect()


def test_fasta_bodies_over_many_lines(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x|A=1\nACGT\nAC\n>two\nGG\n\n>three\r\nT\r\nT\r\n")
    rows = text.read_fasta(spark, str(tmp_path / "a.fasta"), ["A"]).orderBy("seq_no").collect()
    assert [(r.header, r.seq) for r in rows] == [
        ("one x|A=1", "ACGTAC"), ("two", "GG"), ("three", "TT")]
    assert rows[0].A == ["1"] and rows[1].A is None


def test_final_fasta_wraps_at_seventy(spark):
    df = spark.createDataFrame([("a", "A" * 140), ("b", "C" * 141)],
                               "sequence_id string, sequence string")
    lines = [r[0].split("\n")[1:] for r in df.select(sinks.final_fasta_text()).collect()]
    assert [[len(x) for x in block] for block in lines] == [[70, 70], [70, 70, 1]]


def test_stateless_operators_take_a_stream(spark, sf_dir, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    reads = derived.mate(spark, sf_dir, 1)
    reads.write.parquet(source)
    steps = [
        lambda df: filters.filter_quality(df, 25),
        lambda df: primers.primers_extract(df, 6, mode="cut", barcode=True),
        lambda df: headers.add_fields(df, {"RUN": "R1"}),
    ]
    streaming.run_available(streaming.stream_reads(spark, source, reads.schema), steps, target,
                            str(tmp_path / "check"))
    expected = reads
    for step in steps:
        expected = step(expected)
    got = spark.read.parquet(target)
    assert got.count() == expected.count() > 0
    assert got.exceptAll(expected.select(*got.columns)).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, sf_dir, tmp_path):
    derived.mate(spark, sf_dir, 1).write.parquet(str(tmp_path / "reads"))
    reads = spark.read.parquet(str(tmp_path / "reads"))
    stateless = headers.add_fields(primers.primers_score(
        filters.filter_length(reads, 30), {"A": "ACGT", "B": "GGRN"}, 3), {"X": "1"})
    plan = _plan(stateless)
    assert "Exchange" not in plan and "Join" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    for df in (sets.build_consensus(reads, primer_field="PRIMER", primer_freq=0.5),
               collapse(reads, uniq=("SAMPLE",)), filters.filter_missing(reads, 0)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
        assert "Python" not in plan
    exploded = _plan(sets.position_counts(reads.withColumn("s", F.element_at("BARCODE", 1)), ["s"]))
    assert "SortAggregate" not in exploded and exploded.count("HashAggregate") == 2
    # Whole reads move, bases don't: the only exchange lies below the explode.
    assert exploded.count("Exchange") == 1 and exploded.index("Generate") < exploded.index("Exchange")
    exact = _plan(collapse(reads, uniq=("SAMPLE",)).select("seq"))
    assert "SortAggregate" not in exact


def test_column_pruning_reaches_the_scan(spark, sf_dir, tmp_path):
    derived.mate(spark, sf_dir, 1).write.parquet(str(tmp_path / "reads"))
    plan = _plan(filters.filter_length(spark.read.parquet(str(tmp_path / "reads")), 30)
                 .select("read_id"))
    assert "ReadSchema: struct<read_id:string,seq:string>" in plan


def test_table_fingerprint_sees_content_only(spark):
    rows = [("a", None, 1), ("a", "", 1), ("b", "x", None), ("b", "x", None)]
    df = spark.createDataFrame(rows, "k string, `v.w` string, n int")
    one = lambda x: sinks.whole_fingerprint(sinks.table_fingerprint(x)).first()
    base = one(df)
    assert base == one(df.repartition(3, "k").select("n", "`v.w`", "k")) and base.n_rows == 4
    assert base.sha256 != one(df.distinct()).sha256
    assert base.sha256 != one(spark.createDataFrame([("a", "", 1)] * 2 + rows[2:], df.schema)).sha256
    assert one(df.limit(0)).n_rows == 0


def test_profile_summary(spark):
    df = spark.createDataFrame([("a|X=1",), ("b|y",), ("c",), (None,), ("d=1",)], "header string")
    assert tuple(text.profile_summary(df).first()) == (5, 1, True)
    assert tuple(text.profile_summary(df.where("header = 'c'")).first()) == (1, 0, False)
