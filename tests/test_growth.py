"""Findings of round 3 on growth: each step on a small input that shows what it no longer moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1
from vdjloom.functions import durable
from vdjloom.operators import cells
from vdjloom.operators.collapse import collapse


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fragments_are_made_by_group(spark, sf_dir):
    """Digests of fragments are below the join with the groups, not above the grouped rows."""
    plan = _plan(r1(spark, sf_dir).select("seq"))
    assert plan.index("md5") > plan.index("Aggregate"), plan


def test_frequent_tokens_are_not_joined(spark, monkeypatch):
    """Tokens of most chain fields stay out of the join with the contigs, unless they are contigs themselves."""
    rows = [(f"c{i % 7}", f"IGHV1,*,{i}.0,k{i},9", "*" if i % 3 else "IGHV1,7,hot,x", i) for i in range(600)]
    report = spark.createDataFrame(rows, "barcode string, chain1 string, chain2 string, seq_no bigint")
    ids = spark.createDataFrame([(f"k{i}",) for i in range(0, 600, 2)] + [("hot",)], "sequence_id string")
    got = {(r.place.seq_no, r.place._at, r.cell, r.contig, r.reads) for r in cells.named_contigs(report, ids).collect()}
    want = {(i, 0, f"c{i % 7}", f"k{i}", i) for i in range(0, 600, 2)}
    want |= {(i, 1, f"c{i % 7}", "hot", 7) for i in range(0, 600, 3)}
    assert got == want
    tokens = cells.chain_fields(report).select(F.explode("tokens").alias("token"))
    left = {r.token: r.n for r in cells._rare_tokens(tokens, ids).groupBy("token").agg(F.count("*").alias("n")).collect()}
    assert max(n for t, n in left.items() if t != "hot") < cells.OFTEN and left["hot"] == 200 and "k1" in left


def test_merged_annotations_move_once(spark):
    """The last non-empty value of every column, without an aggregate that holds an order for each column."""
    one = spark.createDataFrame([("a", "x", "", 1), ("a", "", "p", 2), ("b", None, None, 3), (None, "z", "z", 4)], "id string, u string, v string, seq_no bigint")
    two = spark.createDataFrame([("a", "q", 1), ("c", "r", 2), ("", "s", 3)], "id string, v string, seq_no bigint")
    merged = cells.merge_annotations([(one, "id"), (two, "id")])
    assert {(r.sequence_id, r.u, r.v) for r in merged.collect()} == {("a", "x", "q"), ("b", "", ""), ("c", "", "r")}
    assert "Aggregate" not in _plan(merged)


def test_ranges_of_a_large_file_are_bounded(tmp_path):
    """Short ranges of a large input are drawn out, so that tasks do not grow with it; every byte is in one range."""
    from vdjloom.sources import fastq
    path = tmp_path / "large.fastq"
    with open(path, "wb") as f:
        f.truncate(6 << 30)  # sparse, only its size is read
    ranges = fastq.FastqReader({"path": str(path), "splitBytes": 1 << 18}).partitions()
    assert len(ranges) <= fastq.MOST_RANGES and ranges[0].begin == 0 and ranges[-1].end == 6 << 30
    assert all(a.end == b.begin for a, b in zip(ranges, ranges[1:]))


def test_mates_are_made_once_for_check_and_join(spark):
    """The check of the mates and their join read what was written once, under either rule."""
    from vdjloom.operators import assembly
    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    rows = [(f"x{i}", "ACGTACGT", i) for i in range(50)]
    head, tail = [spark.createDataFrame(rows, "id string, seq string, seq_no bigint").select(
        touch(F.concat("id", F.lit(f" {m}"))).alias("read_id"), "seq", "seq_no", F.array(F.lit("v")).alias("V")) for m in (1, 2)]
    got = assembly.assemble_join(head, tail, gap=1, head_fields=("V",)).collect()
    assert {(r.read_id, r.seq, r.seq_no, r.V[0]) for r in got} == {(f"x{i}", "ACGTACGTNACGTACGT", i, "v") for i in range(50)}
    assert seen.value == 100


def _counted(spark, seen):
    """3,000 reads of 6 sequences, some equal in every column; making a read_id is counted."""
    touch = F.udf(lambda s: seen.add(1) or s, "string")
    rows = [(f"r{i}", "ACGT"[i % 4] * 3 + "AC"[i % 2 * (i // 8 % 2)], i, f"s{i % 7}", f"{i % 5}", [f"t{i % 3}", "t1"] if i % 4 else []) for i in range(2_990)]
    rows += rows[:1] * 5 + [("x", *r[1:]) for r in rows[1:6]]
    df = spark.createDataFrame(rows, "name string, seq string, seq_no bigint, s string, m string, T array<string>")
    return rows, df.select(touch("name").alias("read_id"), "seq", "seq_no", F.array("s").alias("S"), F.array("m").alias("M"), "T")


def test_collapse_makes_reads_about_once(spark):
    """Groups, representatives and copied fields take one pass over whole reads; the next one makes few of them."""
    seen = spark.sparkContext.accumulator(0)
    rows, df = _counted(spark, seen)
    got = {r.seq: (r.S, r.T, r.M, int(r.DUPCOUNT[0])) for r in collapse(
        df, copy={"S": "set", "T": "first", "M": "sum"}).collect()}
    assert seen.value < 1.5 * len(rows), seen.value
    for seq in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == seq), key=lambda r: r[2])
        assert got[seq] == (list(dict.fromkeys(r[3] for r in mine)), next((r[5][:1] for r in mine if r[5]), None),
                            [str(sum(int(r[4]) for r in mine))], len(mine))
    assert len(got) == len({r[1] for r in rows})


def test_duplicates_are_not_dealt_out_by_read(spark):
    """All reads but one of each sequence, with copies; only reads with a representative's number are made whole again."""
    seen = spark.sparkContext.accumulator(0)
    rows, df = _counted(spark, seen)
    out = collapse(df, output="duplicate")
    assert {r.seq: r["count"] for r in out.groupBy("seq").count().collect()} == {
        s: sum(r[1] == s for r in rows) - 1 for s in {r[1] for r in rows}}
    assert seen.value < 1.5 * len(rows), seen.value
    assert len(out.collect()) == len(rows) - len({r[1] for r in rows})


def test_places_are_never_missed(spark):
    kept = spark.range(-50, 5_000, 7)
    held = [r.id for r in spark.range(-50, 20_000).filter(durable.may_hold(durable.checkpoint(kept), "id", F.col("id"))).collect()]
    assert set(range(-50, 5_000, 7)) <= set(held) and len(held) < 3_000


def test_regions_that_read_alike_are_aligned_once(spark, monkeypatch):
    """600 reads of 3 regions, one of them hit exactly: the helper places two regions, and all reads get their hit."""
    from vdjloom.operators import primers
    seen, real = spark.sparkContext.accumulator(0), primers.best_alignment
    touch = F.udf(lambda s: (s is not None and seen.add(1)) or s, "string")
    monkeypatch.setattr(primers, "best_alignment", lambda *a: lambda f, r: real(*a)(touch(f), r))
    seqs = ["TTACGTACGTGG", "TTACGAACGTGG", "CCCCCCCCCCCC"]
    df = spark.createDataFrame([(f"r{i}", seqs[i % 3] + "ACGT"[i % 4] * 5, i) for i in range(600)], "read_id string, seq string, seq_no bigint")
    kinds = {k: primers.primers_align(df, {"P": "ACGTACGT"}, max_error=0.2, max_len=12, skip_rc=True, mode="cut", keep=k) for k in ("pass", "fail")}
    assert {(r.read_id, r.seq, r.PRIMER[0]) for r in kinds["pass"].collect()} == {
        (f"r{i}", "GG" + "ACGT"[i % 4] * 5, "P") for i in range(600) if i % 3 < 2}
    assert kinds["fail"].count() == 200 and 0 < seen.value <= 2 * 2, seen.value
