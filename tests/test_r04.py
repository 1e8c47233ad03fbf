"""Findings of round 4, each on a small input that shows what the step no longer does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vdjloom.catalog.common import r1
from vdjloom.operators import assembly
from vdjloom.operators.filters import filter_quality
from vdjloom.operators.pairs import pair_reads, pair_reads_once
from vdjloom.plans import flagship
from vdjloom.sources import derived
from vdjloom.sources.schema import plain_id


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_made_once_for_the_quality_filter(spark, sf_dir):
    """F1: the filter asks a bound column; its condition does not make the scores of a read anew for each of them."""
    plan = _plan(filter_quality(r1(spark, sf_dir), 24))
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("md5" in line or "aggregate" in line for line in filters), plan


def test_quality_filter_keeps_its_outputs(spark):
    rows = [("a", "ACGT", [20, 20, 20, 20]), ("b", "NACG", [0, 20, 20, 20]), ("c", "ACGT", [19, 20, 20, 20]),
            ("d", "NN", [40, 40]), ("e", None, [40]), ("f", "AC", None)]
    df = spark.createDataFrame(rows, "read_id string, seq string, qual array<tinyint>")
    kept = {k: filter_quality(df, 20, keep=k) for k in ("pass", "fail", "both")}
    assert {r.read_id for r in kept["pass"].collect()} == {"a", "b"}
    assert {r.read_id for r in kept["fail"].collect()} == {"c", "d", "e", "f"}
    assert {r.read_id: r._pass for r in kept["both"].collect()} == {c: c in "ab" for c in "abcdef"}
    assert kept["pass"].columns == df.columns and kept["both"].columns == [*df.columns, "_pass"]


def test_consensus_reads_are_made_once(spark, sf_dir):
    """the collapse reads written consensus reads; the result's plan does not go back to the table."""
    plan = _plan(flagship.unique_consensus(spark, sf_dir))
    assert "l_orderkey" not in plan, plan


def _exchanges(df):
    """Shuffles of the physical plan, and what is between them, without automatic broadcast."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return [line for line in df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
                if line.strip(" :+-").startswith("Exchange ")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mates_stay_where_they_were_dealt(spark, sf_dir):
    """reads lie by their name, so pairing and assembling move no read."""
    from vdjloom.catalog import assembly as queries
    a, b = queries._mates(spark, sf_dir)
    for df in (a, b, assembly.prepare(a, b, check=False)):
        moves = _exchanges(df)
        assert moves and all("REPARTITION_BY_NUM" in line for line in moves), moves
    placed = assembly.place_on_reference(
        assembly.prepare(a, b, check=False).select("read_id", "_h", "_t"), derived.fragments(spark, sf_dir), 11, 1, 100, 1)
    assert all("REPARTITION_BY_NUM" in line for line in _exchanges(placed)), _exchanges(placed)


def test_a_join_by_coordinate_serves_the_next_one(spark):
    """mates under raw names move once for pairing and assembling, as both join on the same expression."""
    rows = [(f"x{i}|A={i}", "ACGT", i) for i in range(9)]
    r1, r2 = [spark.createDataFrame(rows[m:], "read_id string, seq string, seq_no bigint") for m in (0, 1)]
    pairs = assembly.prepare(*pair_reads(r1, r2), check=False)
    assert {r.read_id for r in pairs.collect()} == {f"x{i}" for i in range(1, 9)}
    assert len(_exchanges(pairs)) == 5, _exchanges(pairs)  # each mate, its keys, and those of mate 1 once more


def test_checked_mates_are_joined_once(spark):
    """mates under plain ids are written side by side; what does not pair stops the run or is tried under the next rule."""
    schema = "read_id string, header string, seq string, seq_no bigint"

    def plain(names, header="{} {}"):
        return [plain_id(spark.createDataFrame([(n, header.format(n, m), "ACGT", i) for i, n in enumerate(names)], schema)) for m in (1, 2)]

    head, tail = plain(["a", "b", "c"])
    got = assembly.assemble_join(head, tail, gap=1)
    assert {(r.read_id, r.seq) for r in got.collect()} == {(n, "ACGTNACGT") for n in "abc"}
    assert not _exchanges(got)
    for bad, words in ((tail.filter("read_id <> 'b'"), "1 keys only in head, 0 only in tail"), (tail.union(tail), "more than once")):
        with pytest.raises(ValueError, match=words):
            assembly.assemble_join(head, bad)
    renamed = plain_id(tail.withColumn("read_id", F.concat("read_id", F.lit("x"))))  # their headers still agree
    assert {r.read_id for r in assembly.assemble_join(head, renamed).collect()} == {"a", "b", "c"}
    wrong = plain_id(spark.createDataFrame([("a|X=1", "a", "ACGT", 1)], schema))
    with pytest.raises(Exception, match="marked as plain"):
        pair_reads(wrong, tail)[0].collect()


def test_pairs_made_once_are_pair_reads(spark):
    """both outputs of the pairing read pairs that were written once; each read is made once."""
    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    schema = "read_id string, seq string, seq_no bigint, src string"
    r1 = spark.createDataFrame([(f"x{i}", "AC", i, f"p{i}") for i in range(6)], schema)
    r2 = spark.createDataFrame([(f"x{i}", "GT", i, f"q{i}") for i in range(3, 9)], schema)
    r1, r2 = r1.withColumn("V", F.array("src")).drop("src"), r2.withColumn("W", F.array("src")).drop("src")
    for f1, f2 in (((), ("W",)), (("V",), ()), (("V",), ("W",))):
        plain = pair_reads(r1, r2, f1, f2)
        seen.value = 0
        once = pair_reads_once(r1.withColumn("read_id", touch("read_id")), r2.withColumn("read_id", touch("read_id")), f1, f2)
        for a, b in zip(plain, once):
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and b.count() == 3
        assert seen.value == 12, seen.value
    with pytest.raises(Exception, match="more than once"):
        pair_reads_once(r1.union(r1), r2)


def test_contigs_of_a_report_are_named_once(spark, sf_dir, monkeypatch):
    """F2, F8, F12: the report is searched for contigs once, and frequent tokens are found without moving tokens."""
    from vdjloom.catalog import cells as queries
    from vdjloom.operators import cells
    calls, real = [], cells.named_contigs
    monkeypatch.setattr(cells, "named_contigs", lambda *a: calls.append(1) or real(*a))
    queries.QUERIES["snk4_assembler"][0](spark, sf_dir)
    queries.QUERIES["sc5_assembler_report"][0](spark, sf_dir)
    assert len(calls) == 2
    tokens = spark.createDataFrame([("a",)] * 150 + [("b",)] * 99 + [("k",)] * 200 + [(None,)] * 300, "token string")
    left = cells._rare_tokens(tokens, spark.createDataFrame([("k",)], "sequence_id string"))
    assert {r.token: r["count"] for r in left.groupBy("token").count().collect()} == {"b": 99, "k": 200, None: 300}
