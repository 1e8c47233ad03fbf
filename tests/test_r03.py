"""Findings of round 3, each with the input that showed it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.llm import rollup
from vdjloom.operators import primerjoin, split
from vdjloom.sources import sinks


def test_rates_round_their_exact_value(spark):
    rates = [111483 / 6000000, 0.0078125, 1e-9, 0.5, None]
    shown = sinks.error_text(spark.createDataFrame([(i, r) for i, r in enumerate(rates)], "i int, error double"))
    assert {int(r.i): r.error for r in shown.collect()} == {
        i: "NA" if r is None else "%.6f" % r for i, r in enumerate(rates)}


def test_rollup_reports_first_copies_and_marks(spark):
    rows = [(3, "a b - c", "s", "en"), (1, "a b - c", "t", None), (None, "a b - c", "s", "en"), (1, None, "s", "en"), (2, "--", None, "en")]
    got = {(r.source, r.lang, r.version): tuple(r)[3:] for r in rollup.token_counts(
        spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")).collect()}
    assert got == {
        ("s", "en", "spaced"): (3, 8, 1, 0), ("s", "en", "words"): (3, 6, 1, 0),
        ("t", None, "spaced"): (1, 4, 1, 3), ("t", None, "words"): (1, 3, 1, 3),
        (None, "en", "spaced"): (1, 1, 1, 0), (None, "en", "words"): (1, 0, 1, 0)}


def test_primers_that_read_alike_are_one(spark):
    primers = spark.createDataFrame([(9, "x", "ACGTACGT"), (2, "y", "acgtacgt"), (5, None, "ACGTACGT"), (1, "z", "ACGTRCGT")],
                                    "ord bigint, name string, seq string")
    table, width = primerjoin._prepared(primers, 0.2, False)
    assert {(r._ord, r._name) for r in table.collect()} == {(2, "y"), (1, "z")} and width == 8


def test_parts_over_many_blocks(spark, monkeypatch):
    """Chains that pass several blocks, by a greedy loop; few rounds of jumps however many parts."""
    import random
    from vdjloom.functions import ordering
    pick = random.Random(5)
    counts = [(f"v{i:05d}", pick.choice([1, 1, 2, 3, 9])) for i in range(3_000)]
    reads = spark.createDataFrame([(v, k * 100 + i) for k, (v, n) in enumerate(counts) for i in range(n)], "v string, seq_no bigint")
    # Each read is a job's worth of rounds only in the number of blocks, not of parts.
    written, plain = [], split.checkpoint
    monkeypatch.setattr(split, "checkpoint", lambda df: written.append(1) or plain(df))
    got = {(r.V[0], r.part) for r in split.sort_reads(
        reads.select(F.array("v").alias("V"), "seq_no"), "V", max_count=7).select("V", "part").distinct().collect()}
    part, used, want = 1, 0, set()
    for v, n in counts:
        if used and used + n > 7:
            part, used = part + 1, 0
        used += n
        want.add((v, part))
    assert got == want and len(written) <= 5 + 2 * 5
    assert ordering.BITS == 16


def test_few_values_and_groups_do_not_move_the_reads(spark):
    """Neither a selection by a small table nor a sample by group deals the reads out by their value."""
    reads = spark.range(5_000).select(F.concat(F.lit("r"), "id").alias("read_id"), F.lit("ACGT").alias("seq"), F.col("id").alias("seq_no"),
                                      F.array(F.when(F.col("id") % 9 == 0, "b").otherwise("a")).alias("V")).repartition(4)
    plans = {}
    for negate, want in ((False, 556), (True, 4_444)):
        plans[negate] = split.select_reads(reads, "V", spark.createDataFrame([("b",), ("c",)], "v string"), negate=negate)
        assert plans[negate].count() == want
    plans["sample"] = split.sample_reads(reads, [50], field="V", seed=3)
    assert {r["v"]: r["n"] for r in plans["sample"].groupBy(F.col("V")[0].alias("v")).agg(F.count("*").alias("n")).collect()} == {"a": 50, "b": 50}
    for df in plans.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)"), plan


def test_records_are_validated_in_one_pass(spark):
    """The first valid record per id, made once and without a join of the records with themselves."""
    from vdjloom.operators import cells, filters
    seen = spark.sparkContext.accumulator(0)
    touch = F.udf(lambda s: seen.add(1) or s, "string").asNondeterministic()
    rows = [("a", "AC GT", 1), ("a", "ACGT", 3), ("a", "TTTT", 2), ("b", "GG", 1), (None, "CC", 2), (None, "AA", 1)]
    df = spark.createDataFrame(rows, "sequence_id string, sequence string, seq_no bigint")
    good = cells.validate_records(df.withColumn("sequence", touch("sequence")))
    assert {tuple(r) for r in good.collect()} == {("a", "TTTT", 2), ("b", "GG", 1), (None, "AA", 1)}
    assert seen.value == len(rows)
    plan = filters.first_by_id(df, "sequence_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_seeds_of_reads_do_not_move(spark):
    """With a small reference set the k-mers of the reads are neither shuffled nor sorted to meet the index."""
    from vdjloom.operators import assembly
    import random
    pick = random.Random(1)
    refs = [(f"F{i}", "".join(pick.choice("ACGT") for _ in range(64))) for i in range(20)]
    pairs = spark.createDataFrame([(f"r{i}", s[:26], s[-26:]) for i, (_, s) in enumerate(refs)], "read_id string, _h string, _t string")
    placed = assembly.place_on_reference(pairs, spark.createDataFrame(refs, "name string, seq string"), 11, 1, 100, 1)
    assert {(r.read_id, r.ref, r.hp, r.tp) for r in placed.collect()} == {(f"r{i}", f"F{i}", 0, 38) for i in range(20)}
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 2


def test_reads_are_made_by_compiled_code(spark, sf_dir):
    """Java leaves methods over 8,000 bytes uncompiled; a hash of whole derived reads of both mates was one."""
    from vdjloom.functions import bases
    from vdjloom.sources import derived
    reads = derived.reads(spark, sf_dir)
    package = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # code is made once the plan is final
    try:
        codes = package.codegenStringSeq(reads.agg(F.max(F.xxhash64(*reads.columns)))._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert codes.size() and max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) < 4_000
    digest = "0123456789abcdef" + "f0e1d2c3b4a59687"
    got = spark.createDataFrame([(digest,)], "d string").select(derived._scores(F.col("d")).alias("q")).first().q
    assert got == [ord(derived.PHRED[int(c, 16)]) - 33 for c in (digest + digest)[:40]]
    texts = spark.createDataFrame([("",), ("AC-GN.n",), ("NNNN",), (None,)], "s string")
    counts = texts.select(bases.count_missing(F.col("s")).alias("n"), bases.count_missing(F.col("s"), ".-N").alias("m")).collect()
    assert [tuple(r) for r in counts] == [(0, 0), (4, 3), (4, 4), (None, None)]
