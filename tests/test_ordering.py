"""Row numbers and running values over slots of the order column."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from vdjloom.functions import ordering
from vdjloom.operators import split


def _orders(seed):
    """Dense, sparse, negative and extreme numbers, all different."""
    pick = random.Random(seed)
    dense = range(65_000, 67_000)
    sparse = [pick.randrange(-2 ** 62, 2 ** 62) for _ in range(2_000)]
    return sorted({*dense, *sparse, 0, -1, -2 ** 63, 2 ** 63 - 2, 1 << 16, 1 << 32, 1 << 48})


def test_running_values_equal_a_plain_loop(spark):
    pick = random.Random(1)
    rows = [(o, pick.randrange(100)) for o in _orders(5)]
    shuffled = pick.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "o bigint, n int")
    sums = {r.o: (r.s, r.i) for r in ordering.number_rows(
        ordering.running(df, "o", F.col("n"), "s"), "o", "i").collect()}
    tops = {r.o: r.h for r in ordering.highest(df, "o", F.col("n"), "h").collect()}
    total, top = 0, -1
    for at, (o, n) in enumerate(rows):
        assert sums[o] == (total, at)
        total, top = total + n, max(top, n)
        assert tops[o] == top
    assert len(sums) == len(tops) == len(rows)


def test_rows_without_a_number_come_last(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (None, 3), (1, 4)], "o bigint, n int")
    got = {r.n: r.i for r in ordering.number_rows(df, "o", "i").collect()}
    assert got[4] == 0 and got[2] == 1 and {got[1], got[3]} == {2, 3}


def test_places_that_tie_see_each_other(spark):
    df = spark.createDataFrame([(5, 1), (5, 7), (4, 2)], "o bigint, n int")
    assert {(r.n, r.h) for r in ordering.highest(df, "o", F.col("n"), "h").collect()} == {(1, 7), (7, 7), (2, 2)}


def test_an_order_that_changes_between_passes_stops(spark):
    import pytest
    anew = F.udf(lambda: random.SystemRandom().getrandbits(62), "bigint").asNondeterministic()
    df = spark.range(4).select(anew().alias("o"))
    with pytest.raises(Exception, match="two passes"):
        ordering.highest(df, "o", F.lit(1), "h").collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "o bigint, n int")
    assert ordering.number_rows(df, "o", "i").count() == 0


def test_slots_are_chosen_without_a_job_and_bounded(spark):
    """Numbering starts no job, holds no list of bounds and never windows the rows as a whole."""
    df = spark.range(200_000).withColumnRenamed("id", "o")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    numbered = ordering.number_rows(df, "o", "i")
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == set(before)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") <= 1
    sizes = df.groupBy(F.shiftright("o", ordering.BITS).alias("s")).count().agg(F.max("count")).first()[0]
    assert sizes <= 2 ** ordering.BITS


def test_parts_beside_a_value_of_very_many_reads(spark):
    """Values far above the limit are intervals: parts equal a greedy loop."""
    pick = random.Random(3)
    counts = [(f"v{i:03d}", pick.choice([1, 2, 3, 40, 3_000])) for i in range(60)]
    reads = [(f"r{k}.{i}", k * 10_000 + i, [v]) for k, (v, n) in enumerate(counts) for i in range(n)]
    df = spark.createDataFrame(reads, "read_id string, seq_no bigint, V array<string>")
    got = {(r.V[0], r.part) for r in split.sort_reads(df, "V", max_count=7).select("V", "part").distinct().collect()}
    part, used, want = 1, 0, set()
    for v, n in counts:
        if used and used + n > 7:
            part, used = part + 1, 0
        used += n
        want.add((v, part))
    assert got == want
