"""Wildcard collapse against a one-by-one scan."""

import random

import pytest
from pyspark.sql import functions as F

from vdjloom.operators import collapse as module
from vdjloom.operators.collapse import collapse, count_outputs


def _compatible(a, b):
    return all(x == y or x in "N-." or y in "N-." for x, y in zip(a, b))


def scan(rows, max_missing, inner):
    """Groups of (seq_no, seq, field, metric) rows as a sequential scan finds them."""
    groups, left = [], list(rows)
    for level in range(max_missing + 1):
        rest = []
        for no, seq, field, metric in left:
            s = seq.strip("N-.") if inner else seq
            miss = sum(c in "N-." for c in s)
            if miss > level:
                rest.append((no, seq, field, metric))
                continue
            for g in groups:
                same = g["s"] == s if level == 0 else _compatible(g["s"], s)
                if len(g["s"]) == len(s) and g["field"] == field and same:
                    g["n"] += 1
                    g["members"].append(no)
                    if miss <= g["miss"] and metric > g["metric"]:
                        g.update(rep=no, metric=metric, miss=miss)
                    break
            else:
                groups.append(dict(s=s, field=field, n=1, rep=no, metric=metric, miss=miss,
                                   members=[no]))
        left = rest
    return {(g["rep"], g["n"]) for g in groups}, len(left)


def _reads(seed, length, missing, count=160):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(6)]
    rows = []
    for no in range(count):
        s = list(rng.choice(bases))
        if rng.random() < 0.4:
            s[rng.randrange(length)] = rng.choice("ACGT")
        for _ in range(rng.choice([0, 0, 1, 2, missing, missing + 1])):
            s[rng.randrange(length)] = rng.choice("NN-")
        rows.append((no, "".join(s), rng.choice("XY"), float(rng.randrange(4))))
    return rows


@pytest.mark.parametrize("seed,length,missing,inner", [
    (1, 24, 1, False), (2, 24, 5, True), (3, 8, 8, False), (4, 5, 3, True), (5, 12, 7, False), (6, 30, 20, False)])
def test_matches_sequential_scan(spark, seed, length, missing, inner):
    rows = _reads(seed, length, missing)
    df = spark.createDataFrame(
        [(f"r{no}", s, no, [f], [str(m)]) for no, s, f, m in rows],
        "read_id string, seq string, seq_no bigint, F array<string>, M array<string>")
    out = collapse(df, max_missing=missing, uniq=("F",), max_field="M", inner=inner)
    got = {(r.seq_no, int(r.n)) for r in out.select(
        "seq_no", F.element_at("DUPCOUNT", 1).alias("n")).collect()}
    expected, undetermined = scan(rows, missing, inner)
    assert got == expected
    assert collapse(df, max_missing=missing, inner=inner, uniq=("F",),
                    output="undetermined").count() == undetermined


def test_counts_are_conserved(spark):
    rows = _reads(9, 20, 2)
    df = spark.createDataFrame(
        [(f"r{no}", s, no, [f]) for no, s, f, _ in rows],
        "read_id string, seq string, seq_no bigint, F array<string>")
    counts = {r.kind: r.reads for r in count_outputs(df, max_missing=2).collect()}
    assert sum(counts.values()) == len(rows)


def test_min_field_keeps_the_minimum(spark):
    df = spark.createDataFrame(
        [("a", "ACGT", 1, ["5"]), ("b", "ACGT", 2, ["2"]), ("c", "ACGT", 3, ["9"])],
        "read_id string, seq string, seq_no bigint, M array<string>")
    assert collapse(df, min_field="M").first().read_id == "b"
    assert collapse(df, max_field="M").first().read_id == "c"


def test_all_copy_actions(spark):
    df = spark.createDataFrame(
        [("a", "ACGT", 1, ["5"]), ("b", "ACGT", 2, ["2", "5"]), ("c", "ACGT", 3, ["9"])],
        "read_id string, seq string, seq_no bigint, M array<string>")
    expected = {"min": ["2"], "max": ["9"], "sum": ["21"], "set": ["5", "2", "9"],
                "first": ["5"], "last": ["9"], "cat": ["5259"]}
    for action, value in expected.items():
        assert collapse(df, copy={"M": action}).first().M == value, action


def test_complete_reads_are_multiplied_by_a_constant(spark, monkeypatch):
    """However many patterns of missing characters there are, a complete sequence has a fixed number of anchors."""
    rng = random.Random(5)
    clean = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(50)]
    vague = []
    for s in clean * 12:
        places = rng.sample(range(40), rng.randrange(1, 9))
        vague.append("".join("N" if i in places else c for i, c in enumerate(s)))
    df = spark.createDataFrame([(f"r{i}", s, i) for i, s in enumerate(clean + vague)], "read_id string, seq string, seq_no bigint")
    made = []
    keep = module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda d: made.append(keep(d)) or made[-1])
    assert collapse(df, max_missing=8).count() == 50
    posted = next(d for d in made if "_cw" in d.columns)
    assert 0 < posted.count() <= 50 * sum(module.anchor_levels(8)) and sum(module.anchor_levels(8)) == 17
    assert module.anchor_levels(5) == [2, 6]
