"""Clusters and distance histograms against brute force."""

import random
from collections import Counter
from itertools import combinations
from math import floor

import pytest
from pyspark.sql import functions as F

from vdjloom.operators import clusters, errors, tiles


def _greedy(counts, ident):
    """seq -> founder of a one-by-one greedy pass."""
    founders, out = [], {}
    for seq in sorted(counts, key=lambda s: (-counts[s], s)):
        for f in founders:
            n = min(len(f), len(seq))
            same = sum(a == b and a in "ACGT" for a, b in zip(f, seq))
            if same >= n - floor(n * (1 - ident) + 1e-9):
                out[seq] = f
                break
        else:
            founders.append(seq)
            out[seq] = seq
    return out


def _mutants(seed, length, families, count, rate, ragged=0):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(families)]
    out = []
    for _ in range(count):
        s = [c if rng.random() > rate else rng.choice("ACGTN") for c in rng.choice(base)]
        out.append("".join(s)[:length - rng.randint(0, ragged)])
    return out


@pytest.mark.parametrize("seed,length,ident,rate,ragged", [
    (1, 8, 0.8, 0.08, 0), (2, 12, 0.9, 0.06, 0), (3, 30, 0.9, 0.05, 0), (4, 25, 0.85, 0.08, 4)])
def test_greedy_by_abundance(spark, seed, length, ident, rate, ragged):
    seqs = _mutants(seed, length, 5, 300, rate, ragged)
    df = spark.createDataFrame([(f"r{i}", s, i) for i, s in enumerate(seqs)],
                               "read_id string, seq string, seq_no bigint")
    got = {r.seq: r.c for r in clusters.cluster_all(df, ident).select(
        "seq", F.element_at("CLUSTER", 1).alias("c")).collect()}
    expected = _greedy(Counter(seqs), ident)
    groups = {}
    for s, c in got.items():
        groups.setdefault(c, set()).add(s)
    wanted = {}
    for s, f in expected.items():
        wanted.setdefault(f, set()).add(s)
    assert {frozenset(v) for v in groups.values()} == {frozenset(v) for v in wanted.values()}


def test_one_crowded_key(spark):
    """All sequences share their first segment, and most differ elsewhere."""
    rng = random.Random(5)
    seqs = ["ACGTACGT" + "".join(rng.choice("ACGT") for _ in range(16)) for _ in range(250)]
    df = spark.createDataFrame([(f"r{i}", s, i) for i, s in enumerate(seqs)],
                               "read_id string, seq string, seq_no bigint")
    labels = clusters.cluster_all(df, 0.9).select(F.element_at("CLUSTER", 1)).distinct().count()
    assert labels == len(set(_greedy(Counter(seqs), 0.9).values()))


def test_sets_number_their_own_clusters_and_fail_whole(spark):
    rows = [("a", "AAAAAAAAAA", 1, ["X"]), ("b", "AAAAAAAAAC", 2, ["X"]),
            ("c", "GGGGGGGGGG", 3, ["X"]), ("d", "TTTTTTTTTT", 4, ["Y"]),
            ("e", "TTTTTTTTTT", 5, ["Z"]), ("f", "", 6, ["Z"])]
    df = spark.createDataFrame(
        rows, "read_id string, seq string, seq_no bigint, BARCODE array<string>")
    out = {r.read_id: r.CLUSTER[0] for r in clusters.cluster_sets(df).collect()}
    assert out["a"] == out["b"] and out["a"] != out["c"] and out["d"] == "1"
    assert set(out) == {"a", "b", "c", "d"}
    assert {r.read_id for r in clusters.cluster_sets(df, keep="fail").collect()} == {"e", "f"}


def _brute(reads):
    counts = Counter()
    for a, b in combinations(reads, 2):
        counts[sum(x != y for x, y in zip(a, b))] += 1
    return counts


def test_tiles_equal_all_pairs(spark):
    reads = _mutants(7, 10, 4, 150, 0.1)
    distinct = spark.createDataFrame(
        [("s", s, n) for s, n in Counter(reads).items()], "set string, seq string, n bigint")
    for block in (5, 64, 1000):     # one set over many tiles, or in one
        got = {r.d: r.pairs for r in tiles.distances(distinct, block).collect()}
        assert got == dict(_brute(reads))


@pytest.mark.parametrize("method", ["tiles", "subsets"])
def test_barcode_histogram_methods_agree(spark, method):
    codes = _mutants(8, 7, 3, 120, 0.2)
    df = spark.createDataFrame([([c],) for c in codes], "BARCODE array<string>")
    got = {r.bin: r.pairs for r in errors.barcode_distance_hist(df, method=method).collect()}
    brute = _brute(codes)
    assert got == {b: brute.get(b, 0) for b in range(8)}


def test_short_barcodes_are_left_out_or_padded(spark):
    df = spark.createDataFrame([(["ACGT"],), (["ACG"],), (["ACGT"],)], "BARCODE array<string>")
    total = {p: sum(r.pairs for r in errors.barcode_distance_hist(df, pad=p).collect())
             for p in ("none", "head", "tail")}
    assert total == {"none": 1, "head": 3, "tail": 3}


def test_threshold_keeps_the_mode_offset(spark):
    hist = spark.createDataFrame(
        list(enumerate([0, 9, 3, 1, 1, 4, 5, 6])), "bin int, pairs bigint")
    value = errors.distance_threshold(hist, after_mode=True).first()[0]
    assert value == pytest.approx((1 + 2) / 8)
    old = errors.distance_threshold(hist, after_mode=True, legacy=True).first()[0]
    assert old == pytest.approx(2 / 8)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y or x == "N"))
    return row[-1]


def _greedy_edits(counts, ident):
    founders, out = [], {}
    for seq in sorted(counts, key=lambda s: (-counts[s], s)):
        near = [f for f in founders if _edits(f, seq) <= floor(min(len(f), len(seq)) * (1 - ident) + 1e-9)]
        out[seq] = near[0] if near else seq
        founders += [] if near else [seq]
    return out


@pytest.mark.parametrize("seed,length,ident,ragged", [(11, 8, 0.8, 0), (12, 12, 0.9, 1), (13, 24, 0.85, 3), (14, 40, 0.9, 2), (15, 5, 0.5, 3)])
def test_barcodes_by_edit_distance(spark, seed, length, ident, ragged):
    rng = random.Random(seed)
    codes = _mutants(seed, length, 5, 250, 0.05, ragged)
    for i in range(0, len(codes), 3):  # lost and gained bases
        at = rng.randrange(len(codes[i]))
        codes[i] = codes[i][:at] + (rng.choice("ACGT") if i % 2 else "") + codes[i][at + (i % 2 == 0):]
    codes = [c for c in codes if c]
    df = spark.createDataFrame([(f"r{i}", [c]) for i, c in enumerate(codes)], "read_id string, BARCODE array<string>")
    got = {}
    for r in clusters.cluster_barcodes(df, ident=ident).collect():
        got.setdefault(r.CLUSTER[0], set()).add(r.BARCODE[0])
    wanted = {}
    for code, founder in _greedy_edits(Counter(codes), ident).items():
        wanted.setdefault(founder, set()).add(code)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in wanted.values()}
