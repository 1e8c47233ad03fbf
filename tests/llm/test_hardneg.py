"""Hard negatives against a plain search, and the threshold join against the full product."""

import math

import numpy as np
import pytest

from vdjloom.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, score int"


def brute(rows, k=5, positives=5):
    v = []
    for vec_id, x, label, *_ in rows:
        if vec_id is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            if vec_id % 7 == 0:
                label = (label + 1) % 10
            v.append((vec_id, [math.floor(256 * float(np.float32(c))) for c in x], label))
    out = []
    for i, (anchor, q, label) in enumerate(v):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), vec_id, other == label)
                        for j, (vec_id, x, other) in enumerate(v) if j != i and len(x) == len(q))
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            hits = [s for s in scored if not s[2] and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(anchor, positive, r + 1, negative, -p, -n) for r, (n, negative, _) in enumerate(hits)]
    return sorted(out)


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (4, dim))
    return [(int(i), (centres[i % 4] * spread + rng.normal(0, 0.5, dim)).astype(np.float32).tolist(), int(rng.integers(0, 3)), "x", 1)
            for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1, "x", 1), (100, None, 1, "x", 1), (200, [1.0, None], 1, "x", 1), (300, [float("nan"), 1.0], 1, "x", 1),
    (400, [float("inf"), 1.0], 1, "x", 1), (500, [1.0, 1.0], None, "x", 1), (600, [], 1, "x", 1), (601, [], 2, "x", 1), (602, [], 1, "x", 1),
    (700, [1.0, 1.0], 0, "x", 1), (701, [1.0, 1.0], 1, "x", 1), (701, [1.0, 1.0], 1, "x", 1), (702, [1.0, 0.9], 2, "x", 1),
    (702, [0.9, 1.0], 2, "x", 1), (702, [0.5, 1.0], 2, "x", 1), (800, [-1.0, 1.0], 3, "x", 1), (801, [1.0, -1.0], 3, "x", 1),
    (802, [-1.0, 0.9], 4, "x", 1), (803, [1.0, -0.8], 4, "x", 1), (900, [0.0, 0.0], 5, "x", 1), (901, [0.0, 0.0], 5, "x", 1),
    (902, [0.0, 0.0], 6, "x", 1), (1000, [3.0, 3.0], 1, "x", 1), (1000, [3.0, 3.0], 1, "x", 1), (1001, [1e30, -1e30], 1, "x", 1),
    (-100, [0.3, 0.3], 8, "x", 1), (-7, [0.3, 0.3], 8, "x", 1), (-8, [0.3, 0.31], 8, "x", 1),
]


@pytest.mark.parametrize("case", ["odd", "clustered", "copies", "plain"])
def test_equals_plain_search(spark, monkeypatch, case):
    rows = {
        "odd": [r for r in ODD if r[0] != 1001],
        "clustered": vectors(1, 900, 20, 2.0),
        "copies": [(i, [0.5, 0.25, -0.125], i % 2, "x", 1) for i in range(400)] + vectors(2, 300, 3),
        "plain": vectors(3, 700, 33, 0.0),
    }[case]
    monkeypatch.setattr(hardneg, "BLOCK", 64)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    monkeypatch.setattr(hardneg, "SAMPLE", 200)
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_large_components_and_empty_table(spark):
    assert hardneg.hard_negatives(spark.createDataFrame(ODD, SCHEMA)).count() > 0
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_threshold_join_equals_product(seed):
    rng = np.random.default_rng(seed)
    dim = int(rng.choice([1, 7, 8, 40]))
    scale = rng.uniform(0.1, 3, (300, 1)) * (rng.uniform(0, 1, dim) ** 3)  # norms and dimensions of unequal weight
    block = np.floor(100 * scale * rng.normal(0, 1, (300, dim))).astype(np.int64)
    anchors = np.floor(100 * rng.normal(0, 1, (150, dim))).astype(np.int64)
    product = anchors @ block.T
    least = np.sort(product, axis=1)[:, -rng.integers(1, 60)] if seed % 2 else np.quantile(product, rng.uniform(0.01, 0.999, 150)).astype(np.int64)
    got = {(int(a), int(r)): int(s) for w, row, score in hardneg.over_threshold(anchors, block, least) for a, r, s in zip(w, row, score, strict=True)}
    assert got == {(a, r): int(product[a, r]) for a in range(150) for r in range(300) if product[a, r] >= least[a]}


def test_rows_of_small_norm_are_not_listed():
    """Most rows can't reach the threshold by norm alone; the result is whole nevertheless."""
    rng = np.random.default_rng(9)
    block = (rng.normal(0, 1, (4000, 64)) * np.where(np.arange(4000)[:, None] < 40, 300, 10)).astype(np.int64)
    anchors = rng.normal(0, 100, (20, 64)).astype(np.int64)
    product = anchors @ block.T
    least = np.full(20, int(np.quantile(product[:, :40], 0.6)))
    assert least[0] > 50_000
    found = [(w, r) for who, row, _ in hardneg.over_threshold(anchors, block, least) for w, r in zip(who, row, strict=True)]
    assert len(found) == int((product >= least[:, None]).sum()) and max(r for _, r in found) < 40
