"""Crowded sets, gated sets and reads without a set give what ordinary sets give."""

import pytest
from pyspark.sql import functions as F

from vdjloom.operators import errors, sets
from vdjloom.sources import derived


def _rows(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def reads(spark, sf_dir, tmp_path_factory):
    """Half of the reads are in one set, some are in none."""
    folder = str(tmp_path_factory.mktemp("sets") / "reads")
    code = F.when(F.col("seq_no") % 2 == 0, F.array(F.lit("HOT"))).when(
        F.col("seq_no") % 11 != 0, F.col("BARCODE"))
    derived.mate(spark, sf_dir, 1).withColumn("BARCODE", code).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.mark.parametrize("options", [
    {}, {"min_count": 2, "max_error": 0.9, "max_diversity": 0.9},
    {"min_count": 2, "primer_field": "PRIMER", "primer_freq": 0.4, "keep": "both"},
    {"copy": [("SAMPLE", "set")], "use_quality": False},
])
def test_consensus_of_crowded_sets(reads, monkeypatch, options):
    plain = _rows(sets.build_consensus(reads, **options))
    monkeypatch.setattr(sets, "CROWDED", 100)
    assert _rows(sets.build_consensus(reads, **options)) == plain
    monkeypatch.setattr(sets, "CROWDED", 1)
    monkeypatch.setattr(sets, "CROWDED_SHARE", 10**9)
    assert _rows(sets.build_consensus(reads, **options)) == plain


def test_gate_keeps_the_sets_that_pass(reads):
    every = sets.build_consensus(reads, min_count=3, keep="both")
    assert _rows(sets.build_consensus(reads, min_count=3)) == _rows(
        every.filter("reason IS NULL").drop("reason"))


@pytest.mark.parametrize("options", [{}, {"mode": "qual"}, {"max_diversity": 0.9}])
def test_errors_of_crowded_sets(reads, monkeypatch, options):
    plain = _rows(errors.error_counts(reads, min_count=2, **options))
    assert plain
    monkeypatch.setattr(sets, "CROWDED", 100)
    assert _rows(errors.error_counts(reads, min_count=2, **options)) == plain


def test_error_counts_of_no_reads(reads):
    assert errors.error_counts(reads.limit(0), min_count=2).collect() == []
    assert sets.build_consensus(reads.limit(0)).collect() == []
