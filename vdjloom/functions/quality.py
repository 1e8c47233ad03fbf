"""Phred qualities held as ARRAY<TINYINT>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PHRED = 93


def decode(text: Column) -> Column:
    """Phred+33 text to scores."""
    return F.transform(F.split(text, ""), lambda c: (F.ascii(c) - 33).cast("tinyint"))


def encode(qual: Column) -> Column:
    """Scores to Phred+33 text."""
    return F.array_join(F.transform(qual, lambda q: F.char(q + 33)), "")


def total(qual: Column) -> Column:
    return F.aggregate(qual, F.lit(0), lambda acc, q: acc + q)


def mean(qual: Column) -> Column:
    return total(qual) / F.size(qual)


def empirical(error: Column) -> Column:
    """Phred score of an error rate, bounded at Q90."""
    return -10 * F.log10(F.when(error == 0, F.lit(1e-9)).otherwise(error))
