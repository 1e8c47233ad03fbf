"""The flagship query: from raw reads to unique, well supported consensus reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vdjloom.functions.durable import checkpoint
from vdjloom.operators.collapse import collapse
from vdjloom.operators.filters import filter_quality
from vdjloom.operators.headers import header_table
from vdjloom.operators.sets import build_consensus
from vdjloom.operators.split import split_threshold
from vdjloom.sources import derived


def unique_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality filter, frequency consensus per UMI, collapse, CONSCOUNT >= 2.

    Consensus reads with an undecided base are kept as they are.  The consensus
    reads are checkpointed, as the collapse reads them more than once.
    """
    reads = filter_quality(derived.mate(spark, sf_dir, 1), 24)
    cons = build_consensus(reads, min_freq=0.6, use_quality=False)
    unique = collapse(checkpoint(cons), copy={"CONSCOUNT": "sum"}, keep_missing=True)
    strong = split_threshold(unique, "CONSCOUNT", 2)["atleast"]
    return header_table(strong, ["CONSCOUNT", "DUPCOUNT"])
