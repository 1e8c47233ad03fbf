"""Reads arriving as a stream.

Filters, primers, header edits and header conversion keep no state, so they
take a streaming DataFrame as it is.  ``run_available`` drives such a chain
from a folder of Parquet reads to a Parquet sink, exactly once per file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_reads(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Canonical reads from Parquet files as they appear in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def run_available(reads: DataFrame, steps: list[Callable[[DataFrame], DataFrame]],
                  target: str, checkpoint: str) -> None:
    """Apply the steps and write everything that has arrived, then stop."""
    for step in steps:
        reads = reads.transform(step)
    query = (
        reads.writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
