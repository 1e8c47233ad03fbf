"""Pairwise Hamming distances as counts, without making the pairs.

A set's distinct sequences are hashed into blocks of bounded size and every
pair of blocks is a tile.  Spark shuffles rows to tiles; a task turns each tile
into a small histogram with one matrix product and never emits a pair.  A set
that holds most of the data becomes many tiles, so it is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
_OUT = "length int, d int, pairs bigint"


def _letters(seqs: list[str]) -> np.ndarray:
    return np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8).reshape(
        len(seqs), -1)


def _tile_counts(left, right, left_n, right_n, same: bool) -> tuple[int, np.ndarray]:
    a = _letters(left)
    length = a.shape[1]
    b = a if same else _letters(right)
    symbols = np.union1d(a, b)
    agree = np.zeros((len(a), len(b)), np.float32)
    for s in symbols:
        agree += (a == s).astype(np.float32) @ (b == s).astype(np.float32).T
    d = length - agree.astype(np.int64)
    weight = np.outer(left_n, right_n if not same else left_n)
    if same:
        upper = np.triu_indices(len(a), 1)
        d, weight = d[upper], weight[upper]
    counts = np.zeros(length + 1, np.int64)
    np.add.at(counts, d.ravel(), weight.ravel())
    return length, counts


def _histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by tile; a tile may run on into the next batch."""
    totals: dict[int, np.ndarray] = {}

    def close(tile: pd.DataFrame) -> None:
        same = tile["lo"].iloc[0] == tile["hi"].iloc[0]
        if same:
            if len(tile) < 2:
                return
            left = right = tile
        else:
            left, right = tile[tile["at_lo"]], tile[~tile["at_lo"]]
            if not len(left) or not len(right):
                return
        length, counts = _tile_counts(
            left["seq"].tolist(), right["seq"].tolist(),
            left["n"].to_numpy(np.int64), right["n"].to_numpy(np.int64), same)
        totals[length] = totals[length] + counts if length in totals else counts

    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        change = (rows[["set", "lo", "hi"]] != rows[["set", "lo", "hi"]].shift()).any(axis=1)
        starts = np.flatnonzero(change.to_numpy())
        for begin, end in zip(starts[:-1], starts[1:]):
            close(rows.iloc[begin:end])
        rest = rows.iloc[starts[-1]:].reset_index(drop=True)
    if rest is not None:
        close(rest)
    out = [(length, d, int(c)) for length, counts in totals.items()
           for d, c in enumerate(counts) if c]
    yield pd.DataFrame(out, columns=["length", "d", "pairs"])


def distances(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(length, d, pairs) over all pairs of reads within each set.

    ``distinct`` has (set, seq, n): equal-length distinct sequences of a set
    and how many reads hold each.
    """
    sizes = distinct.groupBy("set").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = distinct.join(sizes, "set").withColumn(
        "own", F.pmod(F.xxhash64("seq"), F.col("blocks")).cast("int"))
    tiled = placed.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "set", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") <= F.col("other")).alias("at_lo"), "seq", "n")
    parts = (
        tiled.repartition("set", "lo", "hi").sortWithinPartitions("set", "lo", "hi")
        .mapInPandas(_histograms, _OUT)
    )
    copies = distinct.select(
        F.length("seq").alias("length"), F.lit(0).alias("d"),
        F.floor(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    return parts.union(copies).groupBy("length", "d").agg(F.sum("pairs").alias("pairs")).filter(
        "pairs > 0")
