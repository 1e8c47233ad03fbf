"""Arrow-batched placement of primers in read regions.

The whole batch advances together through the (primer x region) table, so the
Python loop runs over cells and numpy over reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vdjloom.functions import bases

_SCHEMA = "error double, strand int, ord int, begin int, end int"


def _codes(regions: list[str], width: int, lookup: np.ndarray) -> np.ndarray:
    text = "".join(r[:width].ljust(width) for r in regions).encode("ascii", "replace")
    return lookup[np.frombuffer(text, dtype=np.uint8)].reshape(len(regions), width)


def place(codes: np.ndarray, lengths: np.ndarray, primer: np.ndarray, gap):
    """Best (score, begin, end) of one primer in every region.

    ``codes`` is (place, read), so each step works on whole contiguous rows.
    ``gap`` is (open, extend) or None.  The whole primer lies in the region;
    the leftmost end wins a tie, then the leftmost begin.
    """
    width, n = codes.shape
    low = np.float32(-1e6)
    score = np.zeros((width + 1, n), dtype=np.float32)
    begin = np.repeat(np.arange(width + 1, dtype=np.int32)[:, None], n, axis=1)
    if gap is None:
        for base in primer:
            moved = np.full_like(score, low)
            moved[1:] = score[:-1] + ((codes & base) != 0)
            shifted = np.zeros_like(begin)
            shifted[1:] = begin[:-1]
            score, begin = moved, shifted
    else:
        opened, extended = np.float32(gap[0]), np.float32(gap[1])
        skip = np.full((width + 1, n), low, dtype=np.float32)   # primer base unmatched
        skip_begin = begin.copy()
        for base in primer:
            hits = ((codes & base) != 0).astype(np.float32)
            fresh = score - opened >= skip - extended
            row = np.where(fresh, score - opened, skip - extended)
            row_begin = np.where(fresh, begin, skip_begin)
            skip, skip_begin = row.copy(), row_begin.copy()
            diag = score[:-1] + hits
            jump = np.full(n, low, dtype=np.float32)            # read base unmatched
            jump_begin = np.zeros(n, dtype=np.int32)
            for j in range(1, width + 1):
                left = row[j - 1] - opened
                longer = jump - extended > left
                jump = np.maximum(jump - extended, left)
                jump_begin = np.where(longer, jump_begin, row_begin[j - 1])
                better = jump > row[j]
                np.copyto(row[j], jump, where=better)
                np.copyto(row_begin[j], jump_begin, where=better)
                better = diag[j - 1] >= row[j]
                np.copyto(row[j], diag[j - 1], where=better)
                np.copyto(row_begin[j], begin[j - 1], where=better)
            score, begin = row, row_begin
    inside = np.arange(width + 1)[:, None] <= lengths[None, :]
    score = np.where(inside, score, low)
    end = score.argmax(axis=0)
    reads = np.arange(n)
    return score[end, reads], begin[end, reads], end


def best_alignment(primers: list[str], gap, max_len: int):
    """A pandas UDF (forward region, reverse region) -> best hit; NULL in, NULL out."""
    masks = [[bases.base_bits(b, True) for b in p] for p in primers]
    sets = {c: bases.base_bits(c, False) for c in bases.IUPAC}

    @F.pandas_udf(_SCHEMA)
    def align(forward: pd.Series, turned: pd.Series) -> pd.DataFrame:
        lookup = np.zeros(256, dtype=np.uint8)
        for letter, bits in sets.items():
            lookup[ord(letter)] = bits
        total = len(forward)
        out = {
            "error": np.full(total, np.nan), "strand": np.zeros(total, np.int32),
            "ord": np.zeros(total, np.int32), "begin": np.zeros(total, np.int32),
            "end": np.zeros(total, np.int32)}
        for strand, column in enumerate((forward, turned)):
            asked = np.flatnonzero(column.notna().to_numpy())
            if not len(asked):
                continue
            regions = column.iloc[asked].tolist()
            codes = np.ascontiguousarray(_codes(regions, max_len, lookup).T)
            lengths = np.array([min(len(r), max_len) for r in regions])
            for ord_, primer in enumerate(masks):
                score, begin, end = place(codes, lengths, np.array(primer, np.uint8), gap)
                error = 1 - score.astype(np.float64) / len(primer)
                old = out["error"][asked]
                better = (np.isnan(old) & (score > -1e5)) | (error < old)
                rows = asked[better]
                out["error"][rows] = error[better]
                out["strand"][rows] = strand
                out["ord"][rows] = ord_
                out["begin"][rows] = begin[better]
                out["end"][rows] = end[better]
        return pd.DataFrame(out)

    return align
