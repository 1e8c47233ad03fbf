"""The three read workflows, from raw mates to an annotation table.

Each takes two DataFrames of reads (mate 1, mate 2) and the small inputs, and
returns the final reads; ``header_table`` of the listed fields is its table.
Offsets and lengths are parameters with the published protocols' values.

Reads are written where a later step reads its input more than once: the pairs
of filtered mates, the consensus reads, and the assembled reads before the
collapse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vdjloom.functions.durable import checkpoint
from vdjloom.operators.assembly import assemble_align, assemble_sequential
from vdjloom.operators.collapse import collapse
from vdjloom.operators.filters import filter_quality
from vdjloom.operators.headers import collapse_fields
from vdjloom.operators.pairs import pair_reads, pair_reads_once
from vdjloom.operators.primers import Primers, primers_align, primers_score
from vdjloom.operators.sets import build_consensus
from vdjloom.operators.split import split_threshold

RACE_FIELDS = ["CONSCOUNT", "DUPCOUNT", "PRCONS", "CREGION"]
UMI_FIELDS = ["PRCONS", "CONSCOUNT", "DUPCOUNT"]
PLAIN_FIELDS = ["DUPCOUNT", "CPRIMER", "VPRIMER"]


def _consensus_pair(r1: DataFrame, r2: DataFrame, coord: str, fields_1=(), fields_2=(),
                    primer_freq: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Pair, build one consensus per UMI and mate, and pair the consensus reads."""
    p1, p2 = pair_reads_once(r1, r2, fields_1, fields_2, coord=coord)
    c1 = build_consensus(p1, primer_field="PRIMER", primer_freq=primer_freq, max_error=0.1,
                         max_gap=0.5)
    c2 = build_consensus(p2, max_error=0.1, max_gap=0.5)
    return pair_reads(checkpoint(c1), checkpoint(c2))


def race_umi(r1: DataFrame, r2: DataFrame, primers_1: Primers, primers_2: Primers,
             regions: Primers, refs: DataFrame, coord: str = "sra", start_2: int = 17,
             min_qual: float = 20, min_count: int = 2, max_missing: int = 20,
             region_len: int = 100, score_error: float = 0.2, **assembly) -> DataFrame:
    """5'RACE with UMIs, unequal mates (325 + 275)."""
    r1, r2 = filter_quality(r1, min_qual), filter_quality(r2, min_qual)
    r1 = primers_score(r1, primers_1, start=0, mode="cut", max_error=score_error)
    r2 = primers_score(r2, primers_2, start=start_2, mode="cut", barcode=True, max_error=0.5)
    c1, c2 = _consensus_pair(r1, r2, coord, fields_2=("BARCODE",))
    reads = assemble_sequential(
        c2, c1, refs, scan_reverse=True, head_fields=("CONSCOUNT",),
        tail_fields=("CONSCOUNT", "PRCONS"), check=False, **assembly)
    reads = primers_align(reads, regions, max_len=region_len, max_error=0.3, mode="tag",
                          rev_primer=True, skip_rc=True, primer_field="CREGION")
    reads = collapse_fields(reads, {"CONSCOUNT": "min"})
    reads = collapse(checkpoint(reads), max_missing=max_missing, inner=True, uniq=("CREGION",),
                     copy={"CONSCOUNT": "sum"})
    return split_threshold(reads, "CONSCOUNT", min_count)["atleast"]


def paired_umi(r1: DataFrame, r2: DataFrame, c_primers: Primers, v_primers: Primers,
               coord: str = "sra", start_1: int = 15, min_qual: float = 20,
               min_count: int = 2, max_missing: int = 20, score_error: float = 0.2,
               **assembly) -> DataFrame:
    """2 x 250 with UMIs."""
    r1, r2 = filter_quality(r1, min_qual), filter_quality(r2, min_qual)
    r1 = primers_score(r1, c_primers, start=start_1, mode="cut", barcode=True,
                       max_error=score_error)
    r2 = primers_score(r2, v_primers, start=0, mode="mask", max_error=score_error)
    c1, c2 = _consensus_pair(r1, r2, coord, fields_1=("BARCODE",))
    reads = assemble_align(c2, c1, head_fields=("CONSCOUNT",),
                           tail_fields=("CONSCOUNT", "PRCONS"), check=False, **assembly)
    reads = reads.drop("overlap", "overlap_error", "pvalue")
    reads = collapse_fields(reads, {"CONSCOUNT": "min"})
    reads = collapse(checkpoint(reads), max_missing=max_missing, inner=True, uniq=("PRCONS",),
                     copy={"CONSCOUNT": "sum"})
    return split_threshold(reads, "CONSCOUNT", min_count)["atleast"]


def paired_plain(r1: DataFrame, r2: DataFrame, v_primers: Primers, c_primers: Primers,
                 min_qual: float = 20, start: int = 4, min_count: int = 2,
                 max_missing: int = 20, score_error: float = 0.2, check: bool = True,
                 **assembly) -> DataFrame:
    """2 x 250 without UMIs; mates without a partner stop the run, pair the reads before."""
    reads = assemble_align(r2, r1, check=check, **assembly).drop(
        "overlap", "overlap_error", "pvalue")
    reads = filter_quality(reads, min_qual)
    reads = primers_score(reads, v_primers, start=start, mode="mask", max_error=score_error,
                          primer_field="VPRIMER")
    reads = primers_score(reads, c_primers, start=start, mode="cut", rev_primer=True,
                          max_error=score_error, primer_field="CPRIMER")
    reads = collapse(checkpoint(reads), max_missing=max_missing, inner=True, uniq=("CPRIMER",),
                     copy={"VPRIMER": "set"})
    return split_threshold(reads, "DUPCOUNT", min_count)["atleast"]
