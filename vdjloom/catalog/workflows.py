from __future__ import annotations

from vdjloom.catalog.common import r1, r2
from vdjloom.operators.headers import header_table
from vdjloom.operators.pairs import pair_reads
from vdjloom.plans import workflows as plan
from vdjloom.sources import derived

# The derived fragments carry no primers, so short ambiguous ones stand in.
LEFT = {"L1": "RNYN", "L2": "YNRN", "L3": "NRNR", "L4": "NYNY"}
RIGHT = {"R1": "NNRR", "R2": "NNYY", "R3": "NRYN", "R4": "NYRN"}
REGIONS = {"C1": "RYRYNN", "C2": "YRYRNN", "C3": "RRYYNN", "C4": "YYRRNN"}


def _race(s, d):
    # The UMI is the first twelve bases of mate 2 here, where reads of one
    # fragment agree most.
    out = plan.race_umi(
        r1(s, d).drop("BARCODE", "PRIMER"), r2(s, d).drop("BARCODE", "PRIMER"),
        LEFT, RIGHT, REGIONS, derived.fragments(s, d), coord="presto", start_2=12,
        region_len=40, alpha=1e-3, step=1)
    return header_table(out, plan.RACE_FIELDS[:2] + ["PRCONS", "CREGION"])


def _umi(s, d):
    out = plan.paired_umi(
        r1(s, d).drop("BARCODE", "PRIMER"), r2(s, d).drop("BARCODE", "PRIMER"), LEFT, RIGHT,
        coord="presto", start_1=12, alpha=1e-3)
    return header_table(out, plan.UMI_FIELDS)


def _plain(s, d):
    a, b = pair_reads(r1(s, d), r2(s, d))
    out = plan.paired_plain(a, b, RIGHT, LEFT, alpha=1e-3, max_missing=20)
    return header_table(out, plan.PLAIN_FIELDS)


QUERIES = {
    "wf1_race_umi": (_race, None),
    "wf2_paired_umi": (_umi, None),
    "wf3_paired_plain": (_plain, None),
}
