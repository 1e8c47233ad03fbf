"""Nucleotide strings as column expressions.

Base comparison under IUPAC codes uses one idea throughout: every base becomes
a 4-bit set (A=1, C=2, G=4, T=8, an ambiguity code is the union of its bases),
fifteen bases are packed into one BIGINT, and two packed words agree at a base
when the bitwise AND of their 4 bits is not zero.  Counting agreements is then
an AND, three shifts and ``bit_count`` inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vdjloom.functions.binding import let

# Characters that stand for a missing base.
MISSING = "Nn.-"

# IUPAC nucleotide codes and the bases each one stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

# Complement of each IUPAC code.
COMPLEMENT_FROM = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"

CHUNK = 15  # bases per packed BIGINT (60 of 64 bits)
_LOW_BITS = int("1" * CHUNK, 16)
_BITS = {"A": 1, "C": 2, "G": 4, "T": 8}


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def inner(seq: Column) -> Column:
    """The sequence without its outer missing characters."""
    return F.btrim(seq, F.lit(MISSING))


def inner_start(seq: Column) -> Column:
    """Number of missing characters before the first called base."""
    return F.length(seq) - F.length(F.ltrim(seq, F.lit(MISSING)))


def count_missing(seq: Column, chars: str = MISSING) -> Column:
    known = seq
    for c in chars:  # looks for bytes; translate would ask a map for every character
        known = F.replace(known, F.lit(c), F.lit(""))
    return F.length(seq) - F.length(known)


def gaps_to_n(seq: Column) -> Column:
    return F.translate(seq, ".-", "NN")


def base_bits(code: str, missing_matches: bool) -> int:
    """The 4-bit set of one IUPAC code; N is all bases or none."""
    code = code.upper()
    if code == "N" and not missing_matches:
        return 0
    return sum(_BITS[b] for b in IUPAC.get(code, ""))


def hex_bases(seq: Column, missing_matches: bool) -> Column:
    """One hex digit per base; missing characters become F (match all) or 0."""
    codes = "".join(IUPAC)
    digits = "".join(f"{base_bits(c, missing_matches):X}" for c in codes)
    missing = ("F" if missing_matches else "0") * 2
    return F.translate(F.upper(seq), codes + ".-", digits + missing)


def pack(seq: Column, missing_matches: bool = False) -> Column:
    """``seq`` as ARRAY<BIGINT>, fifteen bases per element."""
    return let(hex_bases(seq, missing_matches), lambda digits: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(digits) - 1) / CHUNK).cast("int")),
        lambda i: pack_chunk(F.substr(digits, i * CHUNK + 1, F.lit(CHUNK))),
    ))


def pack_chunk(digits: Column) -> Column:
    """At most fifteen hex digits, left aligned, as one BIGINT."""
    return F.conv(F.rpad(digits, CHUNK, "0"), 16, 10).cast("bigint")


def pack_literal(bases: str, missing_matches: bool = True) -> list[int]:
    """The packed words of a literal sequence (a primer), padded with zeros."""
    digits = "".join(f"{base_bits(b, missing_matches):X}" for b in bases)
    chunks = [digits[i:i + CHUNK] for i in range(0, len(digits), CHUNK)]
    return [int(c.ljust(CHUNK, "0"), 16) for c in chunks]


def word_matches(a: Column, b: Column) -> Column:
    """Number of agreeing bases of two packed words."""
    m = a.bitwiseAND(b)
    folded = (
        m.bitwiseOR(F.shiftright(m, 1))
        .bitwiseOR(F.shiftright(m, 2))
        .bitwiseOR(F.shiftright(m, 3))
    )
    return F.bit_count(folded.bitwiseAND(F.lit(_LOW_BITS)))


def packed_matches(a: Column, b: Column) -> Column:
    """Agreeing bases of two packed sequences over their common length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), word_matches)
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def iupac_regex(bases: str) -> str:
    """A regular expression of plain bases that the IUPAC string stands for."""
    return "".join(
        IUPAC[b] if len(IUPAC[b]) == 1 else f"[{IUPAC[b]}]" for b in bases.upper()
    )
