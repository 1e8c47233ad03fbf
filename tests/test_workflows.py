"""Whole workflows on planted molecules: the known sequences must come back."""

import random

from vdjloom.plans import workflows

SCHEMA = "read_id string, seq string, seq_no bigint, qual array<tinyint>"
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _rc(s):
    return s.translate(_COMPLEMENT)[::-1]


def _random(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def _frames(spark, pairs):
    def frame(i):
        return spark.createDataFrame(
            [(f"m{n}", p[i], n, [35] * len(p[i])) for n, p in enumerate(pairs)], SCHEMA)
    return frame(0), frame(1)


def _result(df, *fields):
    return sorted((r.seq, *[",".join(r[f]) for f in fields]) for r in df.collect())


C = {"IgM": "GGTTAACCAG", "IgG": "CATTGGCCTA"}
V = {"V1": "TTCAGGACCA", "V2": "GACCTTGGAT"}


def test_paired_umi(spark):
    rng = random.Random(1)
    wanted, pairs = [], []
    for i in range(3):
        body, c, v = _random(rng, 80), list(C)[i % 2], list(V)[i % 2]
        fragment = V[v] + body
        for _ in range(2):                       # two molecules, three reads each
            umi = _random(rng, 15)
            for _ in range(3):
                pairs.append((umi + C[c] + _rc(fragment)[:60], fragment[:60]))
        wanted.append(("N" * 10 + body, c, "6", "2"))
    r1, r2 = _frames(spark, pairs)
    out = workflows.paired_umi(r1, r2, C, V, coord="presto")
    assert _result(out, "PRCONS", "CONSCOUNT", "DUPCOUNT") == sorted(wanted)


def test_paired_plain(spark):
    rng = random.Random(2)
    wanted, pairs = [], []
    for i in range(3):
        body, c, v = _random(rng, 70), list(C)[i % 2], list(V)[i % 2]
        for _ in range(i + 1):                   # the first is seen once and drops out
            fragment = _random(rng, 4) + V[v] + body + _rc(C[c]) + _random(rng, 4)
            pairs.append((_rc(fragment)[:65], fragment[:65]))
        if i:
            wanted.append(("N" * 10 + body, c, v, str(i + 1)))
    r1, r2 = _frames(spark, pairs)
    out = workflows.paired_plain(r1, r2, V, C)
    assert _result(out, "CPRIMER", "VPRIMER", "DUPCOUNT") == sorted(wanted)


def test_race_umi(spark):
    """One molecule's mates overlap; the other's are joined over the reference."""
    rng = random.Random(3)
    regions = {"CH": "GGATCCTTAAGC", "CK": "TTGCATGGACCA"}
    wanted, pairs, refs = [], [], []
    for i, length in enumerate((90, 130)):
        region = list(regions)[i]
        body = _random(rng, length) + _rc(regions[region])
        refs.append((f"ref{i}", body))
        umi = _random(rng, 17)
        for _ in range(3):
            pairs.append((C["IgM"] + _rc(body)[:60], umi + V["V1"] + body[:60]))
        gap = len(body) - 120
        seq = body if gap <= 0 else body[:60] + "N" * gap + body[-60:]
        wanted.append((seq, "IgM", region, "3", "1"))
    r1, r2 = _frames(spark, pairs)
    out = workflows.race_umi(
        r1, r2, C, V, regions, spark.createDataFrame(refs, "name string, seq string"),
        coord="presto", max_missing=30)
    assert _result(out, "PRCONS", "CREGION", "CONSCOUNT", "DUPCOUNT") == sorted(wanted)
