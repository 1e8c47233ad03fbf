from __future__ import annotations

from pyspark.sql import functions as F

from vdjloom.catalog.common import r1, with_reads
from vdjloom.functions import bases, quality
from vdjloom.functions import fields as fx
from vdjloom.operators import primers as op
from vdjloom.operators.primerjoin import primers_score_many
from vdjloom.sources import derived

SHORT = {"P1": "ACRTNGCA", "P2": "GGYANTCAGT", "P3": "TTSKACG", "P4": "CAWGNNTACB"}
LONG = {f"V{i}": ("ACGTRYSWKMBDHVN" * 3)[i:i + 18 + i % 3] for i in range(12)}

# One row per (primer, place): the letters the primer allows there.
_LETTERS = "(VALUES " + ", ".join(
    f"('{c}', '{s}')" for c, s in bases.IUPAC.items()) + ") iupac(code, letters)"


def _table(primers: dict, rev: bool = False) -> str:
    seqs = {n: (p if not rev else p.translate(str.maketrans(
        bases.COMPLEMENT_FROM, bases.COMPLEMENT_TO))[::-1]) for n, p in primers.items()}
    rows = ", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(seqs.items()))
    return f"""
, primers AS (SELECT * FROM (VALUES {rows}) t(ord, name, bases)),
places AS (SELECT ord, name, length(bases) AS plen, i, letters FROM (
   SELECT ord, name, bases, unnest(range(1, length(bases) + 1)) AS i FROM primers) z
   JOIN {_LETTERS} ON iupac.code = substr(bases, i, 1))"""


def _score_sql(primers, start, rev, max_error, select) -> str:
    at = f"length(seq) - {start} - plen + i" if rev else f"{start} + i"
    letter = f"CASE WHEN {at} >= 1 THEN substr(seq, {at}, 1) ELSE '' END"
    return with_reads(_table(primers, rev) + f"""
, d AS (SELECT DISTINCT seq FROM r1),
m AS (SELECT seq, ord, name, plen, 1 - count(*) FILTER ({letter} <> '' AND {letter} <> 'N'
        AND contains(letters, {letter})) / plen AS error FROM d CROSS JOIN places GROUP BY seq, ord, name, plen),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY error, ord) AS rn FROM m) z
      WHERE rn = 1 AND error <= {max_error})
{select}""")


def _show(df, *fields):
    return df.select("read_id", "seq", quality.encode(F.col("qual")).alias("qual"),
                     *[fx.text(F.col(f)).alias(f.lower()) for f in fields])


def _exact_sql(primers: dict) -> str:
    """First hit by strand, primer, place; reads without one are left out."""
    cases = []
    for strand, col in ((0, "seq"), (1, "rc")):
        for i, (n, p) in enumerate(primers.items()):
            rx = bases.iupac_regex(p)
            cases.append(f"CASE WHEN regexp_matches(left({col}, 30), '{rx}') THEN "
                         f"{{'strand': {strand}, 'name': '{n}', 'at': "
                         f"strpos(left({col}, 30), regexp_extract(left({col}, 30), '{rx}')), "
                         f"'plen': {len(p)}}} END")
    return with_reads(f"""
, t AS (SELECT *, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS rc FROM r1),
h AS (SELECT *, coalesce({', '.join(cases)}) AS hit FROM t),
o AS (SELECT read_id, CASE WHEN hit.strand = 1 THEN rc ELSE seq END AS s,
             CASE WHEN hit.strand = 1 THEN reverse(qual) ELSE qual END AS q, hit FROM h WHERE hit IS NOT NULL)
SELECT read_id, substr(s, hit.at + hit.plen) AS seq, substr(q, hit.at + hit.plen) AS qual,
       hit.name AS primer, CASE WHEN hit.strand = 1 THEN 'RC' ELSE 'F' END AS seqorient,
       left(s, CAST(hit.at - 1 AS INT)) AS barcode FROM o WHERE hit.at + hit.plen <= length(s)""")


EXACT = {"E1": "ACRT", "E2": "GGYA", "E3": "TTSKA"}

_SIX = 6  # primers made of each part


def part_primers(spark, sf_dir):
    """Six primers a part: 13 to 15 bases of a fragment, with one base replaced by R or Y."""
    at = F.lit(4) + F.col("i") % 2
    ord_ = F.col("p_partkey") * _SIX + F.col("i")
    digest = F.translate(F.md5(F.concat(F.lit("f"), (ord_ % derived.GROUPS).cast("string"))),
                         derived.HEX, derived.BASES)
    size = F.lit(13) + F.col("i") % 3
    place = (F.col("p_partkey") % 12 + 1).cast("int")
    plain = F.substr(digest, at, size)
    seq = F.concat(F.substr(plain, F.lit(1), place - 1),
                   F.translate(F.substr(plain, place, F.lit(1)), "ACGT", "RYRY"), F.substr(plain, place + 1))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", F.explode(F.sequence(F.lit(0), F.lit(_SIX - 1))).alias("i")).select(
        ord_.alias("ord"), F.concat(F.lit("P"), ord_.cast("string")).alias("name"), seq.alias("seq"))


def _many_sql(rev: bool, start: int, max_error: float, select: str) -> str:
    """All primers against all distinct windows, on packed bases."""
    codes, sets = "".join(bases.IUPAC), "".join(f"{bases.base_bits(c, True):x}" for c in bases.IUPAC)
    reads = codes, "".join(f"{bases.base_bits(c, False):x}" for c in bases.IUPAC)
    pad = "lpad" if rev else "rpad"
    primer = ("reverse(translate(seq, '" + bases.COMPLEMENT_FROM + "', '" + bases.COMPLEMENT_TO + "'))") if rev else "seq"
    window = f"right(left(seq, length(seq) - {start}), 15)" if rev else f"substr(seq, {start + 1}, 15)"
    return with_reads(f"""
, pk AS (SELECT p_partkey * {_SIX} + i AS ord, 4 + i % 2 AS "at", 13 + i % 3 AS size, CAST(p_partkey % 12 + 1 AS INT) AS place,
         translate(md5(concat('f', CAST((p_partkey * {_SIX} + i) % {derived.GROUPS} AS VARCHAR))),
                   '{derived.HEX}', '{derived.BASES}') AS f
  FROM part CROSS JOIN (SELECT unnest(range(0, {_SIX})) AS i) n),
pl AS (SELECT ord, size, place, substr(f, "at", size) AS p FROM pk),
pr AS (SELECT ord, concat('P', CAST(ord AS VARCHAR)) AS name, size AS plen,
         concat(left(p, place - 1), translate(substr(p, place, 1), 'ACGT', 'RYRY'), substr(p, place + 1)) AS seq FROM pl),
pp AS (SELECT ord, name, plen, CAST(concat('0x', {pad}(translate({primer}, '{codes}', '{sets}'), 15, '0')) AS BIGINT) AS pw FROM pr),
d AS (SELECT DISTINCT CAST(concat('0x', {pad}(translate({window}, '{reads[0]}', '{reads[1]}'), 15, '0')) AS BIGINT) AS w FROM r1),
m AS (SELECT w, name, plen, ord, (w & pw) AS x FROM d CROSS JOIN pp),
e AS (SELECT w, name, plen, ord, 1 - bit_count((x | (x >> 1) | (x >> 2) | (x >> 3)) & {int("1" * 15, 16)}) / plen AS error FROM m),
b AS (SELECT w, arg_min({{'name': name, 'plen': plen}}, (error, ord)) AS hit FROM e WHERE error <= {max_error} GROUP BY w),
q AS (SELECT *, CAST(concat('0x', {pad}(translate({window}, '{reads[0]}', '{reads[1]}'), 15, '0')) AS BIGINT) AS w FROM r1)
{select}""")


QUERIES = {
    "prm2_score_many": (
        lambda s, d: _show(primers_score_many(
            r1(s, d), part_primers(s, d), start=3, max_error=0.2, mode="cut", barcode=True), "PRIMER", "BARCODE"),
        _many_sql(False, 3, 0.2, """
SELECT read_id, substr(seq, CAST(4 + hit.plen AS INT)) AS seq, substr(qual, CAST(4 + hit.plen AS INT)) AS qual, hit.name AS primer,
       left(seq, 3) AS barcode FROM q JOIN b ON q.w = b.w"""),
    ),
    "prm1_extract_mask": (
        lambda s, d: _show(op.primers_extract(r1(s, d), 8, start=4, barcode=True),
                           "PRIMER", "BARCODE"),
        with_reads("SELECT read_id, concat('NNNNNNNN', substr(seq, 13)) AS seq, "
                   "concat('!!!!!!!!', substr(qual, 13)) AS qual, substr(seq, 5, 8) AS primer, "
                   "left(seq, 4) AS barcode FROM r1"),
    ),
    "prm1_extract_cut": (
        lambda s, d: _show(op.primers_extract(
            r1(s, d), 15, start=2, mode="cut", barcode=True, barcode_length=1), "PRIMER", "BARCODE"),
        with_reads("SELECT read_id, substr(seq, 18) AS seq, substr(qual, 18) AS qual, "
                   "substr(seq, 3, 15) AS primer, substr(seq, 2, 1) AS barcode FROM r1"),
    ),
    "prm1_extract_trim_tail": (
        lambda s, d: _show(op.primers_extract(
            r1(s, d), 6, start=3, mode="trim", rev_primer=True, barcode=True), "PRIMER", "BARCODE"),
        with_reads("SELECT read_id, left(seq, 37) AS seq, left(qual, 37) AS qual, "
                   "substr(seq, 32, 6) AS primer, right(seq, 3) AS barcode FROM r1"),
    ),
    "prm1_extract_tag": (
        lambda s, d: _show(op.primers_extract(r1(s, d), 5, mode="tag"), "PRIMER"),
        with_reads("SELECT read_id, seq, qual, left(seq, 5) AS primer FROM r1"),
    ),
    "prm2_score_cut": (
        lambda s, d: _show(op.primers_score(
            r1(s, d), SHORT, start=3, max_error=0.4, mode="cut", barcode=True), "PRIMER", "BARCODE"),
        _score_sql(SHORT, 3, False, 0.4, """
SELECT read_id, substr(r1.seq, 4 + plen) AS seq, substr(qual, 4 + plen) AS qual, name AS primer,
       left(r1.seq, 3) AS barcode FROM r1 JOIN b ON r1.seq = b.seq"""),
    ),
    "prm2_score_mask_long": (
        lambda s, d: _show(op.primers_score(
            r1(s, d), LONG, start=0, max_error=0.5, mode="mask"), "PRIMER"),
        _score_sql(LONG, 0, False, 0.5, """
SELECT read_id, concat(repeat('N', plen), substr(r1.seq, 1 + plen)) AS seq,
       concat(repeat('!', plen), substr(qual, 1 + plen)) AS qual, name AS primer
FROM r1 JOIN b ON r1.seq = b.seq"""),
    ),
    "prm2_score_tail": (
        lambda s, d: _show(op.primers_score(
            r1(s, d), SHORT, start=4, max_error=0.4, mode="mask", rev_primer=True), "PRIMER"),
        _score_sql(SHORT, 4, True, 0.4, """
SELECT read_id, concat(left(r1.seq, 36 - plen), repeat('N', plen)) AS seq,
       concat(left(qual, 36 - plen), repeat('!', plen)) AS qual, name AS primer
FROM r1 JOIN b ON r1.seq = b.seq"""),
    ),
    "prm2_score_fail": (
        lambda s, d: op.primers_score(
            r1(s, d), SHORT, start=3, max_error=0.4, keep="fail").select("read_id", "seq"),
        _score_sql(SHORT, 3, False, 0.4,
                   "SELECT read_id, seq FROM r1 WHERE seq NOT IN (SELECT seq FROM b)"),
    ),
    "prm3_align_exact": (
        lambda s, d: _show(op.primers_align(
            r1(s, d), EXACT, max_error=0.0, max_len=30, gap_penalty=None, mode="cut",
            barcode=True), "PRIMER", "SEQORIENT", "BARCODE"),
        _exact_sql(EXACT),
    ),
    "prm3_align_ungapped": (
        lambda s, d: _show(op.primers_align(
            r1(s, d), SHORT, max_error=0.3, max_len=20, gap_penalty=None, skip_rc=True,
            mode="trim"), "PRIMER"),
        with_reads(_table(SHORT) + """
, d AS (SELECT DISTINCT seq FROM r1),
sc AS (SELECT seq, ord, name, plen, p."off" AS "off", 1 - count(*) FILTER (substr(seq, p."off" + i, 1) <> 'N'
        AND contains(letters, substr(seq, p."off" + i, 1))) / plen AS error
      FROM d CROSS JOIN places CROSS JOIN (SELECT unnest(range(0, 20)) AS "off") p WHERE p."off" + plen <= 20
      GROUP BY seq, ord, name, plen, p."off"),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY error, ord, "off") AS rn FROM sc) z
      WHERE rn = 1 AND error <= 0.3)
SELECT read_id, substr(r1.seq, 1 + "off") AS seq, substr(qual, 1 + "off") AS qual, name AS primer
FROM r1 JOIN b ON r1.seq = b.seq"""),
    ),
    "prm3_align_gapped": (
        lambda s, d: _show(op.primers_align(
            r1(s, d), SHORT, max_error=0.3, max_len=30, mode="cut"), "PRIMER", "SEQORIENT"),
        None,
    ),
}
