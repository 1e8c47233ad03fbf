"""Mix sources to target weights by whole copies of documents.

Sizes are summed by source, targets give each source a repetition rate, and a
document is emitted floor(rate) times plus once more with probability equal to
the fraction, drawn from a hash of its id.  Documents never meet their source
in one place: only the small table of sources travels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.llm.shared import free_name, parts, written

#: Words, as the sizes count them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

SHARE = 1.5
WEIGHTS = (5, 2, 1)
MOST = 2.0

#: Up to so many sources their table is broadcast (a few MB); above, sources join by salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 32

_HEX = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _ranked(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without one task seeing all."""
    dealt = sizes.repartitionByRange(
        parts(sizes.sparkSession), F.col("source").isNull(), F.col("source")).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return dealt.join(starts, "_part").select(
        "source", "source_size", (F.row_number().over(inside) - 1 + F.col("_start")).alias("rank"))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Add ``target`` to a table of source, source_size.

    Sources by code point, null last, weigh ``weights``, repeating, and share
    ``share`` times all sizes.  No target is above ``most`` times its source's
    size: the excess is shared again among the others until none is above.
    """
    ranked = _ranked(sizes).withColumns({
        "weight": F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int")),
        "cap": F.col("source_size") * F.lit(float(most))})
    ranked = written(ranked, "ranked")
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        total, held, open_weight, now_full = ranked.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(~over, F.col("weight")).otherwise(0)), F.count_if(over)).first()
        if now_full == full or not open_weight:
            break
        full = now_full
        level = (share * total - held) / open_weight
    fair = F.col("cap") if level is None or not open_weight else F.least("cap", F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", fair.alias("target"))


def _copies(rate: Column, doc_id: Column, text: Column, seed: str) -> Column:
    """floor(rate), and one more if the hash of id and text falls below the fraction."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat_ws("/", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), own)
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, _HEX), 16, 10).cast("bigint").cast("double") / float(16 ** _HEX)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def plan(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: float = MOST,
         seed: str = "mix") -> DataFrame:
    """Add size, source_size, target and copies to the rows of ``docs`` (doc_id, text, source).

    Null text has size 0; null is a source of its own, after all others; a
    source without words has target 0 and no copies; rows draw by
    id (a null one like an id called null) and text, so only rows that are equal in both
    draw alike.  Columns of ``docs`` with
    the names of the added ones must be renamed or dropped before.
    """
    sized = docs.withColumn("size", n_words(F.col("text")))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    goals = written(goals, "targets").withColumnRenamed("source", "_source")
    if goals.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("_source")))
    else:
        spread = goals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = sized.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt"))) \
            .drop("_own", "_salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("copies", _copies(rate, F.col("doc_id"), F.col("text"), seed)).drop("_source")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan says, with its own columns."""
    own = {c: free_name(docs, f"own{i}") for i, c in enumerate(docs.columns)}
    carried = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()],
                          *[F.col(c) for c in ("doc_id", "text", "source")])
    return (
        plan(carried, **settings).where("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*[F.col(n).alias(c) for c, n in own.items()]))


def summary(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken (words that the mix takes of it)."""
    return plan(docs.select("doc_id", "text", "source"), **settings).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS own, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w, 2.0::DOUBLE * sum(size) AS cap
  FROM d GROUP BY source),
r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM s),
t AS (
  SELECT source, source_size,
         least(cap, w * coalesce((SELECT min_by(lv, cap / w) FROM r WHERE lv * w <= cap), 'inf'::DOUBLE)) AS target FROM s)
SELECT doc_id, size, source_size, target,
       size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix/' || coalesce(doc_id::VARCHAR, 'null') || '/' || own), 1, 13))::BIGINT::DOUBLE
                                       / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM (SELECT d.doc_id, d.own, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source) x
"""
