"""Token totals that follow signed changes.

A store keeps, per committed batch, the documents' counts that the batch set
(the ledger) and the signed sums by source, language and tokenizer version that
follow from it (the deltas).  A change retracts what the ledger holds for its
document and adds the new count, so totals are plain sums of deltas and no
commit reads the documents again.  A batch counts once its marker is written,
last: an interrupted batch is written over, a repeated one changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.llm.mixing import n_words
from vdjloom.llm.shared import new_path, written

CHANGES = "seq bigint, op string, doc_id bigint, version string, source string, lang string, tokens bigint"
_LEDGER = "batch_no bigint, alive boolean, doc_id bigint, version string, source string, lang string, tokens bigint"
_DELTAS = "source string, lang string, version string, docs bigint, tokens bigint"


def _status(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if there is no such folder, in any store that Spark reaches."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(folder)) if store.exists(folder) else []


def committed(spark: SparkSession, root: str) -> list[str]:
    """Committed batches: those whose marker was written to its end."""
    return [b for b in _status(spark, f"{root}/commits") if "_SUCCESS" in _status(spark, f"{root}/commits/{b}")]


def _read(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    paths = [f"{root}/batches/{b}/{kind}" for b in committed(spark, root)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit(spark: SparkSession, root: str, batch: str, changes: DataFrame) -> bool:
    """Apply a batch of ``changes`` (CHANGES) to the store at ``root``; False if it was committed before.

    op is insert, revise or delete.  insert and revise set the document's count
    under a tokenizer version, whether or not there was one; delete takes it
    away, if there is one.  Of several changes to a document and version in a
    batch the one with the largest seq counts (of equal ones, the largest row).
    Null source, lang or version is a value of its own, null tokens are 0, and
    changes without a doc_id or with another op take no part.  One writer at a
    time; a batch name must do as a folder name.
    """
    done = committed(spark, root)
    if batch in done:
        return False
    change = F.struct("seq", "op", "source", "lang", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    last = (
        changes.where("doc_id IS NOT NULL AND op IN ('insert', 'revise', 'delete')")
        .groupBy("doc_id", "version").agg(F.max(change).alias("c")))
    prior = (
        _read(spark, root, "ledger", _LEDGER).groupBy("doc_id", "version")
        .agg(F.max_by(F.struct("alive", "source", "lang", "tokens"), "batch_no").alias("p")).where("p.alive")
        .toDF("_id", "_version", "p"))
    met = last.join(prior, (F.col("doc_id") == F.col("_id")) & F.col("version").eqNullSafe(F.col("_version")), "left") \
        .drop("_id", "_version").where("c.op <> 'delete' OR p IS NOT NULL")
    folder = f"{root}/batches/{batch}"
    # Both tables come from one pass, kept with the batch so that a lost executor costs no second one.
    met.write.mode("overwrite").parquet(f"{folder}/met")
    met = spark.read.parquet(f"{folder}/met")
    met.select(F.lit(len(done)).cast("bigint").alias("batch_no"), (F.col("c.op") != "delete").alias("alive"), "doc_id",
               "version", "c.source", "c.lang", "c.tokens").write.mode("overwrite").parquet(f"{folder}/ledger")
    signed = lambda side, sign: F.struct(
        F.col(f"{side}.source").alias("source"), F.col(f"{side}.lang").alias("lang"), "version",
        F.lit(sign).cast("bigint").alias("docs"), (F.col(f"{side}.tokens") * sign).alias("tokens"))
    rows = F.array_compact(F.array(
        F.when(F.col("p").isNotNull(), signed("p", -1)), F.when(F.col("c.op") != "delete", signed("c", 1))))
    (met.select(F.inline(rows)).groupBy("source", "lang", "version")
     .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{folder}/deltas"))
    spark.range(1).write.mode("overwrite").parquet(f"{root}/commits/{batch}")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, version, docs, tokens: sums over all committed batches; no row where no document is left."""
    return (
        _read(spark, root, "deltas", _DELTAS).groupBy("source", "lang", "version")
        .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0"))


# Runs without white space that hold a letter or digit; runs of letters and digits.
_FIXED, _WORDS = r"[^\x20\x09-\x0D]*[0-9A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*", r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _count(pattern: str) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("bigint")


def counted(docs: DataFrame, root: str) -> DataFrame:
    """Totals of ``docs`` (doc_id, text, source, lang) after the changes of a corpus' life, committed to ``root``.

    Version ``spaced`` counts runs without white space, ``words`` runs of letters
    and digits.  All rows are inserted under ``spaced``, then under ``words`` with
    that count as an estimate, which is revised where it differs; counts under
    ``spaced`` are revised where they took in marks without a letter or digit, and
    later copies of a text are deleted.  What the store then holds is reported as
    ``first_docs`` and ``first_tokens``.  As every row is to count, the copies are
    inserted again and the counts under ``spaced`` set back: ``docs`` and
    ``tokens``.  Two batches come again and change nothing.

    Of equal texts the row with the smallest doc_id is first (null last), then
    that with the smallest source and lang (null first).  Rows are told apart by a
    number written with the counts, so rows that share an id, repeat or have none
    all count; null text has no tokens and no copies, null source and lang are
    values of their own, an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("id"),
        "source", "lang", n_words(F.col("text")).alias("spaced"), _count(_FIXED).alias("fixed"), _count(_WORDS).alias("words"),
        F.md5("text").alias("key")), "counts").withColumnRenamed("row", "doc_id")
    first = counts.where("key IS NOT NULL").groupBy("key").agg(
        F.min_by("doc_id", F.struct("id", "source", "lang", "doc_id")).alias("first"), F.count("*").alias("n"))
    copies = counts.join(first.where("n > 1"), "key").where("doc_id <> first")

    def changes(rows: DataFrame, seq: int, op: str, version: str, tokens: str) -> DataFrame:
        return rows.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"), "doc_id",
                           F.lit(version).alias("version"), "source", "lang", F.col(tokens).alias("tokens"))

    def both(seq: int, op: str) -> DataFrame:
        return changes(copies, seq, op, "spaced", "spaced").unionByName(changes(copies, seq, op, "words", "words"))

    marked = counts.where("fixed <> spaced")
    batches = {
        "load": changes(counts, 1, "insert", "spaced", "spaced"),
        "estimate": changes(counts, 2, "insert", "words", "spaced"),
        "revise": changes(counts.where("words <> spaced"), 3, "revise", "words", "words").unionByName(
            changes(marked, 3, "revise", "spaced", "fixed")),
        "copies": both(4, "delete"),
    }
    for name in (*batches, "load", "copies"):
        commit(spark, root, name, batches[name])
    kept = totals(spark, root).select(
        F.struct("source", "lang", "version").alias("_kept"), F.col("docs").alias("first_docs"), F.col("tokens").alias("first_tokens"))
    commit(spark, root, "restore", both(5, "insert").unionByName(changes(marked, 5, "revise", "spaced", "spaced")))
    zero = F.lit(0).cast("bigint")
    return totals(spark, root).join(kept, F.struct("source", "lang", "version").eqNullSafe(F.col("_kept")), "left").select(
        "source", "lang", "version", "docs", "tokens", F.coalesce("first_docs", zero).alias("first_docs"),
        F.coalesce("first_tokens", zero).alias("first_tokens"))


def token_counts(docs: DataFrame) -> DataFrame:
    """``counted`` in a new store in the shared folder; other columns are ignored."""
    return counted(docs, new_path(docs.sparkSession, "rollup"))


SQL = r"""
WITH d AS (
  SELECT source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS spaced,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]*[0-9A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*')), 0) AS fixed,
         coalesce(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')), 0) AS words,
         text IS NULL OR row_number() OVER (
           PARTITION BY text ORDER BY doc_id NULLS LAST, source NULLS FIRST, lang NULLS FIRST) = 1 AS stays
  FROM documents)
SELECT source, lang, 'spaced' AS version, count(*) AS docs, sum(spaced)::BIGINT AS tokens,
       count(*) FILTER (stays) AS first_docs, coalesce(sum(fixed) FILTER (stays), 0)::BIGINT AS first_tokens
FROM d GROUP BY ALL
UNION ALL
SELECT source, lang, 'words', count(*), sum(words)::BIGINT,
       count(*) FILTER (stays), coalesce(sum(words) FILTER (stays), 0)::BIGINT
FROM d GROUP BY ALL
"""
