"""Writers: FASTQ, FASTA, tables, part files, fingerprints, run summary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions import quality
from vdjloom.operators.headers import flatten_header, header_table
from vdjloom.sources.fastq import _open
from vdjloom.sources.schema import require_quality

WRAP = 70


def fastq_text(df: DataFrame) -> Column:
    require_quality(df)
    return F.concat(F.lit("@"), flatten_header(df), F.lit("\n"), F.col("seq"), F.lit("\n+\n"),
                    quality.encode(F.col("qual")))


def fasta_text(df: DataFrame) -> Column:
    return F.concat(F.lit(">"), flatten_header(df), F.lit("\n"), F.col("seq"))


def write_fastq(df: DataFrame, path: str, compression: str = "none") -> None:
    df.select(fastq_text(df).alias("value")).write.option("compression", compression).text(path)


def write_fasta(df: DataFrame, path: str, compression: str = "none") -> None:
    df.select(fasta_text(df).alias("value")).write.option("compression", compression).text(path)


def to_fasta(df: DataFrame) -> DataFrame:
    """Reads without their quality."""
    return df.withColumn("qual", F.lit(None).cast("array<tinyint>"))


def wrapped(seq: Column, width: int = WRAP) -> Column:
    """A sequence broken into lines of ``width`` bases."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def final_fasta_text() -> Column:
    return F.concat(F.lit(">"), F.col("sequence_id"), F.lit("\n"), wrapped(F.col("sequence")))


def write_final_fasta(records: DataFrame, path: str) -> None:
    """FASTA whose headers hold the id only."""
    records.select(final_fasta_text().alias("value")).write.text(path)


def write_metadata(records: DataFrame, path: str) -> None:
    """TSV of the record fields; a NULL is an empty cell."""
    records.write.csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def write_header_table(df: DataFrame, fields: list[str], path: str) -> None:
    header_table(df, fields).write.csv(path, sep="\t", header=True, nullValue="")


def error_text(table: DataFrame) -> DataFrame:
    """Rates with six decimals, NA for missing ones.

    The exact binary value is rounded, half to even, as C's printf does; Java's
    format rounds the shortest decimal text instead, which ties more often.
    """
    six = F.udf(lambda v: None if v is None else f"{v:.6f}", "string", useArrow=True)
    shown = []
    for name, kind in table.dtypes:
        value = six(F.col(name)) if kind == "double" else F.col(name).cast("string")
        shown.append(F.coalesce(F.when(F.col(name).isNotNull(), value), F.lit("NA")).alias(name))
    return table.select(*shown)


def write_error_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        error_text(table).write.csv(f"{path}/{name}", sep="\t", header=True)


def write_parts(df: DataFrame, path: str, part: str = "part", kind: str = "parquet",
                rows_per_file: int = 5_000_000) -> None:
    """One folder per part value.

    A part's rows are spread over all tasks, never gathered into one; files
    are cut at ``rows_per_file`` rows.
    """
    df.write.partitionBy(part).option("maxRecordsPerFile", rows_per_file).format(kind).save(path)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            system, inner = _open(path)
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(inner, compression=None) as stream:
                while piece := stream.read(1 << 20):
                    digest.update(piece)
                    size += len(piece)
            rows.append((path.rsplit("/", 1)[-1], size, digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["name", "size_bytes", "sha256"])


def fingerprint(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(name, size_bytes, sha256) per file, streamed in one task per file."""
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(len(paths), 1), "path").mapInPandas(
        _digests, "name string, size_bytes bigint, sha256 string")


def _row_text(df: DataFrame) -> Column:
    """All columns of a row, by name, each with its length in front so that no two rows read alike."""
    values = [F.col(f"`{c}`").cast("string") for c in sorted(df.columns)]
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def table_fingerprint(df: DataFrame, digits: int = 2) -> DataFrame:
    """(bucket, n_rows, sha256) of a table's content, whatever its order, files and partitions.

    Rows are hashed where they are and summed map-side by the first ``digits`` hex
    digits of their hash, so the shuffle carries at most 16 ** digits rows a task.
    Repeated rows count, null differs from empty text, column order does not
    matter; an empty table has no buckets.  Sums find changes, they are no
    defence against rows made to collide.
    """
    hashed = df.select(F.sha2(_row_text(df), 256).alias("h"))
    sums = [F.sum(F.conv(F.substr("h", F.lit(i * 15 + 1), F.lit(15)), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
            for i in range(4)]
    return hashed.groupBy(F.left("h", F.lit(digits)).alias("bucket")).agg(
        F.count("*").alias("n_rows"), *sums).select(
        "bucket", "n_rows", F.sha2(F.concat_ws(",", "n_rows", *[f"s{i}" for i in range(4)]), 256).alias("sha256"))


def whole_fingerprint(buckets: DataFrame) -> DataFrame:
    """One row (n_rows, sha256) from the bounded number of buckets of ``table_fingerprint``."""
    ordered = F.array_sort(F.collect_list(F.concat("bucket", "sha256")))
    return buckets.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
                       F.sha2(F.array_join(ordered, ","), 256).alias("sha256"))


def run_summary(records: DataFrame, report: DataFrame, files: DataFrame, options: dict
                ) -> DataFrame:
    """One JSON row: counts, parse report, file fingerprints and options."""
    counts = records.agg(
        F.count("*").alias("records"), F.count_distinct("cell_id").alias("cells"))
    listed = files.agg(F.sort_array(F.collect_list(F.struct(*files.columns))).alias("files"))
    parts = [counts.select(F.struct("*").alias("counts")),
             report.select(F.struct("*").alias("report")), listed]
    joined = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        joined = joined.join(part.withColumn("_one", F.lit(1)), "_one")
    pairs = [c for k, v in options.items() for c in (F.lit(k), F.lit(str(v)))]
    shown = F.create_map(*pairs) if pairs else F.lit(None)
    return joined.select(F.to_json(F.struct(
        "counts", "report", "files", shown.alias("options"))).alias("summary"))
