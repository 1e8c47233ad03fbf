"""Scans of FASTA files, headers and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjloom.functions import fields as fx

MAX_PRIMER_ROWS = 10_000


def field_of(header: Column, name: str) -> Column:
    """The values of one annotation of a header ``ID|K=V|K=V1,V2``."""
    parts = F.slice(F.split(header, r"\|"), F.lit(2), F.size(F.split(header, r"\|")))
    hits = F.filter(parts, lambda p: F.upper(F.substring_index(p, "=", 1)) == name.upper())
    last = F.get(F.slice(hits, -1, 1), F.lit(0))
    return F.when(F.size(hits) > 0, F.split(F.substr(last, F.lit(len(name) + 2)), ","))


def parse_header(df: DataFrame, fields: list[str], header: str = "header") -> DataFrame:
    """Add ``read_id`` and one ARRAY<STRING> column per declared field."""
    col = F.col(header)
    return df.withColumns({
        "read_id": F.substring_index(col, "|", 1),
        **{f.upper(): field_of(col, f) for f in fields}})


def profile_fields(df: DataFrame, max_records: int | None = None, header: str = "header") -> DataFrame:
    """(field, records): annotation names among all headers, or the ``max_records`` first ones by ``seq_no``."""
    parts = F.slice(F.split(header, r"\|"), F.lit(2), F.size(F.split(header, r"\|")))
    named = F.filter(parts, lambda p: p.contains("="))
    names = F.array_distinct(F.transform(named, lambda p: F.upper(F.trim(
        F.substring_index(p, "=", 1)))))
    seen = df if max_records is None else df.orderBy("seq_no").limit(max_records)
    return (
        seen.select(F.explode(names).alias("field"))
        .groupBy("field").agg(F.count("*").alias("records"))
    )


def profile_summary(df: DataFrame, header: str = "header") -> DataFrame:
    """One row (records, with_fields, parsed): how many headers hold a field with a name, and whether any does."""
    parts = F.slice(F.split(header, r"\|"), F.lit(2), F.size(F.split(header, r"\|")))
    named = F.exists(parts, lambda p: F.trim(F.substring_index(p, "=", 1)) != F.trim(p))
    found = F.count_if(F.coalesce(named, F.lit(False)))
    return df.agg(F.count("*").alias("records"), found.alias("with_fields"), (found > 0).alias("parsed"))


def read_fasta(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """FASTA records: header, seq (line breaks removed), seq_no, read_id, fields.

    Files are split at ``\\n>``, so large files are read in parallel.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    cut = raw.select(record.alias("r")).filter(F.length(F.trim("r")) > 0).select(
        F.substring_index("r", "\n", 1).alias("header"),
        F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "").alias("seq"),
        F.monotonically_increasing_id().alias("seq_no"))
    return parse_header(cut, fields or [])


def read_contig_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, header, sequence, seq_no); the id ends at the first blank."""
    return read_fasta(spark, path).select(
        F.regexp_extract("header", r"^(\S+)", 1).alias("sequence_id"), "header",
        F.col("seq").alias("sequence"), "seq_no")


def _table(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """A delimited file with every column as text and the row order kept."""
    return spark.read.csv(
        path, sep=sep, header=True, inferSchema=False, nullValue="", emptyValue="",
        escape='"').withColumn("seq_no", F.monotonically_increasing_id())


def read_contig_csv(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, ",")


def read_airr_tsv(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "\t")


def read_barcode_map(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV by suffix; all rows (the last per id wins when it is used)."""
    return _table(spark, path, "\t" if path.lower().endswith(".tsv") else ",")


def read_barcode_report(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "\t")


def read_primers(spark: SparkSession, path: str) -> dict[str, str]:
    """Primer names and bases; a small file, checked to be small (see ``read_primer_table``)."""
    rows = read_fasta(spark, path).orderBy("seq_no").select(
        F.trim(F.translate("header", "\t", " ")).alias("name"),
        F.upper("seq").alias("seq")).take(MAX_PRIMER_ROWS + 1)
    if len(rows) > MAX_PRIMER_ROWS:
        raise ValueError(f"{path} has more than {MAX_PRIMER_ROWS} primers, read_primer_table takes them")
    return {r["name"]: r["seq"] for r in rows}


def read_primer_table(spark: SparkSession, path: str) -> DataFrame:
    """Primers as (ord, name, seq), of any number, for the join form of scoring."""
    return read_fasta(spark, path).select(
        F.col("seq_no").alias("ord"), F.trim(F.translate("header", "\t", " ")).alias("name"),
        F.upper("seq").alias("seq"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) with alignment gaps removed."""
    return read_fasta(spark, path).select(
        F.trim("header").alias("name"), F.upper(F.translate("seq", ".-", "")).alias("seq"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="primer string, offset int")


def read_values(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The column named like the field from a TSV value list."""
    return spark.read.csv(path, sep="\t", header=True).select(
        F.col(field).cast("string").alias(field))


def first_present(df: DataFrame, names: list[str]) -> Column:
    """First non-empty column among ``names``, found without regard to case."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.col(f"`{have[n.lower()]}`"), F.lit("")) for n in names
             if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


# -- 10x reads ---------------------------------------------------------------------

# Inclusive 0-based (barcode, UMI) ranges of read 1 per chemistry.
CHEMISTRIES = {"v2": ((0, 15), (16, 25)), "v3": ((0, 15), (16, 27))}


def extract_10x_tags(r1: DataFrame, r2: DataFrame, chemistry: str | tuple = "v2") -> DataFrame:
    """Cut barcode and UMI out of read 1 and attach them to read 2; an id that occurs twice in read 1 stops the run."""
    ranges = CHEMISTRIES.get(chemistry) if isinstance(chemistry, str) else chemistry
    if ranges is None:
        raise ValueError(f"unknown chemistry {chemistry!r}; use {list(CHEMISTRIES)} or ranges")
    for low, high in ranges:
        if low < 0 or high < low:
            raise ValueError(f"range {low}-{high} is inverted")

    def cut(r):
        return F.array(F.substr("seq", F.lit(r[0] + 1), F.lit(r[1] - r[0] + 1)))

    once = r1.groupBy("read_id").agg(F.count("*").alias("_n"), F.min("seq").alias("seq"))
    message = F.concat(F.lit("a read id occurs more than once in read 1: "), F.col("read_id"))
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast("string")).otherwise(F.col("seq"))
    tags = once.select("read_id", checked.alias("seq")).select(
        "read_id", cut(ranges[0]).alias("BARCODE"), cut(ranges[1]).alias("UMI"))
    return r2.drop("BARCODE", "UMI").join(tags, "read_id")


def whitelist(df: DataFrame, allowed: DataFrame, field: str = "BARCODE") -> DataFrame:
    """Keep reads whose barcode is in the first column of ``allowed``."""
    table = allowed.select(F.col(allowed.columns[0]).alias("_b")).distinct()
    return df.withColumn("_b", fx.text(F.col(field))).join(table, "_b", "left_semi").drop("_b")


def _tag(header: Column, tag: str) -> Column:
    value = F.regexp_extract(header, rf"\s{tag}:[^:\s]*:(\S+)", 1)
    return F.nullif(F.nullif(value, F.lit("")), F.lit("-"))


def split_tags(df: DataFrame, header: str = "header") -> DataFrame:
    """BARCODE and UMI from ``CB:Z:``/``UB:Z:`` comments; reads without a
    barcode are dropped, a missing UMI becomes N."""
    barcode, umi = _tag(F.col(header), "CB"), _tag(F.col(header), "UB")
    return df.withColumns({
        "read_id": F.regexp_extract(header, r"^(\S+)", 1), "BARCODE": F.array(barcode),
        "UMI": F.array(F.coalesce(umi, F.lit("N")))}).filter(barcode.isNotNull())


def tag_counts(df: DataFrame, header: str = "header") -> DataFrame:
    """One row: reads, reads with a barcode, and of those with a UMI."""
    barcode, umi = _tag(F.col(header), "CB"), _tag(F.col(header), "UB")
    return df.agg(
        F.count("*").alias("reads"),
        F.count_if(barcode.isNotNull()).alias("reads_with_barcode"),
        F.count_if(barcode.isNotNull() & umi.isNotNull()).alias("reads_with_umi"))
