"""Sources and sinks: each query writes files from the tables and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vdjloom.catalog.common import MATES, r1, r2, with_reads
from vdjloom.catalog.errors import POSITION_TEXT
from vdjloom.functions import fields as fx
from vdjloom.functions import quality
from vdjloom.functions.durable import shared_dir
from vdjloom.operators import errors, headers, split
from vdjloom.sources import derived, fastq, sinks, text


def _folder(s, name):
    return f"{shared_dir(s)}/vdjloom-{name}-{uuid.uuid4().hex}"


def _local(path):
    return path.removeprefix("file://").removeprefix("file:")


def _fastq(s, d):
    path = _folder(s, "fastq")
    sinks.write_fastq(r1(s, d), path)
    return fastq.read_fastq(s, _local(path), ["BARCODE", "SAMPLE"], split_bytes=1 << 18)


def _fasta(s, d):
    path = _folder(s, "fasta")
    sinks.write_fasta(r1(s, d), path)
    return text.read_fasta(s, path, ["BARCODE", "SAMPLE"])


def _header_text(df):
    return df.select("seq", headers.flatten_header(df).alias("header"))


def _tagged(s, d):
    """Headers with barcode and UMI comments; some lack the one or the other."""
    code = F.element_at("BARCODE", 1)
    cb = F.when(F.col("seq_no") % 5 == 0, F.lit("")).when(
        F.col("seq_no") % 5 == 1, F.lit(" CB:Z:-")).otherwise(F.concat(F.lit(" CB:Z:"), code))
    ub = F.when(F.col("seq_no") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(" UB:Z:"), F.left(code, F.lit(8))))
    return r2(s, d).select("seq", "qual", F.concat("read_id", cb, ub).alias("header"))


def _parts(s, d):
    path = _folder(s, "parts")
    sinks.write_parts(split.split_group(r1(s, d), "PRIMER").select("read_id", "seq", "part"), path)
    return s.read.parquet(path).select("read_id", "seq", "part")


def _written_table(s, d):
    path = _folder(s, "table")
    sinks.write_header_table(r1(s, d), ["PRIMER", "BARCODE"], path)
    return s.read.csv(path, sep="\t", header=True)


def _offsets(s, d):
    path = _folder(s, "offsets")
    s.read.parquet(f"{d}/nation.parquet").select("n_name", "n_regionkey").write.csv(path, sep="\t")
    return text.read_offsets(s, path)


def _values(s, d):
    path = _folder(s, "values")
    r2(s, d).select(fx.text(F.col("BARCODE")).alias("BARCODE"), "read_id").write.csv(
        path, sep="\t", header=True)
    return text.read_values(s, path, "BARCODE")


def _primers(s, d):
    path = _folder(s, "primers")
    rows = s.read.parquet(f"{d}/nation.parquet").select(
        F.concat(F.lit(">"), "n_name", F.lit("\t\n"), F.translate(
            F.substring(F.md5("n_name"), 1, 20), derived.HEX, derived.BASES)).alias("value"))
    rows.write.text(path)
    primers = text.read_primers(s, path)
    return s.createDataFrame(list(primers.items()), "name string, bases string")


def _final(s, d):
    return derived.fragments(s, d).select(
        F.col("name").alias("sequence_id"), F.concat("seq", "seq", "seq").alias("sequence"))


def _final_round(s, d):
    path = _folder(s, "final")
    sinks.write_final_fasta(_final(s, d), path)
    return text.read_contig_fasta(s, path).select("sequence_id", "sequence")


def _plain(s, d):
    return r1(s, d).select("read_id", "seq", quality.encode(F.col("qual")).alias("qual"),
                           fx.text(F.col("BARCODE")).alias("barcode"), F.when(
                               F.col("seq_no") % 3 != 0, F.col("seq_no")).alias("number"))


def _fingerprint_sql(select):
    columns = ", ".join(f"coalesce(CAST(length({v}) AS VARCHAR) || ':' || {v}, '-')" for v in (
        "barcode", "number", "qual", "read_id", "seq"))
    sums = ", ',', ".join(f"CAST(sum(CAST(concat('0x', substr(h, {i * 15 + 1}, 15)) AS BIGINT)) AS VARCHAR)" for i in range(4))
    return with_reads(f"""
, p AS (SELECT read_id, seq, qual, barcode, CASE WHEN seq_no % 3 <> 0 THEN CAST(seq_no AS VARCHAR) END AS number FROM r1),
h AS (SELECT sha256(concat({columns})) AS h FROM p),
b AS (SELECT left(h, 2) AS bucket, count(*) AS n_rows,
        sha256(concat(CAST(count(*) AS VARCHAR), ',', {sums})) AS sha256 FROM h GROUP BY 1)
SELECT {select} FROM b""")


QUERIES = {
    "src1_read_fastq": (
        lambda s, d: _fastq(s, d).select(
            "read_id", "seq", quality.encode(F.col("qual")).alias("qual"),
            fx.text(F.col("BARCODE")).alias("barcode"), fx.text(F.col("SAMPLE")).alias("sample")),
        with_reads("SELECT read_id, seq, qual, barcode, sample FROM r1"),
    ),
    "src2_read_fasta": (
        lambda s, d: _fasta(s, d).select(
            "read_id", "seq", fx.text(F.col("BARCODE")).alias("barcode")),
        with_reads("SELECT read_id, seq, barcode FROM r1"),
    ),
    "src3_parse_header": (
        lambda s, d: text.parse_header(_header_text(headers.merge_fields(
            r1(s, d), ["SAMPLE", "PRIMER"], "BOTH")), ["BOTH", "BARCODE", "ABSENT"]).select(
            "read_id", fx.text(F.col("BOTH")).alias("both_fields"),
            fx.text(F.col("BARCODE")).alias("barcode"), fx.text(F.col("ABSENT")).alias("absent")),
        with_reads("SELECT read_id, concat(sample, ',', primer) AS both_fields, barcode, "
                   "CAST(NULL AS VARCHAR) AS absent FROM r1"),
    ),
    "src4_profile_fields": (
        lambda s, d: text.profile_fields(_header_text(r1(s, d))),
        with_reads("SELECT field, count(*) AS records FROM r1, "
                   "(SELECT unnest(['BARCODE', 'SAMPLE', 'PRIMER']) AS field) f GROUP BY field"),
    ),
    "src9_read_primers": (
        _primers,
        "SELECT n_name AS name, translate(substr(md5(n_name), 1, 20), '0123456789abcdef', "
        "'ACGTACGTACGTACGT') AS bases FROM nation",
    ),
    "src10_read_offsets": (
        _offsets, "SELECT n_name AS primer, n_regionkey AS \"offset\" FROM nation"),
    "src11_read_values": (
        _values, with_reads('SELECT barcode AS "BARCODE" FROM r2')),
    "src12_extract_10x_tags": (
        lambda s, d: text.extract_10x_tags(r1(s, d), r2(s, d), "v2").select(
            "read_id", "seq", fx.text(F.col("BARCODE")).alias("barcode"),
            fx.text(F.col("UMI")).alias("umi")),
        with_reads(MATES + "\nSELECT read_id, s2 AS seq, substr(s1, 1, 16) AS barcode, "
                   "substr(s1, 17, 10) AS umi FROM mates"),
    ),
    "src13_whitelist": (
        lambda s, d: text.whitelist(r1(s, d), r2(s, d).filter("seq_no % 11 = 0").select(
            F.element_at("BARCODE", 1).alias("b"))).select("read_id", "seq"),
        with_reads("""
, m AS (SELECT *, bool_or(mate = 2 AND seq_no % 11 = 0) OVER (PARTITION BY barcode) AS listed FROM reads)
SELECT read_id, seq FROM m WHERE mate = 1 AND listed"""),
    ),
    "src14_split_tags": (
        lambda s, d: text.split_tags(_tagged(s, d)).select(
            "read_id", "seq", fx.text(F.col("BARCODE")).alias("barcode"),
            fx.text(F.col("UMI")).alias("umi")),
        with_reads("SELECT read_id, seq, barcode, CASE WHEN seq_no % 3 = 0 THEN 'N' "
                   "ELSE left(barcode, 8) END AS umi FROM r2 WHERE seq_no % 5 > 1"),
    ),
    "src14_tag_counts": (
        lambda s, d: text.tag_counts(_tagged(s, d)),
        with_reads("SELECT count(*) AS reads, count(*) FILTER (seq_no % 5 > 1) AS reads_with_barcode, "
                   "count(*) FILTER (seq_no % 5 > 1 AND seq_no % 3 <> 0) AS reads_with_umi FROM r2"),
    ),
    "snk1_fastq_text": (
        lambda s, d: r1(s, d).select(sinks.fastq_text(r1(s, d)).alias("record")),
        with_reads("SELECT concat('@', read_id, '|BARCODE=', barcode, '|SAMPLE=', sample, '|PRIMER=', "
                   "primer, chr(10), seq, chr(10), '+', chr(10), qual) AS record FROM r1"),
    ),
    "snk2_final_fasta": (
        lambda s, d: _final(s, d).select(sinks.final_fasta_text().alias("record")),
        "WITH f AS (SELECT concat('F', g) AS name, translate(concat(md5(concat('f', g)), "
        "md5(concat('g', g))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s "
        "FROM (SELECT DISTINCT CAST(l_orderkey % 4999 AS VARCHAR) AS g FROM lineitem) d) "
        "SELECT concat('>', name, chr(10), substr(concat(s, s, s), 1, 70), chr(10), "
        "substr(concat(s, s, s), 71, 70), chr(10), substr(concat(s, s, s), 141)) AS record FROM f",
    ),
    "snk2_final_fasta_round_trip": (
        _final_round,
        "SELECT concat('F', g) AS sequence_id, repeat(translate(concat(md5(concat('f', g)), "
        "md5(concat('g', g))), '0123456789abcdef', 'ACGTACGTACGTACGT'), 3) AS sequence "
        "FROM (SELECT DISTINCT CAST(l_orderkey % 4999 AS VARCHAR) AS g FROM lineitem) d",
    ),
    "snk5_header_table": (
        _written_table,
        with_reads('SELECT read_id AS "ID", primer AS "PRIMER", barcode AS "BARCODE" FROM r1'),
    ),
    "snk6_error_text": (
        lambda s, d: sinks.error_text(errors.error_profile(r1(s, d), min_count=5)["position"]).select(
            "position", "mismatch", "total", "error"),
        POSITION_TEXT,
    ),
    "snk7_write_parts": (
        _parts, with_reads("SELECT read_id, seq, primer AS part FROM r1")),
    "snk8_to_fasta": (
        lambda s, d: sinks.to_fasta(r1(s, d)).select(
            "read_id", "seq", F.col("qual").isNull().alias("no_quality")),
        with_reads("SELECT read_id, seq, TRUE AS no_quality FROM r1"),
    ),
    "snk9_table_fingerprint": (
        lambda s, d: sinks.table_fingerprint(_plain(s, d)),
        _fingerprint_sql("bucket, n_rows, sha256"),
    ),
    "snk9_whole_fingerprint": (
        lambda s, d: sinks.whole_fingerprint(sinks.table_fingerprint(_plain(s, d))),
        _fingerprint_sql("CAST(sum(n_rows) AS BIGINT) AS n_rows, "
                         "sha256(string_agg(concat(bucket, sha256), ',' ORDER BY bucket)) AS sha256"),
    ),
    "src4_profile_summary": (
        lambda s, d: text.profile_summary(_header_text(r1(s, d).where("seq LIKE 'A%'")).unionByName(
            r1(s, d).where("seq NOT LIKE 'A%'").select("seq", F.col("read_id").alias("header")))),
        with_reads("SELECT count(*) AS records, count(*) FILTER (seq LIKE 'A%') AS with_fields, "
                   "bool_or(seq LIKE 'A%') AS parsed FROM r1"),
    ),
    "snk9_fingerprint": (
        lambda s, d: sinks.fingerprint(s, [f"{_local(d)}/{t}.parquet" for t in (
            "lineitem", "orders", "customer")]),
        None,
    ),
}
