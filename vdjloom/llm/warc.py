"""WARC archives of pages, and their index as an external merge of sorted runs.

``write_archive`` lets Spark's text sink write records (a record ends with the
sink's line separator), so tasks commit files to any store Spark can write.
``read_runs`` reads the archives back, checks every payload against its digest
and writes one sorted run of captures per archive file.  ``merge_runs`` deals
the runs' entries to key ranges and merges each range's runs with a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjloom.functions.binding import bind
from vdjloom.llm.losertree import merge
from vdjloom.llm.shared import new_path, parts, written

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"

#: Time of the capture with page_id 0; each id is a second later, and after SECONDS (of any sign) it begins again.
SECONDS = 4_000_000_000
FIRST_CAPTURE = "2020-01-01 00:00:00"
RECORDS_PER_FILE = 2_000
#: Captures that one task merges, about.
RANGE = 50_000


def _base32(hex_digest: Column) -> Column:
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """A WARC record, without its last line end, for every row of pages (page_id, url, html).

    Null html is an empty payload.  Of rows with equal payloads of ``least``
    bytes or more, those with the largest page_id are responses (all of them,
    if that row is repeated), the others revisit it; a null page_id is below
    every other, and such rows are responses if the group has nothing else.
    A null url leaves out the target; line ends in it are escaped.
    """
    base = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
                        F.coalesce("html", F.lit("")).alias("payload"))
    keyed = bind(base, {"hex": F.sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload").cast("bigint")})
    held = keyed.where(F.col("n") >= least).groupBy("hex").agg(F.max("page_id").alias("held"), F.count("*").alias("k"))
    joined = keyed.join(held.where("k > 1").drop("k"), "hex", "left")
    revisit = F.col("held").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("held")) & (F.col("n") >= least)
    at = F.date_format(
        F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST_CAPTURE).cast("timestamp_ntz").cast("timestamp"))
                            + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(_CRLF + _CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return joined.select(F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", at),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("hex")))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:x-page:"), F.col("held").cast("string"), F.lit(">")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF), block, F.lit(_CRLF)).alias("record"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``records`` to gzipped WARC files below ``folder``."""
    (records(pages, least).write.option("lineSep", _CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(folder))


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
        out[name] = value
    return out


def _page(urn: str | None) -> int | None:
    found = re.search(r"x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def url_key(url: str | None) -> str:
    """Host parts in reverse, then path and query, all in lower case; without scheme, ``www.`` and fragment."""
    parsed = re.match(r"(?s)[A-Za-z][A-Za-z0-9+.-]*://(?:www\.)?([^/?#]*)([^#]*)", url or "")
    if not parsed:
        return (url or "").lower()
    return (",".join(reversed(parsed[1].split("."))) + ")" + parsed[2]).lower()


def parse(content: bytes):
    """Captures of one gzipped WARC file: (offset, headers, payload)."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
        while True:
            offset = stream.tell()
            version = stream.readline()
            if not version:
                return
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"no record at {offset}")
            head = _headers(stream)
            size = int(head["Content-Length"])
            block = stream.read(size)
            if len(block) != size or stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"record at {offset} is cut off")
            inner = io.BytesIO(block)
            inner.readline()
            http = _headers(inner)
            yield offset, head, int(http["Content-Length"]), block[inner.tell():]


_RUN = pa.schema([("run", pa.string()), ("pos", pa.int32()), ("url_key", pa.string()), ("captured_at", pa.string()),
                  ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64())])
_RUN_TYPES = ("run string, pos int, url_key string, captured_at string, page_id bigint, payload_bytes bigint, "
              "payload_digest string, record_type string, refers_to bigint, offset bigint")


def _order(entry: dict) -> tuple:
    page = entry["page_id"]
    return entry["url_key"].encode(), entry["captured_at"], page is not None, page or 0


def read_runs(spark, folder: str) -> DataFrame:
    """Captures of every archive file below ``folder``, each file's as one sorted run (``run``, ``pos``)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                entries = []
                for offset, head, n, payload in parse(content.as_py()):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = head["WARC-Type"]
                    if kind == "response" and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"payload at {offset} of {path} differs from its digest")
                    entries.append({
                        "run": path.as_py(), "url_key": url_key(head.get("WARC-Target-URI")), "captured_at": head["WARC-Date"],
                        "page_id": _page(head["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest,
                        "record_type": kind, "refers_to": _page(head.get("WARC-Refers-To")), "offset": offset})
                entries.sort(key=_order)
                for pos, entry in enumerate(entries):
                    entry["pos"] = pos
                if entries:
                    yield from pa.Table.from_pylist(entries, schema=_RUN).to_batches()

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, _RUN_TYPES)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order of (url_key, captured_at, page_id): adds ``capture_no`` from 0.

    Runs are cut at key ranges of about RANGE captures; the cuts use the whole
    key, so many captures of one URL still spread.  A range's runs are merged
    by a loser tree; ranges follow each other, so their sizes give the numbers.
    """
    ranges = max(parts(runs.sparkSession), runs.count() // RANGE)
    dealt = runs.repartitionByRange(
        ranges, "url_key", "captured_at", F.col("page_id").asc_nulls_first()).sortWithinPartitions("run", "pos")

    def run(batches):
        table = pa.Table.from_batches(list(batches), schema=_RUN)
        by_run: dict[str, list[int]] = {}
        for i, name in enumerate(table["run"].to_pylist()):
            by_run.setdefault(name, []).append(i)
        keys = [_order(e) for e in table.select(["url_key", "captured_at", "page_id"]).to_pylist()]
        rows = list(by_run.values())
        order = [rows[r][i] for r, i in merge([[keys[i] for i in r] for r in rows])]
        if order:
            out = table.take(pa.array(order)).drop_columns(["run", "pos", "offset"])
            out = out.append_column("_range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
            out = out.append_column("_at", pa.array(range(len(order)), pa.int64()))
            yield from out.to_batches()

    merged = written(dealt.mapInArrow(
        run, "url_key string, captured_at string, page_id bigint, payload_bytes bigint, payload_digest string, "
             "record_type string, refers_to bigint, _range int, _at bigint"), "captures")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("_range").count().select(
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return merged.join(starts, "_range").withColumn("capture_no", F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")


def capture_history(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive ``pages`` (page_id, url, html), read the archives back and merge their index.

    A row per page row: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url_key, captured_at and capture_no, the capture's place in the
    global order.  Other columns are ignored; see ``records`` for nulls and ties.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archive(pages, folder, least)
    runs = written(read_runs(spark, folder), "runs")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                   "url_key", "captured_at", "capture_no")


_DIGITS = ", ".join(
    f"'{_BASE32}'[((('0x' || substr(h, {5 * i + 1}, 5))::INT >> {s}) & 31) + 1]" for i in range(8) for s in (15, 10, 5, 0))

SQL = f"""
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS held FROM p),
k AS (SELECT *, lower(CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
        THEN array_to_string(list_reverse(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www[.])?([^/?#]*)([^#]*)', 1), '.')), ',')
             || ')' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www[.])?([^/?#]*)([^#]*)', 2)
        ELSE coalesce(url, '') END) AS url_key,
      strftime(TIMESTAMP '{FIRST_CAPTURE}' + to_seconds(((coalesce(page_id, 0) % {SECONDS}) + {SECONDS}) % {SECONDS}), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, concat({_DIGITS}) AS payload_digest,
       CASE WHEN page_id = held OR held IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = held OR held IS NULL THEN NULL ELSE held END AS refers_to,
       url_key, captured_at,
       row_number() OVER (ORDER BY url_key, captured_at, page_id NULLS FIRST) - 1 AS capture_no
FROM k
"""
