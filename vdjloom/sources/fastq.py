"""FASTQ as a Spark data source: byte ranges in parallel, Arrow batches out.

A range owns the records that start in it.  Its reader finds the first record
start by the FASTQ layout itself: a line opening with ``@`` whose second line
after it opens with ``+`` and whose sequence and quality have one length.  A
quality line may open with ``@`` too, but the second line after it is a
sequence, which never opens with ``+``.  A gzip file of blocks (each a member
that states its size) is split at blocks: a range owns the records that start
after its first block's first byte, up to the first byte of the next range's.
Any other gzip file cannot be split and is one range.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from vdjloom.sources.blocks import BlockStream, is_blocked
from vdjloom.sources.text import parse_header

NAME = "fastq_reads"
SPLIT_BYTES = 64 << 20
GZIP_SPLIT_BYTES = 16 << 20
FILE_BITS = 44  # of seq_no, for the place in a file
RATIO = 1032    # no compressed byte stands for more
LEAST_RECORD = 6  # bytes: four lines, one of them with @, one with +
READ_BYTES = 8 << 20
MOST_RANGES = 1000  # of one read; larger inputs are cut into longer ranges, each costs a task
_SCHEMA = "header string, seq string, qual array<tinyint>, seq_no bigint"
_ARROW = pa.schema([
    ("header", pa.string()), ("seq", pa.string()), ("qual", pa.list_(pa.int8())),
    ("seq_no", pa.int64())])


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files named by a path, folder or list."""
    found = []
    for part in path.split(","):
        system, inner = _open(part.strip())
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            listed = system.get_file_info(fs.FileSelector(inner))
            names = sorted(
                (f.path, f.size) for f in listed
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
            scheme = part.strip()[:-len(inner)] if part.strip().endswith(inner) else ""
            found += [(scheme + p, size) for p, size in names]
        elif info.type == fs.FileType.File:
            found.append((part.strip(), info.size))
        else:
            raise FileNotFoundError(part)
    return found


def _blocked(path: str) -> bool:
    system, inner = _open(path)
    with system.open_input_file(inner) as source:
        return is_blocked(source.read(1 << 12))


class FastqRange(InputPartition):
    def __init__(self, path: str, number: int, begin: int, end: int | None):
        self.path, self.number, self.begin, self.end = path, number, begin, end


class BlockRange(FastqRange):
    """A range of compressed bytes."""


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.gzip_split = min(self.split, GZIP_SPLIT_BYTES)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        files = _files(self.path)
        least = -(-sum(size for _, size in files) // MOST_RANGES)
        split, gzip_split = max(self.split, min(least, SPLIT_BYTES)), max(self.gzip_split, min(least, GZIP_SPLIT_BYTES))
        for number, (path, size) in enumerate(files):
            if path.endswith(".gz") and _blocked(path):
                if size * RATIO // LEAST_RECORD >> FILE_BITS:
                    raise ValueError(f"{path} is too large for row numbers; split the file")
                out += [BlockRange(path, number, b, min(b + gzip_split, size))
                        for b in range(0, size, gzip_split)]
            elif path.endswith(".gz"):
                out.append(FastqRange(path, number, 0, None))
            else:
                out += [FastqRange(path, number, b, min(b + split, size))
                        for b in range(0, max(size, 1), split)]
        return out

    def read(self, partition: FastqRange) -> Iterator[pa.RecordBatch]:
        system, inner = _open(partition.path)
        base = partition.number << FILE_BITS
        if isinstance(partition, BlockRange):
            with system.open_input_file(inner) as source:
                stream = BlockStream(source, partition.begin, partition.end)
                if stream.start is None:
                    return
                # Numbers from the compressed place: RATIO keeps ranges apart, a record's length its neighbours.
                ahead = stream.start * RATIO
                for batch in _batches(stream.read, 0, stream.limit, 0, partition.begin == 0):
                    number = (batch.column(3).to_numpy() + ahead) // LEAST_RECORD + base
                    yield batch.set_column(3, "seq_no", pa.array(number))
        elif partition.end is None:
            with system.open_input_stream(inner, compression=None) as raw:
                with gzip.GzipFile(fileobj=raw) as stream:
                    yield from _batches(stream.read, 0, None, base, True)
        else:
            with system.open_input_file(inner) as source:
                # One byte ahead shows whether the range opens on a new line.
                ahead = 1 if partition.begin else 0
                source.seek(partition.begin - ahead)
                yield from _batches(
                    source.read, partition.begin - ahead, partition.end, base, ahead == 0)


def _first_record(data: bytes, at: int, whole: bool) -> int:
    """Offset of the first record start at or after ``at`` (a line start), -1
    when more data is needed, ``len(data)`` when there is none."""
    lines, starts = [], []
    here = at
    while here < len(data) and len(lines) < 8:
        stop = data.find(b"\n", here)
        if stop < 0:
            if not whole:
                break
            stop = len(data)
        lines.append(data[here:stop].rstrip(b"\r"))
        starts.append(here)
        here = stop + 1
    for i in range(4):
        if i + 3 < len(lines):
            if (lines[i][:1] == b"@" and lines[i + 2][:1] == b"+"
                    and len(lines[i + 1]) == len(lines[i + 3])):
                return starts[i]
        elif not whole:
            return -1
    return len(data)


def _batches(read, offset: int, stop, base: int, synced: bool) -> Iterator[pa.RecordBatch]:
    """Parse from ``offset``; records starting at or after the end are not ours.

    ``stop`` is the end, None, or a function that knows the end once it is read.
    Unless ``synced``, parsing starts at the first record after a line break.
    """
    data = b""
    while True:
        piece = read(READ_BYTES)
        last = not piece
        data += piece
        end = stop() if callable(stop) else stop
        if not synced:
            line = data.find(b"\n")
            start = _first_record(data, line + 1, last) if line >= 0 else -1
            if start < 0:
                if last:
                    return
                continue
            data, offset, synced = data[start:], offset + start, True
        if end is not None and offset >= end:
            return
        batch, used, done = _parse(data, offset, end, last, base)
        if batch is not None and batch.num_rows:
            yield batch
        data, offset = data[used:], offset + used
        if done or last:
            return


def _parse(data: bytes, offset: int, end: int | None, last: bool, base: int):
    """(batch, bytes used, finished) of the complete records in ``data``."""
    lines = data.split(b"\n")
    complete = len(lines) if last else len(lines) - 1
    count = complete // 4
    if last and any(x.strip() for x in lines[count * 4:]):
        raise ValueError(f"FASTQ ends inside a record, {len(data)} bytes after byte {offset}")
    lines = lines[:count * 4]
    if not count:
        return None, 0, last
    sizes = np.fromiter((len(x) + 1 for x in lines), np.int64, len(lines)).reshape(-1, 4)
    starts = offset + np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    keep = count if end is None else int(np.searchsorted(starts[:count], end, side="left"))
    done = keep < count
    used = int(starts[keep] - offset)
    own = [x.rstrip(b"\r") for x in lines[:keep * 4]]
    heads, seqs, quals = own[0::4], own[1::4], own[3::4]
    for i, head in enumerate(heads):
        if not head and not seqs[i] and not quals[i]:      # blank lines at the end
            heads, seqs, quals = heads[:i], seqs[:i], quals[:i]
            break
        if head[:1] != b"@" or len(seqs[i]) != len(quals[i]):
            raise ValueError(f"broken FASTQ record at byte {int(starts[i])}")
    rows = len(heads)
    lengths = np.fromiter((len(q) for q in quals), np.int32, rows)
    scores = np.frombuffer(b"".join(quals), np.uint8).astype(np.int16) - 33
    places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([
        pa.array([h[1:].decode() for h in heads], pa.string()),
        pa.array([s.decode() for s in seqs], pa.string()),
        pa.ListArray.from_arrays(pa.array(places), pa.array(scores.astype(np.int8))),
        pa.array(base + starts[:rows], pa.int64())], schema=_ARROW)
    return batch, min(used, len(data)), done


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark's own readers would give it."""
    if "://" in path or path.startswith("file:"):
        return path
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    return plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()


def read_fastq(spark: SparkSession, path: str, fields: list[str] | None = None,
               mate: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """FASTQ reads in the canonical schema, with the full ``header`` kept.

    ``path`` is a file, a folder or a comma-separated list; without a scheme it
    is in the cluster's default file system.  ``seq_no`` grows in file order.
    """
    spark.dataSource.register(FastqSource)
    whole = ",".join(_qualified(spark, part.strip()) for part in path.split(","))
    raw = spark.read.format(NAME).option("splitBytes", split_bytes).load(whole)
    reads = parse_header(raw, fields or [])
    if mate is not None:
        reads = reads.withColumn("mate", F.lit(mate).cast("tinyint"))
    return reads
