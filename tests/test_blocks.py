"""Gzip files of blocks: every split finds every record once and in order."""

import random
import struct
import zlib

import pytest

from vdjloom.sources import blocks, fastq


def _member(content):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    head = blocks.MEMBER + bytes(6) + struct.pack("<H", 6) + blocks.SIZE_FIELD
    return head + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def _file(body, seed, largest=600):
    """Blocks cut anywhere, some of them empty, the last one empty."""
    draw, out, at = random.Random(seed), [], 0
    while at < len(body):
        size = draw.choice([0, 1, draw.randrange(1, largest)])
        out.append(_member(body[at:at + size]))
        at += size
    return b"".join(out) + _member(b"")


def _rows(n):
    return [(f"M@X:{i}", ("ACGT" * 8)[:5 + i % 23], ("@+I#" * 8)[i % 4:][:5 + i % 23]) for i in range(n)]


@pytest.mark.parametrize("split", [37, 700, 5000, 1 << 20])
def test_every_range_finds_its_records(tmp_path, split):
    for seed in range(12):
        rows = _rows(150)
        body = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows).encode()
        path = tmp_path / f"{split}-{seed}.fastq.gz"
        path.write_bytes(_file(body, seed))
        reader = fastq.FastqReader({"path": str(path), "splitBytes": split})
        ranges = reader.partitions()
        assert len(ranges) == -(-path.stat().st_size // split)
        got = [(n, h, s) for r in ranges for b in reader.read(r)
               for h, s, n in zip(b[0].to_pylist(), b[1].to_pylist(), b[3].to_pylist())]
        assert [(h, s) for _, h, s in got] == [(h, s) for h, s, _ in rows]
        numbers = [n for n, _, _ in got]
        assert numbers == sorted(set(numbers))


def test_breaks_at_block_borders(tmp_path):
    """Each record in a block of its own, and each line in a block of its own."""
    rows = _rows(40)
    for name, pieces in (("records", [f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows]),
                         ("lines", [x for h, s, q in rows for x in (f"@{h}\n", f"{s}\n", "+\n", f"{q}\n")])):
        path = tmp_path / f"{name}.fastq.gz"
        path.write_bytes(b"".join(_member(p.encode()) for p in pieces))
        reader = fastq.FastqReader({"path": str(path), "splitBytes": 90})
        assert [h for r in reader.partitions() for b in reader.read(r) for h in b[0].to_pylist()] == [h for h, _, _ in rows]


def test_tasks_and_broken_blocks(spark, tmp_path):
    rows = _rows(400)
    whole = _file("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows).encode(), 7)
    path = tmp_path / "a.fastq.gz"
    path.write_bytes(whole)
    df = fastq.read_fastq(spark, str(path), split_bytes=1000)
    assert df.rdd.getNumPartitions() > 5
    assert [r.header for r in df.orderBy("seq_no").select("header").collect()] == [h for h, _, _ in rows]
    (tmp_path / "b.fastq.gz").write_bytes(whole[:-40] + whole[-39:])
    with pytest.raises(Exception, match="broken block|no block"):
        fastq.read_fastq(spark, str(tmp_path / "b.fastq.gz")).collect()
