"""Footers of sealed slices, and byte records of older ledgers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The footer's magic number, its layout and its size; record fields of a ledger and a skip ledger.
MAGIC = 0x5042494E_464F4F54
FOOTER = "<QQII"
FOOTER_SIZE, SUMMED = 24, 16
MOST_PATH = 4096


def footer(rows: int, magic: int = MAGIC) -> bytes:
    head = struct.pack("<QQ", magic, rows)
    return head + struct.pack("<II", 0, zlib.crc32(head))


def footer_ok(content: Column) -> Column:
    """Whether the last 24 bytes are a footer: the magic number, and the CRC-32 of the first sixteen."""
    tail = F.substring(content, -FOOTER_SIZE, FOOTER_SIZE)
    magic = F.hex(F.substring(tail, 1, 8)) == F.lit(struct.pack("<Q", MAGIC).hex().upper())
    stated = _little(tail, 21)
    return magic & (F.crc32(F.substring(tail, 1, SUMMED)) == stated)


def _little(data: Column, at: int) -> Column:
    """Four bytes from place `at` (from 1) as an unsigned number, lowest first."""
    parts = [F.conv(F.hex(F.substring(data, at + k, 1)), 16, 10).cast("bigint") * (1 << 8 * k) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def record(path: str, dev: int, ino: int, mtime: int, d_type: int) -> bytes:
    """A ledger record: length of the path, path, device, inode, time, type."""
    raw = path.encode()
    return struct.pack("<Q", len(raw)) + raw + struct.pack("<QQqB", dev, ino, mtime, d_type)


def records(content: bytes, most: int = 0) -> Iterator[tuple[str, int, int, int, int]]:
    """Records up to `most` (0: all), a cut-off one or one whose path is too long."""
    at, n = 0, 0
    while at + 8 <= len(content) and (not most or n < most):
        (size,) = struct.unpack_from("<Q", content, at)
        end = at + 8 + size + 25
        if size > MOST_PATH or end > len(content):
            return
        yield (content[at + 8 : at + 8 + size].decode("utf-8", "replace"), *struct.unpack_from("<QQqB", content, at + 8 + size))
        at, n = end, n + 1


def read_slices(files: DataFrame) -> DataFrame:
    """Records of slices read as ``binaryFile``: ``slice`` (from the name), ``line``, and a ledger's columns."""
    import pyarrow as pa

    schema = "slice long, line long, path string, dev long, ino long, mtime long, d_type int"
    number = F.regexp_extract("path", r"_(\d{1,9})\.f?pbin$", 1).try_cast("long")

    def run(batches):
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) >= FOOTER_SIZE and content[-FOOTER_SIZE:-16] == struct.pack("<Q", MAGIC):
                    content = content[:-FOOTER_SIZE]
                rows = [(k, i, *r) for i, r in enumerate(records(content))]
                kinds = [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 3 + [pa.int32()]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return files.select(number.alias("slice"), "content").where("slice is not null").mapInArrow(run, schema)
