"""Packing along a space-filling curve.

A document's token ids are hashed into a signed vector, the vector is projected to a few
dimensions, and its cell's place on a Hilbert curve orders the documents. The documents are laid
end to end in that order and cut every `capacity` tokens, so neighbours on the curve share
sequences and only the last sequence has padding.

The order is a range exchange on the curve key whose low bits are a hash of the row, so many
copies of one document still spread over parts. A part's place in the whole comes from a sum per
part (as many rows as parts).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_points, mapped, part_of, width
from .tokens import default_tokenizer, id_width, tokenized

#: Hashed vector's size, dimensions of the curve, bits of each: 4 x 10 bits of a 63-bit key.
VECTOR, DIMS, BITS = 512, 4, 10


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points, rows of `cells`, each below ``2**bits``.

    Gray-code transposition: undo the reflections and rotations from the highest bit down, then
    interleave the bits of all axes.
    """
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b & 1).astype(bool)
            flip = np.where(high, low, 0)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= flip | swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fold = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        fold ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= fold
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((VECTOR, DIMS)).astype(np.float32)


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as token ids."""
    vectors = np.zeros((len(ids), VECTOR), np.float32)
    for row, one in zip(vectors, ids, strict=True):
        h = one.astype(np.uint32) * np.uint32(2654435761)
        sign = 1.0 - 2.0 * (h >> np.uint32(31))
        row[:] = np.bincount((h >> np.uint32(8)) % VECTOR, sign, VECTOR)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    flat = vectors @ _projection()  # about normal: squash, so that cells fill evenly
    cells = ((1 << BITS) / (1 + np.exp(-1.7 * flat))).astype(np.int64)
    return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of packed sequences.

    docs: needs ``doc_id, text``; other columns are ignored. Returns one row for each piece:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if `with_ids`,
    ``ids`` binary. A null text is an empty one: its piece is the end id alone. Repeated rows
    and repeated doc_ids are packed as often as they occur; a null doc_id stays null. An empty
    table gives no rows. All sequences but the last are full.
    """
    tokenizer = tokenizer or default_tokenizer()
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = id_width(tokenizer)
    table = tokenized(docs, tokenizer, end_id, lambda ids: [pa.array(curve_keys(ids))], "curve long")
    place = F.shiftleft("curve", 23).bitwiseOR(F.xxhash64("row_id").bitwiseAND(F.lit((1 << 23) - 1)))
    table = table.withColumn("place", place)
    parts = width(docs.sparkSession)
    points = cut_points(table, "place", parts)
    table = table.withColumn("part", part_of(F.col("place"), points))
    sums = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for k in sorted(sums):
        base[k], total = total, total + sums[k]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    dtype = np.dtype(f"<u{size}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out: list[tuple] = []
            for doc, part, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = base[part] if at is None else at
                ids = np.frombuffer(raw, dtype).astype("<u4")
                start = 0
                while start < len(ids):
                    n = min(len(ids) - start, capacity - at % capacity)
                    piece = ids[start : start + n].tobytes()
                    row = (doc, start, n, zlib.crc32(piece), len(ids), at // capacity, at % capacity)
                    out.append(row + (piece,) * with_ids)
                    start, at = start + n, at + n
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            arrays = [pa.array(cols[0], batch.schema.field(0).type), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.binary()) for c in cols[7:]], names)

    moved = table.select("doc_id", "part", "ids", "place", "row_id").repartitionById(len(points) + 1, F.col("part"))
    return mapped(moved.sortWithinPartitions("place", "row_id").drop("place", "row_id"), run, schema)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
