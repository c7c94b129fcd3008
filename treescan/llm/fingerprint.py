"""Quartile bucket digests of documents.

Byte triplets within a sliding window of five bytes are hashed into buckets and counted. The
digest holds two bits for each bucket (the quartile its count falls in), the text's length on a
log scale and the quartiles' ratios. Two digests have a difference score of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut_points, mapped, part_of, width

BUCKETS = 256
#: Offsets of the bytes that make a triplet with a window's first byte, and a factor for each.
TRIPLETS = ((1, 2, 0x9E3779B1), (1, 3, 0x85EBCA77), (2, 4, 0xC2B2AE3D))
STEP = 1 << 18
#: Difference: a bucket 0 to 3 quartiles apart scores 0, 1, 2 or 6; length and ratios at most 12 and 7 each.
_APART = np.array([0, 1, 2, 6])
LENGTH_CAP, RATIO_CAP = 12, 7


def counts(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, max(1, len(raw) - 2), STEP):
        x = raw[lo : lo + STEP + 4].astype(np.uint32)
        for i, j, factor in TRIPLETS:
            n = min(STEP, len(x) - j)
            if n > 0:
                h = (x[:n] << np.uint32(16) | x[i : i + n] << np.uint32(8) | x[j : j + n]) * np.uint32(factor)
                h ^= h >> np.uint32(15)
                total += np.bincount((h * np.uint32(0x2545F491)) >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(text: bytes) -> str:
    """Hex: one byte of length, one of two ratios, then the buckets' quartiles, four a byte."""
    total = counts(text)
    ordered = np.sort(total)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (total > q1).astype(np.uint8) + (total > q2) + (total > q3)
    body = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    size = min(255, int(round(8 * np.log2(1 + len(text)))))
    ratios = (q1 * 15 // max(1, q3)) << 4 | q2 * 15 // max(1, q3)
    return bytes([size, ratios]).hex() + body.sum(1).astype(np.uint8).tobytes().hex()


def _codes(x: np.ndarray) -> np.ndarray:
    return (x[..., None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(*x.shape[:-1], -1).astype(np.int8)


def difference(a: str, b: str) -> int:
    """From 0 for equal digests up to `MOST`."""
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    far = _APART[np.abs(_codes(x[2:]) - _codes(y[2:]))].sum()
    size = min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    ratios = sum(min(RATIO_CAP, abs(int(x[1] >> s & 15) - int(y[1] >> s & 15))) for s in (0, 4))
    return int(far) + size + ratios


MOST = 6 * BUCKETS + LENGTH_CAP + 2 * RATIO_CAP


def likeness(a: str, b: str) -> float:
    """1 for equal digests; 0 at the difference that unrelated buckets have on average or beyond.

    With independent quartiles a bucket's mean score is 1.875."""
    return max(0.0, 1.0 - difference(a, b) / (1.875 * BUCKETS))


def digests(docs: DataFrame, column: str = "text") -> DataFrame:
    """`docs` with a column ``fingerprint`` (replaced if there is one). A null text counts as empty."""
    keep = [c for c in docs.columns if c.lower() != "fingerprint"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), F.col(f"`{column}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest(x or b"") for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["given", "fingerprint"])

    out = mapped(rows, run, f"given {rows.schema['given'].dataType.simpleString()}, fingerprint string")
    return out.select("given.*", "fingerprint")


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's digest against an edited copy's and the next document's.

    docs: ``doc_id`` integer, ``text``. The next document is that with the next smaller doc_id
    (after the last one: the first), ties by text; null doc_ids come last. The edited copy has
    the last third of its code points replaced by as many first ones of the next document, or
    all of it. One exchange by doc_id range: a part's first document goes to the part before as
    well, so no task waits for another.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    points = cut_points(rows, "place", width(spark))
    top = rows.agg(F.max("place").alias("m")).first()["m"]
    points = sorted({*points, top} - {None})
    last = len(points) - 1
    part = (part_of(F.col("place"), points, descending=True) - 1) if points else F.lit(0)
    # points descend over parts: a part's first document has its point as doc_id
    starts = F.col("place").isin(points)
    before = F.when(starts, F.when(F.col("part") == 0, F.lit(last)).otherwise(F.col("part") - 1))
    both = (
        rows.withColumn("part", F.greatest(part, F.lit(0)).cast("int"))
        .withColumn("to", F.explode(F.array_compact(F.array(F.struct(F.col("part").alias("k"), F.lit(False).alias("tail")), F.when(before.isNotNull(), F.struct(before.alias("k"), F.lit(True).alias("tail")))))))
        .select("doc_id", "place", "text", F.col("to.k").alias("k"), F.col("to.tail").alias("tail"))
        .repartitionById(max(1, last + 1), F.col("k"))
        .sortWithinPartitions("tail", F.col("place").desc(), "text")
        .select("doc_id", F.col("text"), "tail")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, done = None, False
        for batch in batches:
            out = []
            for doc, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = digest(text.encode())
                if prev is not None and not done:
                    was, old, mark = prev
                    k = len(old) // 3
                    edited = (old[: len(old) - k] + text[:k]).encode()
                    changed = digest(edited)
                    out.append((was, len(old), hashlib.sha256(edited).hexdigest(), mark, changed, likeness(mark, changed), likeness(mark, own)))
                done = done or tail
                prev = (doc, text, own)
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return mapped(both, run, schema)


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
