"""Token ids on disk: frequency-ranked, byte-aligned, variable length.

File layout, little-endian. ``TKS1``, u32 number of documents, u64 number of ids, u64 bytes of
data; then u64 doc_ids, u32 validity bytes, u32 ids of each document; then the control bytes
(two bits an id, four ids a byte, lowest first: bytes of the id less one); then the data bytes.
A file of ranks (`ranks.bin`, u32 id for each rank) belongs to a store: the commonest id has
rank 0, so common ids take one byte.

Writers put a file under a name of their own attempt, and the manifest table lists the files of
the attempts that counted, so retried or speculative tasks leave nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut_points, part_of, shared_dir, width
from .tokens import default_tokenizer, id_width, tokenized

MAGIC = b"TKS1"
HEAD = "<4sIQQ"
#: Documents and ids that are handled at a time.
DOCS, IDS = 512, 1 << 19
#: For each control byte: the lengths of its four ids.
_LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1


def _places(lens: np.ndarray) -> np.ndarray:
    """Places of documents' codes, whose first is at a multiple of four each."""
    ahead = np.cumsum(-lens % 4) + lens % 4 - np.where(lens % 4, 4, 0)
    return np.arange(int(lens.sum())) + np.repeat(ahead, lens)


def encode_all(values: np.ndarray, lens: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of documents that have `lens` of the unsigned 32-bit values each."""
    most = 4 if values.max(initial=0) > 0xFFFF else 2
    v = np.ascontiguousarray(values, f"<u{most}")
    n = np.ones(len(v), np.uint8)
    for k in range(1, most):
        n += v >= 1 << 8 * k
    widths = -(-lens // 4)
    codes = np.zeros(4 * int(widths.sum()), np.uint8)
    codes[_places(lens)] = n - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    data = v.view(np.uint8).reshape(-1, most)[np.arange(most) < n[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[np.cumsum(lens)]
    return _parted(control, np.cumsum(widths)), _parted(data, ends)


def _parted(raw: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    control, data = encode_all(values, np.array([len(values)]))
    return control[0], data[0]


def id_lengths(control: bytes, lens: np.ndarray) -> np.ndarray:
    """Bytes of each id of documents with `lens` ids; the last control byte of a document may have unused codes."""
    return _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[_places(lens)].astype(np.int64)


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: lengths by table lookup of the control bytes, then a gather per byte."""
    return gathered(id_lengths(control, np.array([count])), data)


def gathered(n: np.ndarray, data: bytes) -> np.ndarray:
    """The values of which `n` bytes each follow each other in `data`."""
    start = np.cumsum(n) - n
    raw = np.frombuffer(data, np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, int(n.max(initial=1))):
        more = np.flatnonzero(n > k)
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def groups(lens: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents that are handled together: at most `DOCS`, and `IDS` ids or one document."""
    lo, ends = 0, np.cumsum(lens)
    while lo < len(lens):
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, min(lo + DOCS, int(np.searchsorted(ends, done + IDS, "right"))))
        yield lo, hi
        lo = hi


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _clean_uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write `docs` (``doc_id`` integer, ``text``) as a store at `path`, in ascending doc_id order.

    Returns the manifest: ``part, file, n_docs, n_ids``. Null texts are empty ones (the end id
    alone). Null doc_ids come first. Rows with one doc_id keep the order of their texts' ids.
    Other columns are ignored. An empty table gives a store without files.
    """
    spark, tokenizer, path = docs.sparkSession, tokenizer or default_tokenizer(), _clean_uri(path)
    dtype = np.dtype(f"<u{id_width(tokenizer)}")
    table = tokenized(docs, tokenizer, end_id)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi in groups(batch.column(1).to_numpy()):
                one = np.bincount(np.frombuffer(b"".join(batch.column(0)[lo:hi].to_pylist()), dtype), minlength=len(total))
                one[: len(total)] += total
                total = one
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    # as many rows as the vocabulary has ids
    ranked = table.select("ids", "n_tokens").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ids = np.array([r["id"] for r in sorted(ranked, key=lambda r: (-r["n"], r["id"]))], "<u4")
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    store, at = _file_system(path)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/ranks.bin") as f:
        f.write(ids.tobytes())
    shared_rank = spark.sparkContext.broadcast(rank)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in groups(whole.column(3).to_numpy()):
                batch = whole.slice(lo, hi - lo)
                values = shared_rank.value[np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype)]
                cols = [*batch.columns[:4], *(pa.array(x, pa.binary()) for x in encode_all(values, batch.column(3).to_numpy()))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "row_id", "doc_id", "n_tokens", "control", "data"])

    points = cut_points(table, "doc_id", width(spark))
    table = table.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part_of(F.col("doc_id"), points)).cast("int"))
    moved = (
        table.select("part", "row_id", F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids")
        .mapInArrow(coded, "part int, row_id long, doc_id long, n_tokens long, control binary, data binary")
        .repartitionById(len(points) + 1, F.col("part"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "data", "row_id")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs_, lens, control, data = None, [], [], [], []
        for batch in batches:
            part = batch.column(0)[0].as_py() if part is None and batch.num_rows else part
            docs_ += batch.column(2).to_pylist()
            lens += batch.column(3).to_pylist()
            control += batch.column(4).to_pylist()
            data += batch.column(5).to_pylist()
        rows = []
        if docs_:
            fs, base = _file_system(path)
            name = f"part-{part:06d}-{uuid.uuid4().hex}.tks"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(struct.pack(HEAD, MAGIC, len(docs_), sum(lens), sum(map(len, data))))
                f.write(np.array([d or 0 for d in docs_], "<i8").tobytes())
                f.write(np.array([d is not None for d in docs_], np.uint8).tobytes())
                f.write(np.array(lens, "<u8").tobytes())
                for section in (control, data):
                    for x in section:
                        f.write(x)
            rows = [(part, name, len(docs_), sum(lens))]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "file", "n_docs", "n_ids"])

    moved.mapInArrow(write, "part int, file string, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a store: ``doc_id, start, n_tokens, ids_crc32`` and, if `with_ids`, ``ids``
    binary (little-endian unsigned 32-bit). start counts the ids of all documents before."""
    path = _clean_uri(path)
    manifest = spark.read.parquet(f"{path}/manifest")
    files = sorted(((r["part"], r["file"], r["n_ids"]) for r in manifest.collect()))  # one row for each part
    base, rows = 0, []
    for _, name, n in files:
        rows.append((name, base))
        base += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _file_system(path)
        with store.open_input_stream(f"{at}/ranks.bin") as f:
            ids = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}") as f:
                    magic, n, _, _ = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
                    if magic != MAGIC:
                        raise ValueError(f"{name} is no token file")
                    docs = np.frombuffer(f.read(8 * n), "<i8")
                    valid = np.frombuffer(f.read(n), np.uint8)
                    lens = np.frombuffer(f.read(8 * n), "<u8").astype(np.int64)
                    control_at = struct.calcsize(HEAD) + 17 * n
                    widths = -(-lens // 4)
                    data_at = control_at + int(widths.sum())
                    for lo, hi in groups(lens):
                        f.seek(control_at)
                        size = id_lengths(f.read(int(widths[lo:hi].sum())), lens[lo:hi])
                        f.seek(data_at)
                        raw = ids[gathered(size, f.read(int(size.sum())))].astype("<u4").tobytes()
                        control_at, data_at = control_at + int(widths[lo:hi].sum()), data_at + int(size.sum())
                        texts = _parted(raw, 4 * np.cumsum(lens[lo:hi]))
                        cols = [
                            pa.array(docs[lo:hi], pa.int64(), mask=valid[lo:hi] == 0),
                            pa.array(first + np.cumsum(lens[lo:hi]) - lens[lo:hi]),
                            pa.array(lens[lo:hi]),
                            pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                        ] + [pa.array(texts, pa.binary())] * with_ids
                        first += int(lens[lo:hi].sum())
                        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    frame = spark.createDataFrame(rows, "file string, base long")
    return frame.repartition(max(1, len(rows))).mapInArrow(run, schema)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path, with_ids=False)
