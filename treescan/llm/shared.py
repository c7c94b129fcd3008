"""What the operators share: a folder all executors see, range parts, components.

Tables go to the folder named by ``spark.checkpoint.dir``. They are written by Spark's own
committers, so a lost executor costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import ctypes
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors see."""
    return scratch_path(spark)


#: Rows of a batch that Python gets while a table is written: texts are long, and both sides hold a batch.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, and columns can be pruned."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what a Python worker has freed to the system, since workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if os.path.exists("/proc/self/maps"):  # Linux, where the C library may have it
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


#: What a worker keeps from task to task, by the operator that uses it.
_caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """A dictionary that a worker keeps while its tasks use it."""
    return _caches.setdefault(name, {})


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, uses: str = "") -> DataFrame:
    """``df.mapInArrow(run, schema)``; a task drops what other operators keep, and gives its memory back when it ends, since the worker lives on."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kept in _caches.items():
            if name != uses:
                kept.clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def width(spark: SparkSession) -> int:
    """Parts for a large exchange: the session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_points(df: DataFrame, col: str, parts: int) -> list:
    """At most ``parts - 1`` values of an orderable column that split its rows about evenly.

    The points are values that occur. Their number is bounded by `parts`, so they may be
    literals of a plan.
    """
    if parts < 2:
        return []
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(col, at, F.lit(20 * parts)).alias("p")).first()["p"]
    return sorted(set(found or []))


def part_of(col: Column, points: list, descending: bool = False) -> Column:
    """The part of `col` among ascending cut points (a point starts its part)."""
    if not points:
        return F.lit(0)
    # two levels, so that a row meets about twice the root of their number
    step = math.isqrt(len(points) - 1) + 1
    counted = (lambda p: p >= col) if descending else (lambda p: p <= col)
    ranked = points[::-1] if descending else points
    coarse = F.size(F.filter(F.array(*[F.lit(p) for p in ranked[::step]]), counted))
    fine = F.slice(F.array(*[F.lit(p) for p in ranked]), F.greatest((coarse - 1) * step + 1, F.lit(1)), F.lit(step))
    n = F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, counted)))
    return n.cast("int")


#: Edges of a part that :func:`components` contracts at once.
EDGES = 1 << 20


def contracted(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges, but the smallest of its component, and that one."""
    names, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        while True:
            up = new[new]
            if (up == new).all():
                break
            new = up
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[rest], names[label[rest]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        src, dst = contracted(*(table.column(k).to_numpy().astype(np.int64) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= EDGES:
            yield done()
            held, rows = [], 0
    if rows:
        yield done()


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node with an edge is connected to.

    edges: ``src, dst`` (long), in any direction, repeats allowed. Null nodes can't be. No edges give no rows.

    Parts of at most `EDGES` edges are contracted to stars each; where all edges are one part, that is the answer.
    Otherwise alternating large-star and small-star steps connect the parts' stars: a step rewires each
    node's neighbours to the smallest one, so chains halve and a star keeps one row for each leaf. Both steps are a
    min per node and an equi-join with it. The mins of the large step are written first, so that both sides of its join
    are plain exchanges and a node with very many neighbours is split by the adaptive planner.
    """
    e = written(edges.where(F.col("src") != F.col("dst")))
    parts = max(1, -(-e.count() // EDGES))
    e = written(mapped(e.repartition(parts), _contract, "src long, dst long"))
    seen = None
    while parts > 1:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")))
        # large star: neighbours above the node go to its smallest neighbour
        large = (
            both.where("dst > src")
            .join(low, "src")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .where("src != dst")
            .distinct()
        )
        # small star: of a node's smaller neighbours all go to the smallest
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(low, "src")
            .select(F.explode(F.array(
                F.struct(F.col("src"), F.col("low").alias("dst")),
                F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")),
            )).alias("e"))
            .select("e.*")
            .where("src != dst")
            .distinct()
        )
        e = written(small)
        state = e.agg(
            F.count("*").alias("n"),
            F.countDistinct("src").alias("k"),
            F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h"),
        ).first()
        # every node has one edge, and none points to a node that points on
        if state == seen or state["n"] == 0:
            break
        if state["n"] == state["k"] and not e.join(e.select(F.col("src").alias("dst")), "dst", "left_semi").take(1):
            break
        seen = state
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return out.unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
