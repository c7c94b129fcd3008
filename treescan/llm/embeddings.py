"""Links among vectors of high cosine by spherical-cap filters.

Vectors are rotated at random and halved; a filter is a pair of codewords, one of each half's
random code, and a vector passes those whose inner product exceeds a threshold. List decoding
finds them all from the two halves' products, without walking the product code. Vectors that
share a filter are compared by their exact cosines.

The code grows with the number of vectors, so a filter holds a few unrelated ones at most. A pair
is counted in the smallest filter it shares, found from the vectors' lists, so nothing is
emitted for pairs: a comparison gives each vector its number of links and one edge of a
spanning star. A filter with many vectors is cut into blocks, and pairs of blocks are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cache, components, mapped, width, written

#: Expected filters of a vector, over all rotations; vectors of a block; unrelated vectors in a filter.
FILTERS, ROTATIONS, BLOCK, LOAD = 72, 4, 512, 0.25
#: Codes that a worker keeps.
KEPT = 8


_codes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = cache("embeddings")


def codes(dim: int, size: int, rotation: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, and unit codewords of both halves; a task keeps those of its vectors."""
    if (key := (dim, size, rotation)) not in _codes:
        if len(_codes) >= KEPT:
            _codes.clear()
        _codes[key] = _made(dim, size, rotation)
    return _codes[key]


def _made(dim: int, size: int, rotation: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, size, rotation])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = (dim + 1) // 2
    words = [rng.standard_normal((size, n)) for n in (half, dim - half)]
    return turn, *[w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12) for w in words]


def threshold(dim: int, size: int, rotation: int, wanted: float) -> float:
    """The inner product that a random vector exceeds for `wanted` filters on average, by simulation."""
    turn, a, b = codes(dim, size, rotation)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((64, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x @ turn
    s, t = np.sort(x[:, : a.shape[1]] @ a.T, 1), np.sort(x[:, a.shape[1] :] @ b.T, 1) if b.shape[1] else np.zeros((64, size))
    low, high = -2.0, 2.0
    for _ in range(40):
        mid = (low + high) / 2
        n = np.mean([(size - np.searchsorted(t[i], mid - s[i][-2000:], side="right")).sum() for i in range(64)])
        low, high = (mid, high) if n > wanted else (low, mid)
    return (low + high) / 2


def decode(x: np.ndarray, size: int, rotation: int, limit: float) -> list[np.ndarray]:
    """For each unit row of `x` all filters above the limit."""
    turn, a, b = codes(x.shape[1], size, rotation)
    y = x @ turn
    s, t = y[:, : a.shape[1]] @ a.T, y[:, a.shape[1] :] @ b.T
    out = []
    for u, v in zip(s, t, strict=True):
        i, j = np.flatnonzero(u > limit - v.max()), np.flatnonzero(v > limit - u.max())
        p, q = np.nonzero(u[i][:, None] + v[j][None] > limit)
        out.append((rotation * size + i[p]) * size + j[q])
    return out


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def compare(x: np.ndarray, lists: list[np.ndarray], filter_id: int, block: np.ndarray, pair: tuple[int, int], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that share a filter: who is linked and counted here, and who is linked at all.

    With two blocks only pairs across them are looked at. A pair counts here if it shares no
    smaller filter.
    """
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if pair[0] != pair[1]:
        near &= block[:, None] != block[None]
    counted = near
    if near.any():
        busy = np.flatnonzero(near.any(1))
        earlier = [lists[i][lists[i] < filter_id] for i in busy]
        names = np.unique(np.concatenate(earlier))
        if len(names):
            has = np.zeros((len(busy), len(names)), np.float32)
            for row, own in zip(has, earlier, strict=True):
                row[np.searchsorted(names, own)] = 1
            counted = near.copy()
            counted[np.ix_(busy, busy)] &= (has @ has.T) == 0
    return counted, near


def roots(near: np.ndarray) -> np.ndarray:
    """The first row that each row is connected to."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None], len(near)).min(1, initial=len(near))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    vectors: an integer id and an array of numbers. Null and zero vectors, and those with null
    or non-finite components, link with nothing; vectors link only with such of their own length. Equal
    vectors are compared once and counted as often as they occur. A null id counts as a link of
    others, but is no component's name unless its copies' ids are null too; such rows aren't kept.
    Ids that repeat are rows of their own with one name. Other columns are ignored.
    """
    spark = vectors.sparkSession
    vec = F.col(column).cast("array<double>")
    ok = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(ok, F.col(column)).alias("vec"))
    rows = rows.withColumn("h", F.xxhash64("vec"))
    nodes = rows.where("vec is not null").groupBy("h", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "vec_id", "copies", "h", "vec"))
    shape = nodes.groupBy(F.size("vec").alias("d")).count().collect()  # a row for each length that occurs
    plan = {}
    for r in shape:
        size = 1 << max(4, int(np.ceil(np.log2(max(2, r["count"]) * FILTERS / ROTATIONS / LOAD) / 2)))
        plan[r["d"]] = (size, [threshold(r["d"], size, k, FILTERS / ROTATIONS) for k in range(ROTATIONS)])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                names, vecs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                dims = np.array([len(v) for v in vecs])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = unit(np.array([vecs[i] for i in at], np.float64))
                    size, limits = plan[int(d)]
                    for k, limit in enumerate(limits):
                        found = decode(x, size, k, limit)
                        n = [len(f) for f in found]
                        cols = [np.full(sum(n), d, np.int32), np.concatenate(found), np.repeat(names[at], n)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dim", "filter", "node"])

    hits = written(mapped(nodes.select("node", "vec"), passed, "dim int, filter long, node long", "embeddings"))
    filters = written(hits.groupBy("dim", "filter").count().where(F.col("count") > 1))
    busy = hits.join(filters, ["dim", "filter"])
    # a node's list is bounded by what its vector passes
    lists = busy.groupBy("node", "dim").agg(F.sort_array(F.collect_list(F.struct("filter", "count"))).alias("own"))
    members = nodes.select("node", "copies", "vec").join(lists, "node")
    members = members.select("dim", "node", "copies", "vec", F.col("own.filter").alias("own"), F.explode("own").alias("f"))
    blocks = F.ceil(F.col("f.count") / BLOCK).cast("int")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    members = members.select("dim", "node", "copies", "vec", "own", F.col("f.filter").alias("filter"), "block", other.alias("other"))
    members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def finish():
            # repeats of a node can't be: a node passes a filter once
            names = np.array([g[0] for g in group])
            if len(names) < 2:
                return None
            x = unit(np.array([g[2] for g in group], np.float64))
            copies = np.array([g[1] for g in group])
            counted, near = compare(x, [np.array(g[3]) for g in group], key[1], np.array([g[4] for g in group]), key[2:], cosine)
            if not near.any():
                return None
            at = np.flatnonzero(near.any(1))
            n = counted @ copies
            cols = [names[at], n[at], names[roots(near)[at]]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "links", "root"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[:4] != key:
                    if group and (out := finish()):
                        yield out
                    key, group = row[:4], []
                group.append(row[4:])
        if group and (out := finish()):
            yield out

    sorted_ = members.repartition(width(spark), "dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j")
    found = written(mapped(sorted_.select("dim", "filter", "i", "j", "node", "copies", "vec", "own", "block"), verify, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = nodes.select("node", "vec_id", "copies", "h", "vec").join(links, "node", "left").join(joined, "node", "left")
    named = written(named.select("h", "vec", "vec_id", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    # written, so that the planner can split what many rows share
    first = written(named.groupBy("component").agg(F.min("vec_id").alias("component_id")))
    answers = written(named.join(first, "component").select("h", "vec", "n_links", "component_id"))
    linked = rows.join(answers.withColumnRenamed("vec", "same"), (rows["h"] == answers["h"]) & (F.col("vec") == F.col("same")), "left")
    component = F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
