"""SimHash fingerprints and the links among them by the general pigeonhole principle.

A fingerprint's bits are dealt into partitions, correlated bits together. Each fingerprint picks a threshold for
each partition (-1: skip it) by dynamic programming on the number of candidates that histograms
promise, probes the values within its thresholds, and meets the fingerprints that have them. A
bucket's members are compared as :mod:`buckets` has it, so no pairs come out, but edges.

What thresholds must add up to is told in units of gain:

* Radius: threshold t gains t + 1, and radius + 1 is needed. Then two fingerprints within the radius
  differ by at most the threshold in one partition at least: no link is lost.
* Similarity: for sets of shingles a Jaccard threshold gives the share of bits that differ, so each
  threshold has a chance to catch a pair, and gains the logarithm of its miss. What is needed is the recall's.
  A radius that catches such pairs in 64 bits would reach unrelated texts as well, so fingerprints
  have more lanes of 64 bits, and candidates are settled by the exact Jaccard similarity.

Each fingerprint's own thresholds are complete, whatever the others pick.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import acos, ceil, comb, log, log1p, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .shared import components, mapped, width, written

SEED = 42
#: Members of a block; bytes of text at a time; lanes of a fingerprint that candidates carry for a first check.
BLOCK, STEP, CHECK = 1024, 1 << 20, 5
#: The similarity of near copies: words of a shingle, Jaccard, share of the pairs at it that are found, bytes of text in a block.
SHINGLE, JACCARD, RECALL, BLOCK_BYTES = 5, 0.8, 0.98, 1 << 22
_BLANK = re.compile(rb"[\x20\t-\r]")


def pieces(text: bytes, keep: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text a stretch at a time, A-Z lower-cased; each stretch begins with so many words, up to `keep`, of the one before."""
    at, before = 0, []
    while at < len(text):
        blank = _BLANK.search(text, at + STEP)
        end = blank.start() if blank else len(text)
        words = before + text[at:end].lower().split()  # of bytes: A-Z and ASCII white space only
        at = end
        if len(words) > len(before):
            yield len(before), words
            before = words[-keep:] if keep else []


def word_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of fewer words: of the whole sequence."""
    digest, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.append(0, end[: n - shingle] + 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """:func:`word_hashes` of a text, a stretch at a time; of a text without words: nothing."""
    short: list[bytes] = []
    for _, words in pieces(text, shingle - 1):
        if len(words) < shingle:  # that may be all
            short = words
            continue
        short = []
        yield word_hashes(words, shingle)
    if short:
        yield word_hashes(short, shingle)


def majority(hashes, lanes: int = 1) -> np.ndarray:
    """Lanes of 64 bits: a bit is set if it is set in over half of the hashes. Lane 0 has the hashes as they are, the others have them mixed."""
    count, n = np.zeros((lanes, 64), np.int64), 0
    for part in hashes:
        n += len(part)
        for lane in range(lanes):
            for lo in range(0, len(part), 1 << 14):
                h = part[lo : lo + (1 << 14)]
                if lane:
                    h = (h ^ np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
                    h ^= h >> np.uint64(32)
                count[lane] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(count * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is set in over half of the hashes of the text's word shingles."""
    return int(majority(shingle_hashes(text, shingle))[0])


def stored_lanes(lanes: np.ndarray) -> bytes:
    return lanes.astype(">u8").tobytes()


def lanes_of(bits: pa.Array) -> np.ndarray:
    """Rows of lanes again, from an array of such bytes, all of one length."""
    if not len(bits):
        return np.zeros((0, 1), np.uint64)
    return np.frombuffer(b"".join(bits.to_pylist()), ">u8").reshape(len(bits), -1).astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, bits`` (8 bytes, highest first) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [stored_lanes(majority(shingle_hashes(x or b"", 3))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.selectExpr("doc_id", "cast(text as binary) text"), run, f"doc_id {kind}, bits binary")


def group_bits(together: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in `parts` groups of nearly equal size; correlated ones join the same group.

    together: 65 x 65 counts; row 64 has how often each bit is set, its last cell how many
    fingerprints there are.
    """
    n = max(1.0, together[64, 64])
    mean = together[64, :64] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((together[:64, :64] / n - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        near = corr[np.ix_(left, left)]
        own = [left[int(near.sum(1).argmax())]]
        left.remove(own[0])
        while len(own) < size:
            best = left[int(corr[np.ix_(left, own)].sum(1).argmax())]
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def gather_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)).astype(np.int64) << k
    return out


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with at most `radius` set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.int64)


def highest(parts: int, radius: int) -> int:
    """The largest threshold that is offered: one above the even deal."""
    return max(0, -(-(radius - parts + 1) // parts)) + 1


def allocate(costs: list[np.ndarray], gains: list[list[int]], need: int) -> np.ndarray:
    """For each fingerprint the cheapest thresholds whose gains come to `need`, ``n x parts``.

    costs[i][:, t + 1] and gains[i][t + 1]: of threshold t in partition i, t from -1 (free, no gain) up.
    """
    parts, n = len(costs), len(costs[0])
    best = np.full((n, need + 1), np.inf)  # by gain so far, where more than `need` counts as that
    best[:, 0] = 0
    picks, came = [], []
    for cost, gain in zip(costs, gains, strict=True):
        new, pick, prior = np.full((n, need + 1), np.inf), np.zeros((n, need + 1), np.int8), np.zeros((n, need + 1), np.int16)
        for t, g in enumerate(gain):
            total = best + cost[:, t : t + 1]
            for lo, hi, to in ((0, max(0, need - g), min(g, need)), (max(0, need - g), need + 1, None)):
                if to is not None and hi > lo:
                    better = total[:, lo:hi] < new[:, to : to + hi - lo]
                    span = slice(to, to + hi - lo)
                    new[:, span] = np.where(better, total[:, lo:hi], new[:, span])
                    pick[:, span] = np.where(better, t, pick[:, span])
                    prior[:, span] = np.where(better, np.arange(lo, hi), prior[:, span])
                elif to is None:
                    at = total[:, lo:].argmin(1)
                    least = total[np.arange(n), lo + at]
                    better = least < new[:, need]
                    new[:, need] = np.where(better, least, new[:, need])
                    pick[:, need] = np.where(better, t, pick[:, need])
                    prior[:, need] = np.where(better, lo + at, prior[:, need])
        best = new
        picks.append(pick)
        came.append(prior)
    if not np.isfinite(best[:, need]).all():
        raise ValueError("these thresholds can't gain what is needed")
    out, at = np.zeros((n, parts), np.int64), np.full(n, need)
    for i in range(parts - 1, -1, -1):
        rows = np.arange(n)
        out[:, i] = picks[i][rows, at]
        at = came[i][rows, at].astype(np.int64)
    return out - 1


def shells(table: np.ndarray, bits: int, radius: int) -> list[np.ndarray]:
    """How many of a histogram's entries lie at each distance 0..radius of each value."""
    at = np.arange(1 << bits)
    found = [table.astype(np.float64)]
    for r in range(1, radius + 1):
        found.append(sum(table[at ^ sum(1 << b for b in c)] for c in combinations(range(bits), r)).astype(np.float64))
    return found


@dataclass
class Aim:
    """What thresholds are for: parts of a lane, the highest threshold, gain of a threshold in a partition of so many bits, the gain needed."""

    parts: int
    top: int
    gain: object
    need: int
    lanes: int
    cells: int


def work(parts: int, radius: int, n: int) -> float:
    """About how much a fingerprint costs with evenly dealt thresholds: its probes, and a tenth for each candidate."""
    total, bits, cost = radius - parts + 1, 64 // parts, 0.0
    for k in range(parts):
        t = total // parts + (k < total % parts) if total >= 0 else (0 if k < parts + total else -1)
        if t >= 0:
            probes = sum(comb(bits, r) for r in range(t + 1))
            cost += probes * (1 + 0.1 * n / 2**bits)
    return cost


def within(radius: int, n: int, parts: int | None = None) -> Aim:
    """All pairs of 64-bit fingerprints within `radius` bits."""
    parts = parts or min(range(2, 7), key=lambda m: work(m, radius, n))
    return Aim(parts, highest(parts, radius), lambda bits, t: t + 1, radius + 1, 1, 16)


def differing(threshold: float) -> float:
    """The share of bits that differ between two sets of a Jaccard similarity, at most (sets of one size)."""
    return acos(2 * threshold / (1 + threshold)) / pi


def similar(threshold: float, recall: float, n: int) -> Aim:
    """Pairs of sets of at least the Jaccard `threshold`, each with the chance `recall` at the threshold."""
    flip, need = differing(threshold), -log(1 - recall)

    def caught(bits: int, t: int) -> float:
        return -log1p(-sum(comb(bits, r) * flip**r * (1 - flip) ** (bits - r) for r in range(t + 1)))

    def price(parts: int) -> float:
        bits = -(-64 // parts)
        return need / caught(bits, 0) * (1 + 0.005 * n / 2**bits)

    parts = min(range(2, 7), key=price)
    # a quarter more partitions than equal thresholds need, for thresholds to differ
    lanes = ceil(1.25 * need / caught(-(-64 // parts), 0) / parts)
    unit = caught(-(-64 // parts), 0) / 4
    return Aim(parts, 1, lambda bits, t: int(caught(bits, t) / unit) if t >= 0 else 0, ceil(need / unit), lanes, 8)


def candidates(nodes: DataFrame, aim: Aim) -> DataFrame:
    """``key, node, probe, bits, size`` (bits: the first lanes): members of buckets. Two that share a key are candidates if one of them probes it.

    nodes: ``node, size`` long, and ``bits`` of `aim.lanes` lanes.
    """
    spark, lanes, top = nodes.sparkSession, aim.lanes, aim.top
    n = nodes.count()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lanes, 65, 65))
        for batch in batches:
            fps = lanes_of(batch.column(0))
            for lo in range(0, len(fps), 4096):
                for k in range(lanes):
                    some = fps[lo : lo + 4096, k]
                    bits = np.ones((len(some), 65), np.float32)
                    bits[:, :64] = some[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
                    total[k] += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lanes)), pa.array([x.tobytes() for x in total], pa.binary())], ["lane", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for lane, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lane] = total.get(lane, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lane", "sums"])

    # a row for each task and lane, then one for each lane
    sums = nodes.select("bits").mapInArrow(together, "lane long, sums binary").repartition(min(lanes, width(spark)), "lane").mapInArrow(summed, "lane long, sums binary")
    counts = {r["lane"]: np.frombuffer(bytes(r["sums"])).reshape(65, 65) for r in sums.collect()}
    groups = [(k, g) for k in range(lanes) for g in group_bits(counts.get(k, np.zeros((65, 65))), aim.parts)]
    # histograms of at most 2**cells values each, whatever the number of rows
    subs = [(i, k, h) for i, (k, g) in enumerate(groups) for h in ([g[: len(g) // 2], g[len(g) // 2 :]] if len(g) > aim.cells else [g])]

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(h), np.int64) for _, _, h in subs]
        for batch in batches:
            fps = lanes_of(batch.column(0))
            for t, (_, k, h) in zip(total, subs, strict=True):
                t += np.bincount(gather_bits(fps[:, k], h), minlength=len(t)) if len(fps) else 0
        at = [np.flatnonzero(t) for t in total]
        cols = [np.repeat(np.arange(len(total)), [len(a) for a in at]), np.concatenate(at), np.concatenate([t[a] for t, a in zip(total, at, strict=True)])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["k", "v", "n"])

    tables = [np.zeros(1 << len(h), np.int64) for _, _, h in subs]
    for r in nodes.select("bits").mapInArrow(histograms, "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        tables[r["k"]][r["v"]] = r["n"]
    rings = spark.sparkContext.broadcast([[x.astype(np.float32) for x in shells(t, len(h), top)] for t, (_, _, h) in zip(tables, subs, strict=True)])
    parts_of = [[j for j, s in enumerate(subs) if s[0] == i] for i in range(len(groups))]
    masks = [[ball(len(g), t) for t in range(top + 1)] for _, g in groups]
    gains = [[0, *(aim.gain(len(g), t) for t in range(top + 1))] for _, g in groups]
    need, weight, check = aim.need, 0.1 if lanes == 1 else 0.005, min(lanes, CHECK)
    names = ["key", "node", "probe", "bits", "size"]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                fps, node = lanes_of(batch.column(1)), batch.column(0).to_numpy()
                short = pa.array([x[: 8 * check] for x in batch.column(1).to_pylist()], pa.binary())
                values, costs = [], []
                for i, (k, g) in enumerate(groups):
                    values.append(gather_bits(fps[:, k], g))
                    own = [[x[gather_bits(fps[:, k], subs[j][2])] for x in rings.value[j]] for j in parts_of[i]]
                    near = np.zeros((len(fps), top + 1))
                    for d in range(top + 1):  # halves of a partition as if independent
                        near[:, d] = own[0][d] if len(own) == 1 else sum(own[0][e].astype(np.float64) * own[1][d - e] for e in range(d + 1)) / max(1, n)
                    reach = weight * near.cumsum(1) + [len(m) for m in masks[i]]
                    costs.append(np.concatenate([np.zeros((len(fps), 1)), reach], axis=1))
                picked = allocate(costs, gains, need)
                for i, (_, g) in enumerate(groups):
                    base = i << max(len(x) for _, x in groups)
                    yield pa.RecordBatch.from_arrays([pa.array(values[i] + base), pa.array(node), pa.array(picked[:, i] >= 0), short, batch.column(2)], names)
                    for t in range(1, top + 1):
                        at = np.flatnonzero(picked[:, i] == t)
                        reach = masks[i][t][masks[i][t] > 0]
                        step = max(1, (1 << 16) // len(reach))
                        for first in range(0, len(at), step):
                            some = at[first : first + step]
                            own = np.repeat(some, len(reach))
                            key = (values[i][some, None] ^ reach).ravel() + base
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[own]), pa.array(np.ones(len(key), bool)), short.take(pa.array(own)), batch.column(2).take(pa.array(own))], names)

    rows = nodes.select("node", "bits", "size").repartition(width(spark))  # few bytes, much work
    return mapped(rows, members, "key long, node long, probe boolean, bits binary, size long")


def near_bits(radius: int, ratio: float = 0.0):
    """For buckets: columns of probes, lanes and sizes."""

    def prepare(columns: list) -> list:
        return [columns[0].to_numpy(zero_copy_only=False), lanes_of(columns[1]), columns[2].to_numpy()]

    def near(columns: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        probe, lanes, size = columns
        out = (probe[i] | probe[j]) & (np.minimum(size[i], size[j]) >= ratio * np.maximum(size[i], size[j]))
        at = np.flatnonzero(out)
        out[at] = np.bitwise_count(lanes[i[at]] ^ lanes[j[at]]).sum(1) <= radius
        return out

    return near, prepare


def links(nodes: DataFrame, radius: int = 2, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """``src, dst``: edges that connect the nodes whose 64-bit fingerprints differ by at most `radius` bits, as all such links would.

    nodes: ``node`` long, and ``bits``, all different.
    """
    near, prepare = near_bits(radius)
    rows = written(candidates(nodes.withColumn("size", F.lit(0).cast("long")), within(radius, nodes.count(), parts)))
    return buckets.links(rows, ["probe", "bits", "size"], near, prepare, block, small=32, step=64)


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint`` (16 lowercase hex digits)``, component_id`` for each row.

    component_id: the smallest doc_id reachable by links of at most `radius` differing bits, the
    row's own included. Null texts are empty; empty texts have fingerprint zero and link like any
    other. A null doc_id is never a component_id unless all that it is linked with have none.
    Repeated rows get the same answer each. Very long texts are read a stretch at a time. An empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    rows = written(fingerprints(docs))
    nodes = rows.groupBy("bits").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    roots = written(grouped(nodes, links(nodes.select("node", "bits"), radius)).select("bits", "component_id"))
    return rows.join(roots, "bits", "left").select("doc_id", F.lower(F.hex("bits")).alias("fingerprint"), "component_id")


def grouped(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` (``node, rep`` and others) with ``component_id``, the smallest rep that edges (``src, dst``) connect them to."""
    named = written(nodes.join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = written(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    return named.join(least, "component")


def normal(text: bytes | None) -> bytes:
    """The words of a text, A-Z lower-cased, with single spaces between."""
    return b" ".join(b" ".join(words) for _, words in pieces(text or b""))


def shingle_set(words: bytes, size: int = SHINGLE) -> np.ndarray:
    """The different shingles of a text by their XXH64, in order; a text with fewer words is one shingle."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(words, size)]))


def near_copies(docs: DataFrame, threshold: float = JACCARD, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, component_id`` for each row: the smallest doc_id reachable by links of at least the Jaccard `threshold` on word shingles.

    Fingerprints of a text's different shingles find candidates, each pair at the threshold with the chance `recall`; the exact
    similarity settles them. Null texts are empty, and empty texts are copies of each other. A text of fewer
    words than a shingle has is one shingle. A null doc_id is never a component_id unless all rows of its group have none. Texts
    of the same words are copies, repeated rows too. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    aim = similar(threshold, recall, docs.select("doc_id").count())
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("row_key"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bits, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                words = normal(text)
                names.append(hashlib.blake2b(words, digest_size=16).digest())
                own = shingle_set(words, shingle)
                sizes.append(len(own))
                bits.append(stored_lanes(majority([own], aim.lanes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.binary()), pa.array(bits, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "row_key", "name", "bits", "size"])

    signs = written(mapped(texts, signed, f"doc_id {kind}, row_key long, name binary, bits binary, size long"))
    nodes = signs.groupBy("name").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key"), F.first("bits").alias("bits"), F.first("size").alias("size"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    # what differs by far more bits or in size than such pairs do isn't compared: 3.5 standard deviations beyond the mean
    size, flip = 64 * min(aim.lanes, CHECK), differing(threshold)
    near, prepare = near_bits(ceil(size * flip + 3.5 * (size * flip * (1 - flip)) ** 0.5), threshold)
    rows = written(candidates(nodes.select("node", "bits", "size"), aim))
    loose = components(buckets.links(rows, ["probe", "bits", "size"], near, prepare, BLOCK, small=32, step=64))
    members = written(loose.join(nodes.select("node", "name", "row_key"), "node").select(F.col("component").alias("key"), "node", "name", "row_key"))

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [normal(x) for x in batch.column(3).to_pylist()]
            own = pa.array([hashlib.blake2b(w, digest_size=16).digest() == n for w, n in zip(words, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], ["key", "node", "words"]).filter(own)

    # one row of each node's words; the name settles what a hash of doc_id and text leaves open
    found = texts.select("row_key", "text").join(members, "row_key").select("key", "node", "name", "text")
    found = written(mapped(found, worded, "key long, node long, words binary").dropDuplicates(["node"]))
    blocks = F.ceil(F.greatest(F.count("*") / buckets.TEXTS, F.sum(F.length("words")) / BLOCK_BYTES))
    sets = lambda columns: buckets.numbered([shingle_set(w, shingle) for w in columns[0].to_pylist()])
    edges = buckets.links(found, ["words"], buckets.jaccard(threshold), sets, buckets.TEXTS, blocks)
    answers = written(grouped(nodes.select("node", "name", "rep"), edges).select("name", "component_id"))
    return signs.join(answers, "name", "left").select("doc_id", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """Of each group of near copies (:func:`near_copies`) the row with the smallest doc_id, with the columns of `docs`.

    Of rows with that doc_id the one with the smallest text stays (one of repeated rows). Rows with a null
    doc_id stay, and so does the column's names and order, whatever they are. An empty table gives no rows.
    """
    return first_of_each(docs, near_copies(docs, **options))


def first_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id has a smaller component_id in `grouped` (``doc_id, component_id``), one row for each doc_id."""
    found = grouped.select("doc_id", "component_id").distinct()
    gone = written(found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id != c").select("doc_id"))
    rest = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # ids of what is left repeat only where a row's id does
    repeats = written(rest.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if not repeats.take(1):
        return rest
    own = rest.join(repeats, "doc_id", "left_semi").select(*rest.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # as JSON any column can be ordered, a map too
    first = own.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), F.col("text"), F.to_json(row))).alias("first"))
    return rest.join(repeats, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(first.select("first.*"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
