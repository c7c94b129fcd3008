"""Links within buckets: nodes that share a key are compared, and what links them comes out as edges, never as pairs.

A bucket is dealt in blocks of bounded size. First each block is compared, together with the bucket's
smallest node, so that a large group of like nodes comes out as one component. Then, where a
bucket has several blocks, only nodes of different components have still to meet: its largest component's
nodes stay in their blocks, and the others visit all blocks. So a group of like nodes costs
in proportion to its size, whatever the size, and every pair of nodes of a bucket is either
compared or known to be connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, mapped, width, written

#: Texts of a block.
TEXTS = 1024
#: near(columns, i, j): for arrays of row numbers, whether row i links with row j.
Near = Callable[[list, np.ndarray, np.ndarray], np.ndarray]
#: apart(columns, units): rows and the group each is in, in order of groups, such that rows of a unit that link share a group of that unit.
Apart = Callable[[list, np.ndarray], tuple[np.ndarray, np.ndarray]]


def connect(near: Near, columns: list, classes: np.ndarray, pivots: np.ndarray, others: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Edges that connect rows as all links between a pivot and another row would.

    Rows of one class are connected already. `step` pivots at a time meet the rows not yet connected with them.
    """
    label, edges = np.unique(classes, return_inverse=True)[1], []
    for lo in range(0, len(pivots), step):
        some = pivots[lo : lo + step]
        rest = others[label[others] != label[some[0]]] if (label[some] == label[some[0]]).all() else others
        if not len(rest):
            continue
        found = near(columns, np.repeat(some, len(rest)), np.tile(rest, len(some))).reshape(len(some), -1)
        for k in np.flatnonzero(found.any(1)).tolist():
            own = some[k]
            hit = rest[found[k]]
            hit = hit[label[hit] != label[own]]
            if len(hit):
                merged, at = np.unique(label[hit], return_index=True)
                edges += [(int(own), j) for j in hit[at].tolist()]
                label[np.isin(label, np.append(merged, label[own]))] = label[own]
    return edges


def _compared(near: Near, prepare: Callable[[list], list], small: int, step: int, apart: Apart | None) -> Callable:
    """For mapInArrow, over rows ``key, a, b, role, cls, node, payload...`` in the order of ``key, a, b``."""

    def edges_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
        key, a, b, role, cls, node = (x.to_numpy(zero_copy_only=False) for x in rows[:6])
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        size = np.diff(np.append(starts, len(key)))
        columns = prepare(rows[6:])
        unit = np.repeat(np.arange(len(starts)), size)
        met = np.repeat(np.maximum.reduceat(role, starts) > 0, size)  # units that pivots visit
        at = np.arange(len(key))
        if apart:
            at, unit = apart(columns, unit)
            role, cls, node, met = role[at], cls[at], node[at], met[at]
            starts = np.flatnonzero(np.diff(unit, prepend=-1))
            size = np.diff(np.append(starts, len(at)))
        src, dst = [], []
        short = np.repeat(size, size)
        short = (short > 1) & (short <= small)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, int(size[size <= small].max(initial=0))):
            i = np.flatnonzero(short[:-d] & (unit[:-d] == unit[d:]) & (cls[:-d] != cls[d:]) & ((role[:-d] != role[d:]) | ~met[:-d]))
            hit = i[near(columns, at[i], at[i + d])] if len(i) else i
            pairs.append((hit, hit + d))
        if pairs:
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            root: dict[int, int] = {}  # a spanning forest of what was found

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    src.append(max(x, y))
                    dst.append(min(x, y))
        for s, n in zip(starts[size > small].tolist(), size[size > small].tolist(), strict=True):
            if n < 2:
                continue
            own, all_of = role[s : s + n], np.arange(n)
            pivots, others = (all_of[own == 1], all_of[own == 0]) if met[s] else (all_of, all_of)
            shifted = connect(lambda c, i, j, s=s: near(c, at[i + s], at[j + s]), columns, cls[s : s + n], pivots, others, step)
            src += [s + x for x, _ in shifted]
            dst += [s + y for _, y in shifted]
        return node[src].astype(np.int64) if src else np.zeros(0, np.int64), node[dst].astype(np.int64) if dst else np.zeros(0, np.int64)

    def found(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for x in rows if x.num_rows]
        if rows:
            whole = pa.Table.from_batches(rows).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges_of([c.chunk(0) for c in whole.columns])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            other = np.flatnonzero(np.any([x != x[-1] for x in keys], axis=0))
            begin = int(other[-1]) + 1 if len(other) else 0  # of the unit that is still open
            ends = tuple(x[-1] for x in keys)
            if not begin and ends == last:
                held.append(batch)
                continue
            yield from found([*held, batch.slice(0, begin)])
            held, last = [batch.slice(begin)], ends
        yield from found(held)

    return run


def links(members: DataFrame, payload: list[str], near: Near, prepare: Callable[[list], list], block: int, blocks=None, small: int = 1, step: int = 1, apart: Apart | None = None) -> DataFrame:
    """``src, dst`` (long): edges that connect the nodes of each bucket as all their links would.

    members: ``key`` and ``node`` (long), each pair once, and the payload columns, which
    prepare(arrow arrays) turns into what `near` reads. blocks: of a bucket, a column over its
    aggregated rows (default: its rows over `block`). Buckets of at most `small` rows are compared
    many at a time, in others `step` rows at a time meet the rest. apart: parts buckets into groups outside of
    which nothing links, and only rows of a group are compared.
    """
    spark = members.sparkSession
    parts = width(spark)
    count = F.ceil(F.count("*") / block) if blocks is None else blocks
    large = written(members.groupBy("key").agg(count.cast("int").alias("blocks"), F.count("*").alias("n"), F.min("node").alias("first")).where("blocks > 1").select("key", "blocks", "first"))
    run = _compared(near, prepare, small, step, apart)
    row = ["key", "a", "b", "role", "cls", "node", *payload]
    zero = F.lit(0)
    several = bool(large.take(1))
    if several:
        big = written(members.join(large, "key"))
        dealt = members.join(large.select("key"), "key", "left_anti").select("key", zero.alias("a"), zero.alias("b"), zero.alias("role"), F.col("node").alias("cls"), "node", *payload)
        own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
        home = big.select("key", own.alias("a"), zero.alias("b"), zero.alias("role"), F.col("node").alias("cls"), "node", *payload)
        first = big.where("node = first").select("key", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("a"), own.alias("own"), zero.alias("b"), zero.alias("role"), F.col("node").alias("cls"), "node", *payload)
        dealt = dealt.unionByName(home).unionByName(first.where("a != own").drop("own"))
    else:
        dealt = members.select("key", zero.alias("a"), zero.alias("b"), zero.alias("role"), F.col("node").alias("cls"), "node", *payload)

    def compared(df: DataFrame) -> DataFrame:
        ordered = df.select(*row).repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
        return mapped(ordered, run, "src long, dst long")

    found = compared(dealt)
    if not several:
        return found
    found = written(found)
    known = written(components(found).withColumnRenamed("component", "cls"))
    big = written(big.join(known, "node", "left").withColumn("cls", F.coalesce("cls", "node")))
    sizes = big.groupBy("key", "cls").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "cls")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    sizes = written(sizes.select("key", F.col("top.cls").alias("most"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("visits")))
    if not sizes.take(1):
        return found
    left = written(big.join(sizes, "key"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    visit = F.pmod(F.hash("node", "key"), F.col("visits")).cast("int")
    stay = left.select("key", own.alias("a"), F.explode(F.sequence(zero, F.col("visits") - 1)).alias("b"), zero.alias("role"), "cls", "node", *payload)
    move = left.where("cls != most").select("key", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("a"), visit.alias("b"), F.lit(1).alias("role"), "cls", "node", *payload)
    return found.unionByName(compared(stay.unionByName(move)))


def numbered(sets: list[np.ndarray]) -> list:
    """What :func:`jaccard` reads: sets (arrays without repeats) with their elements numbered."""
    sizes = np.array([len(x) for x in sets], np.int64)
    names, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    return [np.split(flat, np.cumsum(sizes)[:-1]), sizes, np.zeros(len(names), bool)]


def jaccard(threshold: float) -> Near:
    """Exact Jaccard similarity of at least `threshold`, for :func:`numbered` sets that aren't empty."""

    def near(columns: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sets, sizes, mark = columns
        out = np.zeros(len(i), bool)
        like = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j])
        for k in np.unique(i[like]).tolist():
            at = np.flatnonzero(like & (i == k))
            mark[sets[k]] = True
            found = mark[np.concatenate([sets[x] for x in j[at].tolist()])]
            mark[sets[k]] = False
            ends = np.cumsum(sizes[j[at]])
            both = np.add.reduceat(found, ends - sizes[j[at]], dtype=np.int64)
            out[at] = both >= threshold * (sizes[k] + sizes[j[at]] - both)
        return out

    return near


#: Elements of pairs of small sets that are looked up at a time.
ELEMENTS = 1 << 20


def tabled(rows: np.ndarray, elements: np.ndarray, count: int) -> list:
    """What :func:`likeness` and :func:`prefixes` read, of `count` sets that aren't empty, given by their elements, repeats included."""
    names, element = np.unique(elements, return_inverse=True)
    table = np.unique(rows * len(names) + element)  # in order of sets and elements
    row = table // max(1, len(names))
    sizes = np.bincount(row, minlength=count)
    return [table, row, table - row * len(names), np.cumsum(sizes) - sizes, sizes, np.zeros(len(names), bool)]


def likeness(threshold: float) -> Near:
    """Exact Jaccard similarity of at least `threshold`, for :func:`tabled` sets; of small ones many pairs are settled at once."""

    def near(columns: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        table, _, element, first, sizes, mark = columns
        out = np.zeros(len(i), bool)
        like = np.flatnonzero(np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]))
        if not len(like):
            return out
        i, j = i[like], j[like]
        both = np.zeros(len(like), np.int64)
        if (i == i[0]).all():
            own = element[first[i[0]] : first[i[0]] + sizes[i[0]]]
            mark[own] = True
            at, starts = _elements(first[j], sizes[j])
            both[:] = np.add.reduceat(mark[element[at]], starts, dtype=np.int64)
            mark[own] = False
        else:
            chunk = np.cumsum(sizes[i]) // ELEMENTS
            for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(chunk)) + 1):
                at, starts = _elements(first[i[some]], sizes[i[some]])
                wanted = np.repeat(j[some], sizes[i[some]]) * len(mark) + element[at]
                found = table[np.minimum(np.searchsorted(table, wanted), len(table) - 1)] == wanted
                both[some] = np.add.reduceat(found, starts, dtype=np.int64)
        out[like] = both >= threshold * (sizes[i] + sizes[j] - both)
        return out

    return near


def _elements(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets' elements, one set after the other, and where each set begins there."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(int(ends[-1])), ends - sizes


def prefixes(threshold: float) -> Apart:
    """Groups of :func:`tabled` sets of a unit that share one of their rarest elements.

    With Jaccard similarity t or more two sets share t times the size of the larger one at least. So in any order of
    the elements their first common one is among the first ``size - ceil(t * size) + 1`` of both: no link is lost.
    """

    def apart(columns: list, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, row, element, first, sizes, mark = columns
        _, group, count = np.unique(unit[row] * len(mark) + element, return_inverse=True, return_counts=True)
        often = count[group]
        order = np.lexsort((element, often, row))  # the row stays the place's
        enough = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
        order = order[np.arange(len(order)) - first[row] < enough[row]]
        order = order[often[order] > 1]
        order = order[np.lexsort((row[order], group[order]))]
        return row[order], group[order]

    return apart
