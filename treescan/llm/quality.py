"""Quality of documents by gradient-boosted trees over statistics of their whole texts.

Features are binned by quantiles, trees grow level by level on histograms of gradients, and the
fitted trees are flat arrays of split features and thresholds that numpy walks for all rows of a
batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .shared import mapped, written

NAMES = (
    "bytes", "words", "word_mean", "word_spread", "upper", "lower", "digit", "space", "comma_stop", "bang", "pipe", "mark", "wide",
    "entropy", "lines", "line_mean", "line_repeats", "distinct", "top_word", "same_next", "stops", "distinct_pairs", "capital_words", "symbol_words",
)
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "comma_stop": b",.;:",
    "bang": b"!?", "pipe": b"|\\/<>[]{}", "mark": b"#$%&*@^~+=_", "wide": range(128, 256),
}
_MASKS = np.zeros((len(_GROUPS), 256))
for _k, _v in enumerate(_GROUPS.values()):
    _MASKS[_k, list(_v)] = 1
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_BLANK, _LINE = re.compile(rb"[ \t\n\x0b\x0c\r]"), re.compile(rb"\n")


#: Bytes of a text that are looked at at once; a piece ends where a word or line does.
PIECE = 1 << 18


def _pieces(text: bytes, end: re.Pattern, size: int) -> Iterator[bytes]:
    lo = 0
    while lo < len(text):
        cut = end.search(text, lo + size)
        hi = cut.end() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def _names(parts: Iterator[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all parts in their order."""
    found = [np.fromiter(map(xxh64_intdigest, part), np.uint64, len(part)) for part in parts]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _distinct(names: np.ndarray) -> tuple[int, int]:
    """How many names differ, and how often the commonest occurs."""
    if not len(names):
        return 0, 0
    s = np.sort(names)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return len(starts), int(np.diff(np.append(starts, len(s))).max())


def features(text: bytes, size: int = PIECE) -> np.ndarray:
    """The statistics `NAMES` of a whole text. Words and lines are told apart by 64-bit hashes, so that a long text
    takes some forty bytes a word and not an object each. An empty text has none of anything."""
    n = max(1, len(text))
    hist, total, squares, capital, symbol, count = np.zeros(256, np.int64), 0.0, 0.0, 0, 0, 0
    for piece in _pieces(text, _BLANK, size):
        raw = np.frombuffer(piece, np.uint8)
        hist += np.bincount(raw, minlength=256)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACES[raw], [True]]).astype(np.int8)))
        sizes, first, last = (edges[1::2] - edges[::2]).astype(np.float64), raw[edges[::2]], raw[edges[1::2] - 1]
        count += len(sizes)
        total += sizes.sum()
        squares += (sizes**2).sum()
        capital += int(((first >= 65) & (first <= 90)).sum())
        symbol += int((_MASKS[7] + _MASKS[5])[last].sum())
    w, share = max(1, count), hist / n
    words = _names(piece.split() for piece in _pieces(text, _BLANK, size))
    kinds, top = _distinct(words)
    same = int((words[1:] == words[:-1]).sum())
    pairs = _distinct(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[0]
    del words
    lines = _names([x for x in piece.split(b"\n") if x] for piece in _pieces(text, _LINE, size))
    m = max(1, len(lines))
    live = share[share > 0]
    return np.array([
        np.log1p(len(text)), np.log1p(count), total / w, max(0.0, squares / w - (total / w) ** 2) ** 0.5, *(_MASKS @ share),
        float(-(live * np.log2(live)).sum()), np.log1p(len(lines)), np.log1p(len(text) / m), 1 - _distinct(lines)[0] / m,
        kinds / w, top / w, same / w, hist[46] / w, pairs / w, capital / w, symbol / w,
    ])


class Trees:
    """Complete binary trees of one depth in flat arrays: node k has children 2k + 1 and 2k + 2.

    feature, threshold: ``trees x inner nodes`` (go right if the value is above);
    leaf: ``trees x leaves``.
    """

    def __init__(self, feature, threshold, leaf, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Logistic boosting on histograms. With no rows or one class, the score is that of the base."""
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base, inner = float(np.log(share / (1 - share))), (1 << depth) - 1
    if not len(y) or not 0 < y.mean() < 1:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], 1)  # bin b: at most cuts[b]
    margin = np.full(len(y), base)
    fs, ts, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            n, start = 1 << level, (1 << level) - 1
            at = node - start
            gain_best = np.full(n, 1e-9)
            split = np.full(n, -1)
            gt, ht = np.bincount(at, g, n), np.bincount(at, h, n)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                key = at * (len(c) + 1) + binned[:, k]
                gl = np.bincount(key, g, n * (len(c) + 1)).reshape(n, -1).cumsum(1)[:, :-1]
                hl = np.bincount(key, h, n * (len(c) + 1)).reshape(n, -1).cumsum(1)[:, :-1]
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gt**2 / (ht + ridge))[:, None]
                gain[(hl < least) | (hr < least)] = 0
                b = gain.argmax(1)
                top = gain[np.arange(n), b]
                better = top > gain_best
                gain_best[better], split[better] = top[better], b[better]
                feature[start : start + n][better] = k
                threshold[start : start + n][better] = c[b[better]]
            own = split[at]
            node = 2 * node + 1 + ((own >= 0) & (binned[np.arange(len(y)), feature[node]] > own))
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[at]
        fs.append(feature)
        ts.append(threshold)
        ls.append(leaf)
    return Trees(np.array(fs), np.array(ts), np.array(ls), base)


def held_out(col: str = "doc_id"):
    """Whether the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but its text, and ``stats``, an array of `NAMES`. Null texts count as empty."""
    keep = [c for c in docs.columns if c.lower() not in ("text", "stats")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [features(x or b"").astype(np.float32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32()))], ["given", "stats"])

    out = mapped(rows, run, f"given {rows.schema['given'].dataType.simpleString()}, stats array<float>")
    return out.select("given.*", "stats")


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Train on `labels` (``doc_id, quality``) that aren't held out, at most `max_rows` of them:
    those with the smallest hashes of doc_id. stats: ``doc_id, stats``."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows pairs of numbers at most
    got = stats.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "quality", "stats").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["stats"] for r in got], np.float32).reshape(-1, len(NAMES))
    return boost(x, np.array([r["quality"] for r in got], np.float64))


def scored(stats: DataFrame, trees: Trees, threshold: float = 0.3) -> DataFrame:
    """`stats` with ``score`` and ``predicted`` for its ``stats``, which go."""
    keep = [c for c in stats.columns if c.lower() not in ("stats", "score", "predicted")]
    rows = stats.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), "stats")
    shared = stats.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.leaf, trees.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Trees(*shared.value)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(NAMES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(x), pa.float64())], ["given", "score"])

    out = mapped(rows, run, f"given {rows.schema['given'].dataType.simpleString()}, score double")
    return out.select("given.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stats = written(measured(docs))
    out = scored(stats, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
