"""Toxicity by subword embeddings.

A word's subwords are its byte n-grams of 3 to 6 bytes with the white space beside it, hashed into
buckets. Each bucket has an embedding; a document's embeddings are averaged into a linear
softmax, and embeddings and softmax are trained together (Adam, numpy). A misspelt or inflected
word shares most n-grams with the words seen, so it scores like them. The average has `SMOOTH` zero
vectors besides, so that a few n-grams of a short text don't decide alone.

Training takes a bounded sample of labelled documents and runs in one task of an executor; the
driver gets the model.

A document's score needs only each bucket's product with the softmax, a table of one number a
bucket, so scoring is a sum over the whole text's n-grams. The table is what executors get.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, mapped

NGRAMS, BUCKET_BITS, DIM, SMOOTH = (3, 4, 5, 6), 17, 16, 400
STEP = 1 << 17
_SPACE = bytes(range(9, 14))
_FLAT = bytes.maketrans(_SPACE, b" " * len(_SPACE))


def subwords(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, repeats included, a stretch of text at a time."""
    raw = np.frombuffer(b" " + text.lower().translate(_FLAT) + b" ", np.uint8)
    most = NGRAMS[-1]
    for lo in range(0, len(raw), STEP):
        x = raw[lo : lo + STEP + most - 1].astype(np.uint32)
        space = np.concatenate([[0], np.cumsum(x == 32)])
        n0 = min(STEP, len(x))
        h = x * np.uint32(16777619)
        for n in range(2, most + 1):
            m = min(n0, len(x) - n + 1)
            if m <= 0:
                break
            h = (h[:m] ^ x[n - 1 : n - 1 + m]) * np.uint32(16777619)
            if n in NGRAMS:  # white space only at the ends
                g = h[space[n - 1 : n - 1 + m] == space[1 : 1 + m]] + np.uint32(n)
                g ^= g >> np.uint32(15)
                yield (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and the weight of each in the average."""
    parts = list(subwords(text))
    ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint32), np.zeros(0))
    return ids.astype(np.uint32), (n / (n.sum() + SMOOTH)).astype(np.float32)


class Model:
    """table: a number for each bucket; bias. ``score = sigmoid(average of the table over n-grams + bias)``."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def score(self, text: bytes) -> float:
        total = n = 0.0
        for part in subwords(text):
            total += float(self.table[part].sum(dtype=np.float64))
            n += len(part)
        z = total / (n + SMOOTH) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def calibrated(z: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Slope and offset by which margins of rows not trained on fit their labels; few rows stay near 1 and 0."""
    t = np.array([1.0, 0.0])
    x = np.stack([z, np.ones(len(z))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -50, 50)))
        grad = x.T @ (p - y) + ridge * (t - [1, 0])
        t = t - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), grad)
        t = np.clip(t, [0.2, -5], [1.5, 5])
    return float(t[0]), float(t[1])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, epochs: int = 10, batch: int = 128, steps: int = 50, rate: float = 0.02, seed: int = 11) -> Model:
    """Fit on bags of subwords; `prior` is the share of label 1 where the model will be used.

    Few rows get more epochs, up to `steps` batches. A tenth of the rows chooses the epoch and a slope and
    an offset of the margins, and training ends when three epochs brought nothing better. With one class
    only, the score is the prior.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    rest = np.log(prior / (1 - prior))
    if len(bags) < 10 or not 0 < labels.mean() < 1:
        return Model(np.zeros(1 << BUCKET_BITS), rest)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    held, rows = order[: len(order) // 10], order[len(order) // 10 :]
    size = 1 << BUCKET_BITS
    emb = np.zeros((size, DIM), np.float32)
    share = labels[rows].mean().clip(1e-3, 1 - 1e-3)
    own = np.log(share / (1 - share))
    soft, bias = (rng.standard_normal((2, DIM)) / DIM).astype(np.float32), np.array([-own / 2, own / 2], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, bias)]
    shift = rest - own  # from the sample's share to the true one

    def gathered(picks):
        ids = np.concatenate([bags[i][0] for i in picks])
        w = np.concatenate([bags[i][1] for i in picks])
        doc = np.repeat(np.arange(len(picks)), [len(bags[i][0]) for i in picks])
        return ids, w, doc

    def margins(table, b):
        ids, w, doc = gathered(held)
        return np.bincount(doc, w * table[ids], len(held)) + b

    def loss(z):
        return np.mean(np.logaddexp(0, np.where(labels[held] == 1, -z, z)))

    best, step, worse = (np.inf, None), 0, 0
    for _ in range(max(epochs, -(-steps // -(-len(rows) // batch)))):
        order = rng.permutation(rows)
        for lo in range(0, len(order), batch):
            picks = order[lo : lo + batch]
            ids, w, doc = gathered(picks)
            w = w * ((rng.random(len(w)) < 0.5) * np.float32(2))  # half of the n-grams at a time, so that all come to tell
            parts = emb[ids] * w[:, None]
            edges = np.flatnonzero(np.diff(doc, prepend=-1))
            mean = np.zeros((len(picks), DIM), np.float32)
            mean[doc[edges]] = np.add.reduceat(parts, edges, axis=0) if len(edges) else 0
            z = mean @ soft.T + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(picks)), labels[picks]] -= 1
            p /= len(picks)
            # both classes' errors are opposite: one sum over n-grams gives the embeddings' gradient
            pull = np.bincount(ids, w * p[doc, 1], size).astype(np.float32)
            grads = (pull[:, None] * (soft[1] - soft[0])[None], p.T @ mean, p.sum(0))
            step += 1
            for x, g, (m, v) in zip((emb, soft, bias), grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        table, b = emb @ (soft[1] - soft[0]), float(bias[1] - bias[0])
        z = margins(table, b)
        a, c = calibrated(z, labels[held])
        if (now := loss(a * z + c)) < best[0]:
            best, worse = (now, Model(a * table, a * b + c + shift)), 0
        elif (worse := worse + 1) == 3:
            break
    return best[1]


def held_out(col: str = "doc_id"):
    """Whether the CRC-32 of the id as text leaves remainder 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 2500) -> Model:
    """Train on rows of `labels` (``doc_id, toxic``) that aren't held out.

    At most `max_rows` documents of each label, those with the smallest hashes of doc_id, are
    read for it: the bound of what the training task gets. The prior comes from all such labels.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    prior = 0.5 if prior is None else prior
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for k in (0, 1)]
    # 2 x max_rows pairs of numbers at most
    picked = F.broadcast(some[0].unionByName(some[1]).dropDuplicates(["doc_id"]))
    rows = docs.selectExpr("doc_id", "cast(text as binary) text").join(picked, "doc_id").groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, marks = [], []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 128):  # a few large arrays: what they took is given back afterwards
                own = [bag(x or b"") for x in texts[lo : lo + 128]]
                ends = np.cumsum([len(i) for i, _ in own])[:-1]
                bags += zip(*(np.split(np.concatenate(x), ends) for x in zip(*own, strict=True)), strict=True)
            marks += batch.column(0).to_pylist()
        if bags:
            model = train(bags, np.array(marks, np.int64), prior)
            del bags, own, texts
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["table", "bias"])

    one = rows.select("doc_id", "row.toxic", "row.text").repartition(1).sortWithinPartitions("doc_id").select("toxic", "text")
    got = one.mapInArrow(run, "table binary, bias double").first()
    return Model(np.frombuffer(got["table"], np.float32), got["bias"]) if got else train([], np.zeros(0), prior)


def judged(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``given`` (a struct of the columns of `docs`, whatever their names), ``given_score`` and ``given_predicted`` of each row.

    Null texts count as empty; an empty text has no n-grams and gets the score of the bias. Repeated rows get the same
    answer each. Long texts are read a stretch at a time. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            score = pa.array([own.score(x or b"") for x in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], ["given", "given_score"])

    out = mapped(rows, run, f"given {rows.schema['given'].dataType.simpleString()}, given_score double")
    return out.select("given", "given_score", (F.col("given_score") >= threshold).cast("int").alias("given_predicted"))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The columns of `docs` with ``score`` and ``predicted`` (replaced if there are such), as :func:`judged` has them."""
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = judged(docs.select(*[F.col(f"`{c}`") for c in keep]), model, threshold)
    return out.select("given.*", F.col("given_score").alias("score"), F.col("given_predicted").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the text is read for the score alone
    out = scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
