"""Passages that repeat across documents: paragraphs by MinHash banding, verified by exact Jaccard, and runs of them.

A text's five-word shingles are dealt into paragraphs at shingles whose hash is the least among that
of the `REACH` on each side, so the cuts depend on what is near them only, not on lines, sentences or
what stands before; every shingle is in one paragraph (which shares four words with the next).
A paragraph longer than `MOST` shingles, as text without such cuts would be, is cut there.

1. Every paragraph gets MinHashes of its shingles, banded for recall at the threshold. Each task sends a band
   key once; paragraphs whose key comes again have company. A Bloom filter of those that have, whose size
   has a bound, goes to the executors. (Beyond that size it lets more through, at most the corpus once, never
   less; an exact join settles what has company.)
2. The corpus is read again, and paragraphs that pass are written with their words.
3. Equal texts are one node. Nodes that share a band key and one of their rarest shingles there are compared by the exact
   Jaccard similarity of their shingles (:mod:`buckets`). Components of links are the groups of which one paragraph stays.
4. Neighbouring paragraphs of a document that have company are a passage if they hold `passage` words together;
   shorter repeats are phrases, and are left alone.

Texts are read a stretch at a time, so what a worker needs doesn't grow with a text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import buckets
from .shared import cache, components, mapped, written

SHINGLE, JACCARD, RECALL, REACH, MOST, PASSAGE = 5, 0.8, 0.99, 4, 4096, 24
#: Bytes of text at a time; places for band keys that a task remembers; bits of the filter at most, so many for each of its names.
STEP, REMEMBER, FILTER_BITS, FILTER_EACH = 1 << 18, 1 << 20, 1 << 27, 12

_P, _Q = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = cache("passages")


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (at least). What a usual stretch needs is kept."""
    if base not in _powers:
        _powers[base] = _rising(base, 2 * STEP)
    return _powers[base] if n <= 2 * STEP else _rising(base, n)


def _rising(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return tuple(both)


def span_hashes(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each ``values[start:end]``, the same wherever it stands."""
    up, down = powers(base, len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def tune(threshold: float, recall: float, most: int = 12) -> tuple[int, int]:
    """Bands and rows: of all with the recall at the threshold, the most rows, as far as `most` hashes go."""
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding with so few hashes")
    return best


_BLANK = re.compile(rb"[\x20\t-\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def local_cuts(values: np.ndarray, reach: int) -> np.ndarray:
    """Places of values below the `reach` before them and not above the `reach` after them."""
    n = len(values) - 2 * reach
    if n < 1:
        return np.zeros(0, np.int64)
    own = values[reach : reach + n]
    least = np.ones(n, bool)
    for k in range(1, reach + 1):
        least &= (own < values[reach - k : reach - k + n]) & (own <= values[reach + k : reach + k + n])
    return np.flatnonzero(least) + reach


def band_keys(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, ``paragraphs x bands``, of shingles dealt into paragraphs that begin at `first`."""
    seeds = (np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]
    low = np.minimum.reduceat((grams ^ seeds) * np.uint64(0xE7037ED1A0B428DB), first, axis=1)
    keys = np.zeros((bands, len(first)), np.uint64) + np.arange(bands, dtype=np.uint64)[:, None]
    for r in range(rows):
        keys = keys * np.uint64(_P) + low[r::rows]
    return mix(keys).T


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased bytes: where they begin and end, and their hashes."""
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2], span_hashes(raw.astype(np.uint64), _P, edge[::2], edge[1::2])


def gram_hashes(words: np.ndarray) -> np.ndarray:
    up, n = powers(_Q, SHINGLE + 1)[0], max(0, len(words) - SHINGLE + 1)
    grams = words[:n].copy()
    for k in range(1, SHINGLE):
        grams += words[k : n + k] * up[k]
    return mix(grams)


def split(first: np.ndarray, end: int) -> np.ndarray:
    """`first` with a place every `MOST` in longer stretches."""
    size = np.diff(np.append(first, end))
    if not (size > MOST).any():
        return first
    return np.concatenate([np.arange(a, a + n, MOST) for a, n in zip(first.tolist(), size.tolist(), strict=True)])


class Units:
    """Paragraphs of a text, none if it has fewer words than a shingle: places of their first byte and after their last one,
    shingles in them, identities and band keys. A text is read a stretch at a time."""

    def __init__(self, text: bytes, bands: int, rows: int):
        found = list(self._stretches(text, bands, rows))
        self.first, self.last, self.grams, self.names, self.keys = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (*np.zeros((3, 0), np.int64), np.zeros(0, np.uint64), np.zeros((0, bands), np.uint64))

    def _stretches(self, text: bytes, bands: int, rows: int) -> Iterator[tuple]:
        start = end = np.zeros(0, np.int64)  # words from the first that is needed still
        words, grams, begin, at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0, 0
        while at < len(text):
            blank = _BLANK.search(text, at + STEP)
            stop = blank.start() if blank else len(text)
            a, b, new = spans(np.frombuffer(text[at:stop].lower(), np.uint8))
            start, end, words = np.append(start, a + at), np.append(end, b + at), np.append(words, new)
            at, done = stop, stop == len(text)
            n = len(words) - SHINGLE + 1
            if n < 1:
                continue
            grams = np.append(grams, gram_hashes(words[len(grams) :]))
            cuts = local_cuts(grams, REACH)
            bounds = split(np.append(begin, cuts[cuts > begin]), n)
            bounds = np.append(bounds, n) if done else bounds
            if len(bounds) > 1:
                first, last = bounds[:-1], bounds[1:]
                yield start[first], end[last + SHINGLE - 2], last - first, span_hashes(words, _Q, first, last + SHINGLE - 1), band_keys(grams[: last[-1]], first, bands, rows)
                begin = int(last[-1])
            drop = max(0, begin - REACH)
            start, end, words, grams, begin = start[drop:], end[drop:], words[drop:], grams[drop:], begin - drop


def paragraphs(texts: list[bytes], bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """Of several texts: each paragraph's text, its number there, and the columns of :class:`Units`. Short texts are read together."""
    out: list[tuple] = []
    group: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if text is None or size + len(text) > STEP:
            if group:
                out.append(_together([texts[k] for k in group], np.array(group), bands, rows))
            group, size = [], 0
        if text is not None and len(text) > STEP:
            u = Units(text, bands, rows)
            out.append((np.full(len(u.first), i), np.arange(len(u.first)), u.first, u.last, u.grams, u.names, u.keys))
        elif text:
            group.append(i)
            size += len(text) + 1
    empty = (*np.zeros((5, 0), np.int64), np.zeros(0, np.uint64), np.zeros((0, bands), np.uint64))
    return tuple(np.concatenate(x) for x in zip(empty, *out, strict=True))


def _together(texts: list[bytes], numbers: np.ndarray, bands: int, rows: int) -> tuple:
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    start, end, words = spans(np.frombuffer(b"\n".join(texts).lower(), np.uint8))
    edges = np.searchsorted(start, begins)  # a text's first word
    count = np.maximum(np.diff(edges) - SHINGLE + 1, 0)  # of its shingles
    owner = np.repeat(np.arange(len(texts)), count)
    ends = np.cumsum(count)
    if not len(owner):
        return (*np.zeros((5, 0), np.int64), np.zeros(0, np.uint64), np.zeros((0, bands), np.uint64))
    place = np.arange(len(owner)) - (ends - count)[owner]  # of a shingle in its text
    word = edges[owner] + place
    grams = gram_hashes(words)[word]
    cuts = local_cuts(grams, REACH)
    cuts = cuts[(place[cuts] >= REACH) & (place[cuts] < count[owner[cuts]] - REACH)]
    first = split(np.union1d((ends - count)[count > 0], cuts), len(owner))
    last = np.append(first[1:], len(owner))
    after = word[last - 1] + SHINGLE
    text = owner[first]
    number = np.arange(len(first)) - np.searchsorted(text, text)
    return numbers[text], number, start[word[first]] - begins[text], end[after - 1] - begins[text], last - first, span_hashes(words, _Q, word[first], after), band_keys(grams, first, bands, rows)


def _company(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """``name``: identities of paragraphs that share a band key with another place of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, whose = np.zeros(REMEMBER, np.uint64), np.zeros(REMEMBER, np.uint64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                *_, names, keys = paragraphs([x or b"" for x in whole.column(0).slice(lo, 256).to_pylist()], bands, rows)
                if not len(names):
                    continue
                keys, names = keys.ravel(), np.repeat(names, bands)
                order = np.argsort(keys)
                key, name = keys[order], names[order]
                new = np.append(True, key[1:] != key[:-1])
                again = ~new | np.append(~new[1:], False)
                key_, name_ = key[new], name[new]
                place = (key_ >> np.uint64(20) & np.uint64(REMEMBER - 1)).astype(np.int64)
                known = seen[place] == key_
                # of interest as they are: two rows of one key
                sure = np.unique(np.concatenate([name[again], name_[known], whose[place[known]]]))
                seen[place], whose[place] = key_, name_
                cols = [np.concatenate([x[~known], sure, sure]).view(np.int64) for x in (key_, name_)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "name"])

    keyed = mapped(texts.select("text"), run, "key long, name long", "passages")
    # one has company if a row with its key comes before or after
    beside = "first(1) over (partition by key order by name rows between {0} and {0})"
    near = keyed.selectExpr("name", f"coalesce({beside.format('1 preceding')}, {beside.format('1 following')}) other")
    return near.where("other is not null").select("name").distinct()


def _filter(names: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of two places a name, as words of 64 bits, and its bits."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << int(names.count() * FILTER_EACH).bit_length()))
    places = F.explode(F.array(F.col("name").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("name", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit")
    cells = names.select(places).groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    table = cells.toArrow()  # bits / 64 rows at most
    words = np.zeros(bits // 64, np.uint64)
    words[table["cell"].to_numpy()] = table["word"].to_numpy().view(np.uint64)
    return words, bits


def _passes(words: np.ndarray, bits: int, names: np.ndarray) -> np.ndarray:
    out = np.ones(len(names), bool)
    for place in (names & np.uint64(bits - 1), names >> np.uint64(32) & np.uint64(bits - 1)):
        out &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _code_points(texts: list[bytes], owner: list[int], first: list[int], last: list[int]) -> tuple[list[int], list[int]]:
    """Code points before and in byte ranges, which are in order of text and place and may overlap a little."""
    begin, length = [], []
    current, seen, total = -1, 0, 0
    for i, a, b in zip(owner, first, last, strict=True):
        if i != current:
            current, seen, total = i, 0, 0
        raw = texts[i]
        total += _points(raw, seen, a) if a >= seen else -_points(raw, a, seen)
        begin.append(total)
        length.append(_points(raw, a, b))
        seen = a
    return begin, length


def _points(raw: bytes, a: int, b: int) -> int:
    return len(str(raw[a:b], "utf-8"))


def duplicates(docs: DataFrame, threshold: float = JACCARD, recall: float = RECALL, passage: int = PASSAGE) -> DataFrame:
    """Paragraphs of passages that repeat.

    docs: ``doc_id, text``; other columns, whatever their names, are ignored. Returns a row for each: ``doc_id, row_key``
    (a hash of doc_id and text), ``paragraph`` (its number in the document), ``start, length``
    (code points of the text), ``kept`` (the first of its group by doc_id, row_key and
    paragraph; null ids come last), ``keep_doc_id, keep_paragraph`` (the group's kept one) and ``group_size``.
    Paragraphs overlap by four words; what repeats is all that lies in any that isn't kept. Words are what stands
    between ASCII white space, A-Z lower-cased. What a document repeats of itself counts as well. Null and empty texts and those of fewer than five words have no paragraphs. Rows
    with the same doc_id and text count as one document. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bands, rows = tune(threshold, recall)
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    shared = written(_company(texts, bands, rows))
    wanted = spark.sparkContext.broadcast(_filter(shared))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key long, paragraph int, grams int, start int, length int, name long, words binary"

    def of_interest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = wanted.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = [x or b"" for x in batch.column(2).to_pylist()]
                text, number, first, last, grams, names, _ = paragraphs(texts, bands, rows)
                hit = np.flatnonzero(_passes(table, bits, names))
                owner, first, last = text[hit].tolist(), first[hit].tolist(), last[hit].tolist()
                begin, length = _code_points(texts, owner, first, last)
                words = [b" ".join(texts[i][x:y].lower().split()) for i, x, y in zip(owner, first, last, strict=True)]
                cols = [number[hit], grams[hit], begin, length, names[hit].view(np.int64), words]
                own = batch.take(pa.array(owner, pa.int64()))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [x.split()[0] for x in schema.split(", ")])

    found = written(mapped(texts, of_interest, schema, "passages"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "paragraph")
    nodes = found.groupBy("name", "words").agg(F.min(place).alias("place"), F.max(place).alias("end"), F.count("*").alias("n"))
    nodes = written(nodes.join(shared, "name", "left_semi").withColumn("node", F.monotonically_increasing_id()))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # words alone have the shingles they had within their text, as one paragraph
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                node = np.repeat(part.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_keys(part.column(1).to_pylist(), bands, rows).ravel().view(np.int64))], ["node", "key"])

    keys = written(mapped(nodes.select("node", "words"), keys_of, "node long, key long", "passages").distinct())
    # buckets of the same nodes are compared once
    sizes = keys.groupBy("key").agg(F.count("*").alias("count"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node")).alias("xor")).where(F.col("count") > 1)
    sizes = sizes.groupBy("count", "sum", "xor").agg(F.min("key").alias("key")).select("key")
    members = written(keys.join(sizes, "key").join(nodes.select("node", "words"), "node").select("key", "node", "words"))
    edges = buckets.links(members, ["words"], buckets.likeness(threshold), _tabled, buckets.TEXTS, small=16, apart=buckets.prefixes(threshold))
    joined = components(edges)
    named = written(nodes.join(joined, "node", "left").withColumn("group", F.coalesce("component", "node")))
    # a node whose two ends differ has two places at least
    groups = named.groupBy("group").agg(F.min("place").alias("keep"), F.sum("n").alias("group_size"), F.max(F.col("place") != F.col("end")).alias("several"), F.count("*").alias("k"))
    groups = written(groups.where("several or k > 1").select("group", "keep", "group_size"))
    answers = written(named.select("name", "words", "group").join(groups, "group").select("name", "words", "keep", "group_size"))
    out = found.join(answers, ["name", "words"]).select("doc_id", "row_key", "paragraph", "grams", "start", "length", "keep", "group_size")
    # repeated rows are one document; a window sees a document
    out = out.groupBy("row_key", "doc_id", "paragraph").agg(*[F.min(c).alias(c) for c in ("grams", "start", "length", "keep", "group_size")])
    document = Window.partitionBy("row_key", "doc_id")
    out = out.withColumn("run", F.col("paragraph") - F.row_number().over(document.orderBy("paragraph")))
    out = out.withColumn("words", F.sum("grams").over(Window.partitionBy("row_key", "doc_id", "run")) + SHINGLE - 1).where(F.col("words") >= passage)
    kept = (F.col("row_key") == F.col("keep.row_key")) & (F.col("paragraph") == F.col("keep.paragraph")) & F.col("doc_id").eqNullSafe(F.col("keep.doc_id"))
    return out.select(
        "doc_id", "row_key", "paragraph", "start", "length", kept.alias("kept"),
        F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.paragraph").alias("keep_paragraph"), "group_size",
    )


def _keys(texts: list[bytes], bands: int, rows: int) -> np.ndarray:
    """Band keys of paragraphs given by their words with single spaces between, five or more."""
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    start, _, words = spans(np.frombuffer(b"\n".join(texts), np.uint8))
    edges = np.searchsorted(start, begins)
    count = np.diff(edges) - SHINGLE + 1
    first = np.cumsum(count) - count
    word = np.repeat(edges[:-1] - first, count) + np.arange(int(count.sum()))
    return np.ascontiguousarray(band_keys(gram_hashes(words)[word], first, bands, rows))


def _tabled(columns: list) -> list:
    """Shingles of paragraphs given by their words with single spaces between. Words and pairs of them are told apart by their
    bytes, a shingle by two pairs and a word."""
    texts = columns[0].to_pylist()
    words = b" ".join(texts).split(b" ") if texts else []
    count = np.array([x.count(b" ") + 1 for x in texts], np.int64)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    n = np.maximum(count - SHINGLE + 1, 0)
    if (n < 1).any():
        raise ValueError("a paragraph has a shingle at least")
    at = np.repeat(np.cumsum(count) - count - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    pairs, two = np.unique(word[:-1] * len(number) + word[1:], return_inverse=True)
    fours, four = np.unique(two[at] * len(pairs) + two[at + 2], return_inverse=True)
    return buckets.tabled(np.repeat(np.arange(len(texts)), n), four * len(number) + word[at + 4], len(texts))


def shingles(words: bytes) -> frozenset[bytes]:
    w = words.split(b" ")
    return frozenset(b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1)))


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the passages that repeat others: of each group of :func:`duplicates` all but the kept paragraph goes.

    The columns stay, whatever their names; ``n_chars``, if there is one, is that of the new text. A document of which
    nothing but white space is left goes; all others stay, null and empty texts as they are. Repeated rows
    are cut alike. An empty table gives no rows.
    """
    gone = duplicates(docs, **options).where("not kept").select("row_key", "doc_id", "start", "length").distinct()
    spans = gone.groupBy("row_key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    spans = written(spans.select(F.col("row_key").alias("span_key"), F.col("doc_id").alias("span_doc"), "spans"))
    columns = docs.columns
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("given"), F.xxhash64("doc_id", "text").alias("row_key"))
    both = given.join(spans, (F.col("row_key") == F.col("span_key")) & F.col("given.doc_id").eqNullSafe(F.col("span_doc")), "left").select("given", F.col("given.text").alias("text"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gaps in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gaps:
                    at, parts = 0, []
                    for g in gaps:
                        parts.append(text[at : g["start"]])
                        at = max(at, g["start"] + g["length"])
                    text = "".join([*parts, text[at:]])
                    text = text if text.strip() else None
                out.append(text)
            drop = pa.array([bool(g) and t is None for g, t in zip(batch.column(2).to_pylist(), out, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), drop], ["given", "new", "drop"])

    done = mapped(both, cut, f"given {given.schema['given'].dataType.simpleString()}, new string, drop boolean").where("not `drop`")
    new = {"text": F.col("new"), "n_chars": F.when(F.col("new").eqNullSafe(F.col("given.text")), F.col("given.n_chars")).otherwise(F.length("new").cast("long")) if "n_chars" in columns else None}
    return done.select(*[(new[c] if c in new else F.col(f"given.`{c}`")).alias(c) for c in columns])


def op6_passages(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
