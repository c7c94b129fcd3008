"""Token ids of whole texts by a public tokenizer, with its library.

The tokenizers used here lower-case, drop white space and never join pieces across it, so the ids
of a text are those of its chunks between ASCII white space, one after the other. Words and runs of
ASCII punctuation beside them are chunks of their own, and upper-case letters of Latin 1 are lower-cased
before, so that chunks repeat more. Each chunk is encoded by the library once per cache; a text is then a
gather. Chunks are told apart by their bytes, never by a hash alone. The tests hold this against
the library's ids of whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import cache, mapped, written

#: Chunks that one worker keeps; beyond, the cache starts anew. Places of its table. Bytes of a chunk that two words hold
#: beside its length, and bytes of longer chunks that one worker keeps.
CACHE_CHUNKS, PLACES, SHORT, LONG_BYTES = 5 << 17, 1 << 20, 15, 1 << 23
#: Bytes of text that are handled at a time, and words that the library gets as one line.
STEP_BYTES, LINE = 1 << 18, 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_WORD, _POINT, _STOP, _BLANKS, _LETTER = np.zeros((5, 256), bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_POINT[33:127] = ~_WORD[33:127]
_STOP[list(b".,")] = True
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
#: After the byte 0xC3: letters of Latin 1.
_LETTER[0x80:0xC0] = True
_LETTER[[0x97, 0xB7]] = False
_LEAD, _APOSTROPHE = 0xC3, 39


def normal(text: bytes) -> tuple[bytes, np.ndarray]:
    """The text, which ends in white space, with letters of Latin 1 lower-cased and runs of punctuation set off, and where blanks were put in.

    A run of punctuation and a word beside it are never one piece, but an apostrophe and the letters after it may be.
    """
    raw = np.frombuffer(text, np.uint8)
    special = b"<|" in text  # an upper-case special token is plain text: its case stays
    low = np.frombuffer(text if special else text.lower(), np.uint8).copy()
    if not special:
        lead = np.flatnonzero(raw == _LEAD)
        low[lead[_LETTER[raw[lead + 1]] & (raw[lead + 1] < 0x9F)] + 1] += 32
    if b"\xcc" in text or b"\xcd" in text:  # with some marks a small letter is one code point, a capital isn't
        mark = np.flatnonzero((raw == 0xCC) | (raw == 0xCD))
        mark = mark[mark > 0] - 1
        low[mark] = raw[mark]
    point = np.flatnonzero((_STOP if special else _POINT)[raw])
    before, after = raw[point - 1], raw[point + 1]  # before the first byte is the last one, which is white space
    set_off = _WORD[before] | _LETTER[before] & (raw[point - 2] == _LEAD)
    goes_on = (_WORD[after] | (after == _LEAD) & _LETTER[raw[np.minimum(point + 2, len(raw) - 1)]]) & (raw[point] != _APOSTROPHE)
    at = np.sort(np.concatenate([point[set_off], point[goes_on] + 1]))
    if not len(at):
        return low.tobytes(), at
    out = np.full(len(raw) + len(at), 32, np.uint8)
    here = np.ones(len(out), bool)
    here[at + np.arange(len(at))] = False
    out[here] = low
    return out.tobytes(), at


class ChunkEncoder:
    """A hash table of chunks and their ids, in arrays, so that a whole batch is looked up at once.

    A chunk of at most `SHORT` bytes is two words, its bytes and its length, which are compared whole. Longer
    chunks are numbered by a dictionary of their bytes.
    """

    def __init__(self, blob: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(blob)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # of ids that end a piece
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.low, self.high, self.slots = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64), np.full(PLACES, -1, np.int32)
        self.long, self.long_bytes = {}, 0
        self.start, self.length, self.count = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0
        self.flat, self.used = np.zeros(1 << 14, self.dtype), 0

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ high >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each short chunk's number, or -1."""
        place = self.place(low, high)
        out = self.slots[place]
        left = np.flatnonzero((out >= 0) & ((self.low[place] != low) | (self.high[place] != high)))
        place = place[left]
        while len(left):
            place = place + 1 & len(self.slots) - 1
            got = self.slots[place]
            out[left] = got
            more = (got >= 0) & ((self.low[place] != low[left]) | (self.high[place] != high[left]))
            left, place = left[more], place[more]
        return out

    def add(self, chunks: list[bytes]) -> np.ndarray:
        """Encode chunks that the cache doesn't have, and number them."""
        order, flat, n = self.encode(chunks)
        total, end = len(flat), self.count + len(n)
        if end > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(end, np.int32)]) for x in (self.start, self.length))
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(2 * (self.used + total), self.dtype)])
        self.start[self.count : end], self.length[self.count : end] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + total] = flat
        self.used += total
        number = np.empty(len(n), np.int32)
        number[order] = np.arange(self.count, end, dtype=np.int32)
        self.count = end
        return number

    def put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        place, left = self.place(low, high), np.arange(len(low))
        while len(left):  # of those that want one free place, the last written has it
            free = self.slots[place] < 0
            self.slots[place[free]] = number[left[free]]
            won = free & (self.slots[place] == number[left])
            self.low[place[won]], self.high[place[won]] = low[left[won]], high[left[won]]
            left, place = left[~won], place[~won] + 1 & len(self.slots) - 1

    def encode(self, chunks: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """By the library: an order of the chunks, their ids in that order and how many each has. Words of letters are one piece
        each, so they go as lines that are parted at piece ends; where the ends don't tell, and for other chunks, one by one."""
        texts = [x.decode() for x in chunks]
        letters = [x.isalpha() for x in texts]
        plain = [i for i, x in enumerate(letters) if x]
        rest = [i for i, x in enumerate(letters) if not x]
        order, flat, sizes = [], [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        lines = [plain[k : k + LINE] for k in range(0, len(plain), LINE)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in x]) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(line) and stops[-1] == len(ids):
                order += line
                flat.append(ids)
                sizes.append(np.diff(stops, prepend=0))
            else:
                rest += line
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        order += rest
        flat.append(np.array([i for x in alone for i in x], self.dtype))
        sizes.append(np.array([len(x) for x in alone], np.int64))
        return order, np.concatenate(flat), np.concatenate(sizes)

    def step(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that have at most about `STEP_BYTES` together."""
        joined, put = normal(b"\n".join(texts) + b"\n")
        begins = np.cumsum([0, *[len(x) + 1 for x in texts]])
        begins += np.searchsorted(put, begins)
        raw = np.frombuffer(joined, np.uint8)
        gap = np.concatenate([[True], _BLANKS[raw]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        first, last = edge[::2], edge[1::2]
        size = last - first
        if self.count + len(size) > CACHE_CHUNKS or self.long_bytes > LONG_BYTES:
            self.clear()
        number = np.full(len(size), -1, np.int32)
        short = np.flatnonzero(size <= SHORT)
        if len(short):
            at, long = first[short], size[short].astype(np.uint64)
            eights = np.ndarray(len(raw), "<u8", joined + bytes(16), strides=(1,))
            far = np.ndarray(len(raw), "<u8", joined[8:] + bytes(24), strides=(1,))
            bits = np.uint64(8)
            low = eights[at] << (bits - np.minimum(long, bits)) * bits
            high = far[at] << np.where(long > bits, np.uint64(16) - long, np.uint64(7)) * bits  # the length takes a byte
            high = np.where(long > bits, high, np.uint64(0)) & ~np.uint64(0xFF) | long
            found = self.find(low, high)
            fresh = np.flatnonzero(found < 0)
            if len(fresh):
                order = fresh[np.lexsort((low[fresh], high[fresh]))]
                new = np.append(True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]]))
                one = order[new]
                ids = self.add([joined[a : a + n] for a, n in zip(at[one].tolist(), long[one].tolist(), strict=True)])
                self.put(low[one], high[one], ids)
                found[order] = ids[np.cumsum(new) - 1]
            number[short] = found
        rest = np.flatnonzero(size > SHORT)
        if len(rest):
            chunks = [joined[a:b] for a, b in zip(first[rest].tolist(), last[rest].tolist(), strict=True)]
            new = list(dict.fromkeys(c for c in chunks if c not in self.long))
            if new:
                self.long.update(zip(new, self.add(new).tolist(), strict=True))
                self.long_bytes += sum(map(len, new))
            number[rest] = [self.long[c] for c in chunks]
        n = self.length[number].astype(np.int64)
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.start[number] - ends + n, n) + np.arange(int(n.sum()))]
        cuts = np.concatenate([[0], ends])[np.searchsorted(first, begins)]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > STEP_BYTES:
                out += self.step(group)
                group, size = [], 0
            if len(text) <= STEP_BYTES:
                group.append(text)
                size += len(text) + 1
                continue
            parts = []
            while text:  # cut before white space, which belongs to no chunk
                cut = max(text.rfind(b" ", 0, STEP_BYTES), text.rfind(b"\n", 0, STEP_BYTES)) if len(text) > STEP_BYTES else 0
                cut = cut if cut > 0 else len(text)
                parts += self.step([text[:cut]])
                text = text[cut:]
            out.append(np.concatenate(parts))
        out += self.step(group) if group else []
        if self.long_bytes > LONG_BYTES:  # a very long chunk doesn't outlive its batch
            self.clear()
        return out


_encoders: dict[int, ChunkEncoder] = cache("tokens")


def encoder(blob: str) -> ChunkEncoder:
    """One for each worker process and tokenizer."""
    if (key := hash(blob)) not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(blob)
    return _encoders[key]


def tokenized(df: DataFrame, tokenizer: str, end_id: int, extra=None, extra_schema: str = "") -> DataFrame:
    """A written table ``row_id long, doc_id, n_tokens long, ids binary`` (little-endian, 2 bytes
    an id for vocabularies up to 65,536, else 4) with `end_id` after each document.

    Null texts count as empty. row_id tells rows apart even where doc_id repeats.
    extra(list of id arrays) -> list of arrow arrays for the columns in `extra_schema`.
    """
    with open(tokenizer, encoding="utf-8") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                end = np.array([end_id], enc.dtype)
                ids = [np.concatenate([x, end]) for x in enc.ids([x or b"" for x in part.column(2).to_pylist()])]
                n = pa.array([len(x) for x in ids], pa.int64())
                cols = [part.column(0), part.column(1), n, pa.array([x.tobytes() for x in ids], pa.binary())]
                cols += extra(ids) if extra else []
                names = ["row_id", "doc_id", "n_tokens", "ids", *[c.split()[0] for c in extra_schema.split(",") if c]]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = df.selectExpr("monotonically_increasing_id() row_id", "doc_id", "cast(text as binary) text")
    schema = f"row_id long, doc_id {kind}, n_tokens long, ids binary" + (f", {extra_schema}" if extra_schema else "")
    return written(mapped(rows, run, schema, "tokens"))


def id_width(tokenizer: str) -> int:
    """Bytes of an id in `tokenized`."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
