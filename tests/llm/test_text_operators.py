"""Operators on texts against brute force, with nulls, empty texts, repeats, empty tables and clashing names."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from treescan.llm import buckets, fingerprint, packing, passages, quality, simhash, token_store, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, given string, component_id long"
LONG = "word " * 60_000
ODD = [
    (7, None, None, None, None, 1.0, "g", 5), (3, "", "en", "s", 0, None, None, None), (5, "one two", "en", "s", 7, None, None, None),
    (5, "one two", "en", "s", 7, None, None, None), (None, "no id here", "en", "s", 9, None, None, None), (9, LONG, "en", "s", len(LONG), None, None, None),
    (11, "  \n\t ", "en", "s", 5, None, None, None), (12, "Élan vital, naïve. 漢字 <|STARTOFTEXT|> it's", "fr", "s", 30, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_chunk_ids_are_the_librarys(library, docs):
    texts = [r["text"] or "" for r in docs.select("text").collect()] + [r[1] or "" for r in ODD]
    texts += ["<|STARTOFTEXT|> <|startoftext|>a. b,", "it's. IT'S, 'S. á. x..  , . a.", "\x1f a\x1fb \x85x\xa0y ΑΣ. İ I", " \u0301x", "a" * 5000, "x.\x0by", "ﬁ 1.5, 2"]
    enc = tokens.ChunkEncoder(library.to_str())
    for text, ids in zip(texts, enc.ids([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    whole = "\n".join(texts)
    assert enc.ids([whole.encode() * 3])[0].tolist() == library.encode(whole * 3, add_special_tokens=False).ids


@pytest.mark.parametrize("letters", ["ab", "01"])
def test_chunks_that_polynomial_hashes_confuse(library, letters):
    word = "0"
    for _ in range(11):  # Thue-Morse: equal under any polynomial hash modulo 2**64
        word += word.translate(str.maketrans("01", "10"))
    pair = ["x" * 8 + word.translate(str.maketrans("01", x)) for x in (letters, letters[::-1])]
    enc = tokens.ChunkEncoder(library.to_str())
    for text, ids in zip(pair, enc.ids([t.encode() for t in pair]), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_of_all_lengths_with_common_beginnings(library, monkeypatch):
    rng = random.Random(9)
    alphabet = ["a", "b", "\0", "é", ".", ",", " ", "\n", "ß", "1", "漢", "\u0301"]
    texts = ["".join(rng.choices(alphabet, [9, 9, 2, 1, 1, 1, 3, 1, 1, 1, 1, 1], k=rng.randrange(60))) for _ in range(1500)]
    texts += [c * n + e for c in "ab" for n in range(40) for e in ("", "a", "\0")]
    monkeypatch.setattr(tokens, "LONG_BYTES", 500)  # the cache starts anew now and then
    enc = tokens.ChunkEncoder(library.to_str())
    for lo in range(0, len(texts), 100):
        for text, ids in zip(texts[lo : lo + 100], enc.ids([t.encode() for t in texts[lo : lo + 100]]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def packed_right(rows, wanted, capacity):
    got = {}
    for r in rows:
        ids = wanted[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {k: sum(map(len, v)) for k, v in wanted.items()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    fill = []
    for k in sorted(by):
        at = 0
        for offset, n in sorted(by[k]):
            assert offset == at
            at += n
        fill.append(at)
    assert sorted(by) == list(range(len(by))) and all(n == capacity for n in fill[:-1])


@pytest.mark.parametrize("capacity", [4096, 100])
def test_packing(spark, odd, docs, library, capacity):
    for df in (odd, docs):
        wanted = {}
        for r in df.select("doc_id", "text").collect():
            wanted.setdefault(r["doc_id"], []).append(ids_of(library, r["text"]))
        packed_right(packing.pack(df, capacity=capacity).collect(), wanted, capacity)
    assert packing.pack(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, capacity=0)


def test_hilbert_neighbours_touch():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert_index(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_curve_brings_like_documents_together(docs, library):
    rows = docs.select("lang", "text").collect()
    ids = [ids_of(library, r["text"]) for r in rows]
    order = np.argsort(packing.curve_keys(ids), kind="stable")
    langs = np.array([r["lang"] for r in rows])
    along = (langs[order][1:] == langs[order][:-1]).mean()
    assert along > (langs[1:] == langs[:-1]).mean() + 0.1


def test_variable_length_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = rng.integers(0, 1 << rng.integers(1, 33, n), n).astype(np.uint32) if n else np.zeros(0, np.uint32)
        control, data = token_store.encode(values)
        assert len(control) == -(-n // 4) and (token_store.decode(control, data, n) == values).all()


def test_token_store(spark, odd, docs, library, tmp_path):
    for k, df in enumerate((odd, docs)):
        token_store.write_store(df, str(tmp_path / f"s{k}"))
        rows = sorted(token_store.read_store(spark, str(tmp_path / f"s{k}")).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is not None, x))
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        at = 0
        for r in rows:
            ids = ids_of(library, texts[r["doc_id"]])
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())) and bytes(r["ids"]) == ids.tobytes()
            at += len(ids)
    token_store.write_store(odd.where("false"), str(tmp_path / "none"))
    assert token_store.read_store(spark, str(tmp_path / "none")).count() == 0


def test_commonest_ids_take_one_byte(spark, docs, tmp_path):
    token_store.write_store(docs, str(tmp_path / "s"))
    ranks = np.frombuffer((tmp_path / "s/ranks.bin").read_bytes(), "<u4")
    assert len(set(ranks.tolist())) == len(ranks)
    size = sum(p.stat().st_size for p in (tmp_path / "s").glob("*.tks"))
    n = token_store.read_store(spark, str(tmp_path / "s"), with_ids=False).agg(F.sum("n_tokens")).first()[0]
    assert size < 2 * n


def edits(rows):
    """doc_id -> (n_chars, sha256) of the edited text, one by one."""
    ordered = sorted(((-1 << 63 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["doc_id"]) for r in rows), key=lambda x: (-x[0], x[1]))
    out = []
    for i, (_, text, doc) in enumerate(ordered):
        after, k = ordered[(i + 1) % len(ordered)][1], len(text) // 3
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_neighbours_edits_and_likeness(odd, docs):
    for df in (odd, docs, docs.limit(1)):
        rows = fingerprint.compare_neighbours(df).collect()
        assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == edits(df.collect())
        assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert fingerprint.compare_neighbours(odd.where("false")).count() == 0
    rows = fingerprint.compare_neighbours(docs).collect()
    assert np.mean([r["near_edited"] for r in rows]) > np.mean([r["near_next"] for r in rows]) + 0.2


def test_digests(odd):
    rows = fingerprint.digests(odd.withColumn("fingerprint", F.lit("old"))).collect()
    assert len({r["fingerprint"] for r in rows if r["text"] == "one two"}) == 1
    a, b = fingerprint.digest(b"some words that are long enough to count"), fingerprint.digest(b"")
    assert fingerprint.likeness(a, a) == 1 and fingerprint.difference(a, b) == fingerprint.difference(b, a) <= fingerprint.MOST


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [2, 6])
def test_simhash_components(docs, radius):
    rows = docs.select("doc_id", "text").collect()
    fps = [(r["doc_id"], simhash.fingerprint((r["text"] or "").encode())) for r in rows]
    pairs = [(a, b) for i, (a, x) in enumerate(fps) for b, y in fps[:i] if bin(x ^ y).count("1") <= radius]
    wanted = classes(pairs, [a for a, _ in fps])
    found = simhash.near_duplicates(docs, radius).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {a: (f"{x:016x}", wanted[a]) for a, x in fps}


@pytest.mark.parametrize("block", [1, 8, 1024])
@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_with_blocks_of_any_size_and_any_partitions(spark, block, parts):
    rng = random.Random(parts)
    values = {rng.getrandbits(64) for _ in range(40)}
    near = {v ^ (1 << rng.randrange(64)) for v in values for _ in range(3)} | {v ^ (1 << 3) ^ (1 << rng.randrange(4, 64)) for v in values}
    values = sorted(values | near)
    nodes = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(values)], "node long, bits binary")
    found = [(r["src"], r["dst"]) for r in simhash.links(nodes, 2, block, parts).collect()]
    pairs = [(i, j) for i, a in enumerate(values) for j, b in enumerate(values[:i]) if bin(a ^ b).count("1") <= 2]
    assert classes(found, range(len(values))) == classes(pairs, range(len(values)))


@pytest.mark.parametrize("block", [2, 7, 100])
@pytest.mark.parametrize("small", [1, 32])
def test_buckets_connect_as_all_pairs_do(spark, block, small):
    """Numbers link if they differ by one at most; a bucket has one long chain, others and repeats of other buckets."""
    rng = random.Random(block)
    members = {(1, k, k) for k in range(40)} | {(1, 100 + k, 90 + 3 * k) for k in range(20)} | {(k % 5 + 2, 200 + k, rng.randrange(60)) for k in range(60)}
    near = lambda columns, i, j: np.abs(columns[0][i] - columns[0][j]) <= 1
    df = spark.createDataFrame(sorted(members), "key long, node long, value long")
    found = buckets.links(df, ["value"], near, lambda columns: [columns[0].to_numpy()], block, small=small)
    pairs = [(a[1], b[1]) for a in members for b in members if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 1]
    nodes = {m[1] for m in members}
    assert classes([(r["src"], r["dst"]) for r in found.collect()], nodes) == classes(pairs, nodes)
    assert buckets.links(df.where("false"), ["value"], near, lambda columns: [columns[0].to_numpy()], block).count() == 0


def test_a_stretch_at_a_time_is_the_same(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)).encode() + b" \n" for n in (0, 1, 2, 3, 4, 50, 500)]
    whole = [(simhash.fingerprint(t), simhash.normal(t), passages.Units(t, 5, 2)) for t in texts]
    monkeypatch.setattr(simhash, "STEP", 40)
    monkeypatch.setattr(passages, "STEP", 60)
    monkeypatch.setattr(passages, "_powers", {})
    for t, (fp, words, u) in zip(texts, whole, strict=True):
        v = passages.Units(t, 5, 2)
        assert simhash.fingerprint(t) == fp and simhash.normal(t) == words == b" ".join(t.split())
        assert all(np.array_equal(getattr(u, x), getattr(v, x)) for x in ("first", "last", "grams", "names", "keys"))


def test_fingerprint_by_hand():
    import xxhash

    text = "The  quick\tBrown\x0bfox É jumps"
    words = ["the", "quick", "brown", "fox", "É", "jumps"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(4)]
    assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_simhash_odd_rows(odd):
    rows = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert rows[7] == rows[3] == rows[11] == 3 and rows[5] == 5 and rows[None] is None
    assert simhash.near_duplicates(odd.where("false")).count() == 0
    kept = simhash.representatives(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["12", "3", "5", "9", "None"] and kept[0].__fields__ == [x.split()[0] for x in SCHEMA.split(", ")]


@pytest.mark.parametrize(("gains", "need"), [([[0, 1, 2, 3]] * 4, 3), ([[0, 2, 5, 6], [0, 1, 4, 7], [0, 3, 3, 9], [0, 2, 4, 8]], 11)])
def test_allocation_is_the_cheapest(gains, need):
    from itertools import product

    rng = np.random.default_rng(3)
    costs = [np.concatenate([np.zeros((20, 1)), rng.random((20, 3)).cumsum(1)], axis=1) for _ in range(4)]
    got = simhash.allocate(costs, gains, need)
    for i in range(20):
        gained = lambda t: sum(gains[k][t[k] + 1] for k in range(4))
        best = min(sum(costs[k][i, t[k] + 1] for k in range(4)) for t in product(range(-1, 3), repeat=4) if gained(t) >= need)
        assert gained(got[i]) >= need and abs(sum(costs[k][i, got[i, k] + 1] for k in range(4)) - best) < 1e-12
    with pytest.raises(ValueError):
        simhash.allocate(costs, gains, 100)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}x{rng.randrange(words)}" for _ in range(n)) + "."


def test_passages_within_other_text(spark):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, n) for n in (12, 9, 15, 11, 10))
    texts = {i: " ".join(sentence(rng, rng.randrange(4, 20)) for _ in range(12)) for i in range(40)}
    for i in range(0, 40, 4):
        words = texts[i].split()
        at = rng.randrange(len(words))
        texts[i] = " ".join([*words[:at], passage, *words[at:]])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = passages.duplicates(df).collect()
    assert {r["doc_id"] for r in rows} == set(range(0, 40, 4))
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] in passage + texts[r["doc_id"]]
    kept = {r["doc_id"]: r["text"] for r in passages.cleaned(df).collect()}
    assert set(kept) == set(texts) and all(kept[i] == texts[i] for i in texts if i % 4)
    assert sum(passage[len(passage) // 2 :][:80] in t for t in kept.values()) == 1


def test_passages_against_brute_force(docs):
    """All pairs of paragraphs with a Jaccard similarity of 0.8 or more, by whole comparison, and their runs."""
    own, seen = {}, {}
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        u = passages.Units(raw, 1, 1)
        for k in range(len(u.first)):
            words = b" ".join(raw.lower()[u.first[k] : u.last[k]].split())
            own[r["doc_id"], k] = words
            seen.setdefault(words, passages.shingles(words))
    texts = list(seen)
    number = {w: i for i, w in enumerate(texts)}
    by = {}
    for i, w in enumerate(texts):
        for s in seen[w]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for v in by.values() for x, a in enumerate(v) for b in v[:x]}
    close = [(a, b) for a, b in pairs if len(seen[texts[a]] & seen[texts[b]]) >= 0.8 * len(seen[texts[a]] | seen[texts[b]])]
    wanted = classes(close, range(len(texts)))
    size = {}
    for words in own.values():
        size[wanted[number[words]]] = size.get(wanted[number[words]], 0) + 1
    repeats = {k for k, words in own.items() if size[wanted[number[words]]] > 1}
    runs = set()
    for doc, k in repeats:
        a = b = k
        while (doc, a - 1) in repeats:
            a -= 1
        while (doc, b + 1) in repeats:
            b += 1
        if sum(len(own[doc, i].split()) - 4 for i in range(a, b + 1)) + 4 >= passages.PASSAGE:
            runs.add((doc, k))
    found = {(r["doc_id"], r["paragraph"]) for r in passages.duplicates(docs).collect()}
    assert runs and found <= runs and len(found) >= 0.99 * len(runs)


def test_phrases_are_left_alone(spark):
    rng = random.Random(8)
    phrase = " ".join(f"p{k}" for k in range(18))
    texts = {k: " ".join([sentence(rng, 40), phrase, sentence(rng, 40)]) for k in range(6)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert passages.duplicates(df).count() == 0
    assert {r["doc_id"]: r["text"] for r in passages.cleaned(df).collect()} == texts
    found = {r["doc_id"] for r in passages.duplicates(df, passage=8).collect()}  # where cuts leave a whole paragraph within the phrase
    assert found and found <= set(texts)


def test_passages_odd_rows(odd):
    rows = passages.duplicates(odd.unionByName(odd)).collect()
    assert all(r["doc_id"] == 9 for r in rows)
    assert passages.duplicates(odd.where("false")).count() == 0
    assert passages.cleaned(odd).columns == odd.columns
    assert passages.cleaned(odd.where("doc_id <> 9 or doc_id is null")).count() == len(ODD) - 1


def test_tuned_bands_reach_the_recall():
    bands, rows = passages.tune(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= 12
    with pytest.raises(ValueError):
        passages.tune(0.1, 0.9999, 3)


def test_toxicity_of_unseen_spellings(spark, odd):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("bdfgklmnprst", k=2)) + rng.choice("aeiou") + rng.choice("nrst") for _ in range(300)]
    bad = ["gruzzleface", "snorklehead", "pifflewit"]

    def text(toxic, spell=lambda w: w):
        words = rng.choices(vocabulary, k=60)
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = spell(rng.choice(bad))
        return " ".join(words).encode()

    rows = [(k % 2, text(k % 2)) for k in range(600)]
    model = toxicity.train([toxicity.bag(t) for _, t in rows], np.array([y for y, _ in rows]), 0.5)
    swap = lambda w: w[:4] + "x" + w[5:]
    assert np.mean([model.score(text(1, swap)) > 0.3 for _ in range(100)]) > 0.9
    assert np.mean([model.score(text(0)) > 0.3 for _ in range(100)]) < 0.1
    out = toxicity.scored(odd, model)
    assert out.columns == [*[c for c in odd.columns if c != "score"], "score", "predicted"] and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scored(odd.where("false"), model).count() == 0


def test_subwords_by_hand():
    n = sum(len(x) for x in toxicity.subwords(b"ab"))
    assert n == 2 + 1  # " ab", "ab ", " ab "
    assert sum(len(x) for x in toxicity.subwords(b"")) == 0
    whole = np.concatenate(list(toxicity.subwords(b"one two three " * 30_000)))
    one = np.concatenate(list(toxicity.subwords(b"one two three ")))
    assert abs(len(whole) - 30_000 * len(one)) < 30_000 and set(one) <= set(whole)


def test_models_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert 0 <= toxicity.fit(odd, none).score(b"words") <= 1
    stats = quality.measured(odd)
    assert quality.scored(stats, quality.fit(stats, none)).where("score between 0 and 1").count() == len(ODD)
    assert quality.measured(odd.where("false")).count() == 0


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.op4_quality(spark, d).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95


def test_boosting_separates_and_walks_flat_arrays():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.boost(x[:2000], y[:2000], trees=40)
    assert ((trees.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], trees.margin(x[:50]))
    assert quality.boost(np.zeros((0, 5)), np.zeros(0)).score(np.zeros((2, 5))).tolist() == [0.5, 0.5]


def test_sql_of_this_package(spark, data):
    from treescan.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, data)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str(list(r)) for r in want.fetchall())


def test_documents_are_there(data):
    assert pq.read_metadata(f"{data}/documents.parquet").num_rows == 200
