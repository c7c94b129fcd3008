"""The pipeline's stage of near copies: all with a Jaccard similarity of 0.8 or more go, and no others."""

import random

import corpus_pipeline as pipeline
from treescan.llm import buckets, simhash


def jaccard(a, b):
    a, b = (x.lower().split() for x in (a, b))
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def bits(a, b):
    return (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def kept(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in pipeline.one_of_each(spark, docs, "").collect()}


def test_near_copies_far_apart_in_bits_go(spark):
    rng, texts, far = random.Random(1), {}, 0
    while far < 40:
        a = prose(rng, rng.randrange(80, 400))
        b = " ".join([*a, *prose(rng, len(a) // 5)])
        a = " ".join(a)
        if jaccard(a, b) >= 0.8 and bits(a, b) > 6:
            texts[2 * far], texts[2 * far + 1], far = a, b, far + 1
    assert kept(spark, texts) == {k for k in texts if k % 2 == 0}


def test_clean_documents_close_in_bits_stay(spark):
    rng, texts, near = random.Random(2), {}, 0
    while near < 20:
        a = prose(rng, 300)
        b = list(a)
        for k in rng.sample(range(300), 14):
            b[k] = "other"
        a, b = " ".join(a), " ".join(b)
        if jaccard(a, b) < 0.75 and bits(a, b) <= 6:
            texts[2 * near], texts[2 * near + 1], near = a, b, near + 1
    assert kept(spark, texts) == set(texts)


def test_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    label = {k: k for k in texts}
    links = [(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links and {r["doc_id"]: r["component_id"] for r in simhash.near_copies(rows).collect()} == label


def test_large_buckets_empty_texts_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(buckets, "TEXTS", 8)
    rng = random.Random(3)
    base = prose(rng, 200)
    texts = {k: " ".join([*base, f"x{k}"]) for k in range(60)}
    rows = [*texts.items(), (100, None), (101, ""), (102, " \n"), (None, "a null id"), (103, "a null id"), (103, "other words"), (104, "Other  words")]
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(k, 0) for k in texts} | {(k, 100) for k in (100, 101, 102)} | {(None, 103), (103, 103), (104, 103)}
