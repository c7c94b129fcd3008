"""Passages put into other text are found whatever the lines, sentences and words around them."""

import random

from treescan.llm import passages


def prose(rng, n):
    return [f"w{rng.randrange(900)}x{rng.randrange(900)}" for _ in range(n)]


def lines(words, n):
    return "\n".join(" ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_a_passage_on_short_lines(spark):
    rng = random.Random(4)
    passage = lines(prose(rng, 60), 5)
    texts = {k: f"{lines(prose(rng, 40), 5)}\n{passage}\n{lines(prose(rng, 40), 5)}" if k < 2 else lines(prose(rng, 140), 5) for k in range(4)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in passages.duplicates(df).collect()} == {0, 1}
    kept = {r["doc_id"]: r["text"] for r in passages.cleaned(df).collect()}
    assert kept[0] == texts[0] and len(kept[1].split()) <= len(texts[1].split()) - 30


def test_cuts_depend_on_what_is_near_only(spark):
    rng, texts, n = random.Random(6), {}, 40
    for k in range(n):
        passage = " ".join(prose(rng, 60))
        for copy in range(2):
            texts[2 * k + copy] = " ".join([*prose(rng, rng.randrange(50, 90)), passage, *prose(rng, rng.randrange(50, 90))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in passages.cleaned(df).collect()}
    gone = [len(texts[k].split()) - len(kept[k].split()) for k in texts]
    # a paragraph that is 0.8 similar may hold a few words beside the passage
    assert not any(gone[::2]) and min(gone[1::2]) > 0 and max(gone) <= 75 and sum(gone) >= 0.65 * 60 * n


def test_every_word_is_in_a_paragraph():
    rng = random.Random(7)
    for n in (5, 9, 17, 30, 500):
        raw = " ".join(prose(rng, n)).encode()
        u = passages.Units(raw, 1, 1)
        assert u.first[0] == 0 and u.last[-1] == len(raw) and u.grams.sum() == n - 4
        assert all(a < b for a, b in zip(u.first[1:], u.last, strict=False)) and (n < 9 or u.grams.min() >= passages.REACH)
    assert len(passages.Units(b"only four words here", 1, 1).first) == 0
    assert passages.Units(b"word " * 10_000, 1, 1).grams.max() == passages.MOST  # no cut depends on what is near there
