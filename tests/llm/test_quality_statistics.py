"""The statistics of a text against plain counts, and their memory."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from treescan.llm.quality import NAMES, PIECE, features


def plain(text: bytes) -> dict[str, float]:
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    n, w, m = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    sizes = [len(x) for x in words] or [0]
    mean = sum(sizes) / len(sizes)
    within = lambda chars: sum(text.count(bytes([c])) for c in chars) / n
    symbols = b"#$%&*@^~+=_" + b"!?"
    return {
        "bytes": math.log1p(len(text)), "words": math.log1p(len(words)), "word_mean": mean,
        "word_spread": math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)),
        "upper": within(range(65, 91)), "lower": within(range(97, 123)), "digit": within(b"0123456789"), "space": within(b" \t\n\x0b\x0c\r"),
        "comma_stop": within(b",.;:"), "bang": within(b"!?"), "pipe": within(b"|\\/<>[]{}"), "mark": within(b"#$%&*@^~+=_"), "wide": within(range(128, 256)),
        "entropy": -sum(c / n * math.log2(c / n) for c in Counter(text).values()), "lines": math.log1p(len(lines)),
        "line_mean": math.log1p(len(text) / m), "line_repeats": 1 - len(set(lines)) / m, "distinct": len(set(words)) / w,
        "top_word": max(Counter(words).values(), default=0) / w, "same_next": sum(a == b for a, b in zip(words, words[1:])) / w,
        "stops": text.count(b".") / w, "distinct_pairs": len(set(zip(words, words[1:]))) / w,
        "capital_words": sum(65 <= x[0] <= 90 for x in words) / w, "symbol_words": sum(x[-1] in symbols for x in words) / w,
    }


def texts():
    rng = random.Random(3)
    yield from (b"", b" ", b"\n\n", b"a", b"A.", b"no blank at all" * 3, b"x" * 99, b"a a a\na a a\n\nb!", "é日本 é日本\n🌳?".encode())
    for k in range(60):
        yield "".join(rng.choice("aB1 .,\n\t!#é|") for _ in range(k * 7)).encode()


@pytest.mark.parametrize("size", [1, 5, 64, PIECE])
def test_statistics_are_plain_counts_whatever_the_pieces(size):
    for text in texts():
        wanted = plain(text)
        np.testing.assert_allclose(features(text, size), [wanted[k] for k in NAMES], rtol=1e-9, atol=1e-6, err_msg=repr(text))


def test_a_long_text_takes_bounded_memory():
    text = b" ".join(b"word%d" % (k % 400_000) for k in range(2_400_000))
    assert len(text) > 20_000_000
    tracemalloc.start()
    features(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130_000_000, peak
