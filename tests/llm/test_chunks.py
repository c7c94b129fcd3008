import numpy as np
import pytest
from tokenizers import Tokenizer

from treescan.llm import token_store, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_tokenizer())


def test_a_word_is_encoded_once_whatever_stands_beside_it(library):
    enc = tokens.ChunkEncoder(library.to_str())
    enc.ids(["straße été mot *** .,".encode()])
    known = enc.count
    for text in ("mot*** mot., ***mot*** (?)", "Straße.,ÉTÉ*** É"):
        assert enc.ids([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert enc.count == known + 2  # (?) and é


def test_chunks_give_the_ids_of_whole_texts(library):
    enc = tokens.ChunkEncoder(library.to_str())
    rng = np.random.default_rng(2)
    parts = [*"aTz09éÉß×÷ÿÞ'.,*<|>!…—̱̈̊́ \n\t", "'s", "'LL", "'t", "<|startoftext|>", "<|ENDOFTEXT|>", "Ä", "ж", "日", "½", "ǅ", "T̈", "ẘ", "Ȩ́", "  "]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(6000)]
    for k in range(len(texts)):
        some = texts[k : k + 1 + k % 2]
        for text, ids in zip(some, enc.ids([x.encode() for x in some]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_capitals_before_marks(library):
    enc = tokens.ChunkEncoder(library.to_str())
    for text in ("T̈", "a W̊.", "J̌H̱", "Y̊ T"):
        assert enc.ids([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_many_documents_are_coded_at_once_as_one_by_one():
    rng = np.random.default_rng(3)
    for most in (1 << 8, 1 << 16, 1 << 32):
        lens = rng.integers(0, 9, 300)
        values = rng.integers(0, most, int(lens.sum())).astype(np.uint32) >> rng.integers(0, 9, int(lens.sum())).astype(np.uint32)
        control, data = token_store.encode_all(values, lens)
        ends = np.cumsum(lens)
        for c, d, a, b in zip(control, data, ends - lens, ends, strict=True):
            assert (c, d) == token_store.encode(values[a:b]) and (token_store.decode(c, d, b - a) == values[a:b]).all()
        n = token_store.id_lengths(b"".join(control), lens)
        assert (token_store.gathered(n, b"".join(data)) == values).all()


def test_groups_of_documents_are_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "DOCS", 3)
    monkeypatch.setattr(token_store, "IDS", 10)
    lens = np.array([1, 1, 1, 1, 11, 5, 5, 1, 0, 0])
    found = list(token_store.groups(lens))
    assert found == [(0, 3), (3, 4), (4, 5), (5, 7), (7, 10)] and list(token_store.groups(lens[:0])) == []
