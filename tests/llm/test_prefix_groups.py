import numpy as np
import pyarrow as pa
import pytest

from treescan.llm import buckets, passages


def texts_of(seed, n, words=12):
    """Texts of which many are near copies, and many share frequent words only."""
    rng = np.random.default_rng(seed)
    out = [b"a a a a a", b"a b a b a b a b"]
    while len(out) < n:
        if rng.random() < 0.5:
            w = out[rng.integers(max(2, len(out) - 40), len(out)) if len(out) > 2 else 0].split(b" ")
            w[[0, -1, len(w) // 2][rng.choice(3, p=[0.4, 0.4, 0.2])]] = b"w%d" % rng.integers(9)
        else:
            w = [b"common words stand before all".split(b" "), []][rng.integers(2)] + [b"w%d" % x for x in rng.integers(0, words, rng.integers(10, 40))]
        out.append(b" ".join(w))
    return list(dict.fromkeys(out))


def similar(a, b):
    a, b = passages.shingles(a), passages.shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def test_likeness_is_exact():
    texts = texts_of(1, 150)
    columns = passages._tabled([pa.array(texts, pa.binary())])
    i, j = (x.ravel() for x in np.meshgrid(*[np.arange(len(texts))] * 2))
    near = buckets.likeness(0.8)
    wanted = np.array([similar(texts[a], texts[b]) for a, b in zip(i, j, strict=True)])
    assert wanted.sum() > 2 * len(texts) and (near(columns, i, j) == wanted).all()
    for k in range(0, len(texts), 7):  # one with many
        assert (near(columns, i[i == k], j[i == k]) == wanted[i == k]).all()


def test_elements_are_looked_up_in_parts(monkeypatch):
    texts = texts_of(4, 40)
    columns = passages._tabled([pa.array(texts, pa.binary())])
    i, j = (x.ravel() for x in np.meshgrid(*[np.arange(len(texts))] * 2))
    whole = buckets.likeness(0.8)(columns, i, j)
    monkeypatch.setattr(buckets, "ELEMENTS", 50)
    assert (buckets.likeness(0.8)(columns, i, j) == whole).all()


def test_no_link_is_outside_of_its_groups():
    texts = texts_of(2, 300)
    unit = np.sort(np.random.default_rng(0).integers(0, 4, len(texts)))
    columns = passages._tabled([pa.array(texts, pa.binary())])
    rows, group = buckets.prefixes(0.8)(columns, unit)
    assert (np.diff(group) >= 0).all()
    together = set()
    for g in np.unique(group).tolist():
        own = np.sort(rows[group == g]).tolist()
        assert len(set(unit[own].tolist())) == 1 and len(set(own)) == len(own)
        together |= {(a, b) for k, a in enumerate(own) for b in own[k + 1 :]}
    links = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if unit[a] == unit[b] and similar(texts[a], texts[b])}
    assert len(links) > 100 and links <= together
    assert len(together) < 0.6 * sum(n * (n - 1) // 2 for n in np.bincount(unit).tolist())


@pytest.mark.parametrize("block", [7, 1000])
def test_groups_give_the_components_of_all_pairs(spark, block):
    texts = texts_of(3, 250)
    rows = [(key, node, bytearray(t)) for key, lo, hi in ((1, 0, 120), (2, 100, 180), (3, 170, len(texts)), (4, 5, 7)) for node, t in enumerate(texts) if lo <= node < hi]
    df = spark.createDataFrame(rows, "key long, node long, words binary").repartition(3)
    found = buckets.links(df, ["words"], buckets.likeness(0.8), passages._tabled, block, small=4, apart=buckets.prefixes(0.8)).collect()
    by_key: dict = {}
    for key, node, _ in rows:
        by_key.setdefault(key, []).append(node)
    every = [(a, b) for own in by_key.values() for a in own for b in own if a < b and similar(texts[a], texts[b])]

    def parts(edges):
        label = list(range(len(texts)))
        for a, b in [*edges] * 40:
            label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts([(r["src"], r["dst"]) for r in found]) == parts(every)
