"""URL rules, mixing, embeddings and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treescan.llm import embeddings, mixing, url_filter
from treescan.llm import shared
from treescan.llm.shared import components


def judged(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:]
    path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://A.Example.ORG/es/1?q=/en/#x", "https://example.org/en/12", "https://xexample.org/en/1",
    "http://a.com/fr/", "http://a.com/de/x#y", "http://a.com/fr", "x://é.COM/fr/É", "http://u:p@a.com:80/fr/", "http://a.org?x=/en/", "a://b://c.org/", "http://a.org/\nnew", "//a.org/",
    "http://" + "a." * 3000 + "org/", "http://a.org/" + "p" * 20_000,
]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_urls(spark, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    rules = [*url_filter.RULES, ("", "/", "block"), ("com", None, "block"), ("org", "/", "block") if limit else ("net", "/", "block")]
    rows = [(i, u, f"v{i}", "h") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, host string")
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["page_id", "url", "host", "path", "rule", "verdict"]
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"], rules), r["url"]


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge(pages, none).first()["verdict"] == "allow"
    assert url_filter.judge(pages.where("false"), none).count() == 0


def fill(budget, nodes):
    """Water-filling one step at a time: [(weight, capacity)] -> budgets."""
    got, open_ = [0.0] * len(nodes), {i for i, (w, c) in enumerate(nodes) if w > 0 and c > 0}
    left = budget
    while open_ and left > 1e-9:
        total, more = sum(nodes[i][0] for i in open_), 0.0
        for i in list(open_):
            give = min(left * nodes[i][0] / total, nodes[i][1] - got[i])
            got[i] += give
            more += give
            if nodes[i][1] - got[i] <= 1e-9:
                open_.discard(i)
        left -= more
    return got


def test_budgets_like_step_by_step(spark):
    rng = random.Random(4)
    leaves = [(f"d{i}", f"l{j}", f"s{k}", rng.choice([0, 5, 50, 500, 5000])) for i in range(3) for j in range(3) for k in range(3)]
    weights = [("d0", None, None, 5.0), ("d1", None, None, 0.0), ("d0", "l1", None, 7.0), ("d2", "l2", "s1", 3.0)]
    w = {x[:3]: x[3] for x in weights}
    for total in (0, 100, 3000, 10**6):
        got = mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), spark.createDataFrame(weights, "domain string, lang string, source string, weight double"), total, 2)
        got = {tuple(r[:3]): r["budget"] for r in got.collect()}
        want = {}

        def deal(prefix, budget, depth):
            if depth == 3:
                want[prefix] = budget
                return
            names = sorted({x[depth] for x in leaves if x[:depth] == prefix})
            caps = [2 * sum(x[3] for x in leaves if x[: depth + 1] == (*prefix, n)) for n in names]
            shares = fill(budget, [(w.get((*prefix, n, *[None] * (2 - depth)), 1.0), c) for n, c in zip(names, caps, strict=True)])
            for n, s in zip(names, shares, strict=True):
                deal((*prefix, n), s, depth + 1)

        deal((), float(total), 0)
        assert all(abs(got[k] - v) <= 1.001 for k, v in want.items())


def test_mix_odd_rows(spark):
    rows = [(1, "a b c d", None, None, 7, 1), (2, None, "en", "src1", None, 2), (3, "", "en", "src1", 0, 3), (4, "e f g h", "en", "src1", 7, 4), (4, "e f g h", "en", "src1", 7, 4), (None, "i j", "en", "src2", 3, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, epoch int")
    out = mixing.mix(df, mixing.target(spark), mixing.domain_of(), total=9, epochs=3, seed=1)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch", "taken_tokens"]
    for r in got:
        assert r["taken_tokens"] == len((r["text"] or "").split()) and (r["text"] is None or r["n_chars"] == len(r["text"]))
    assert mixing.mix(df.where("false"), mixing.target(spark), mixing.domain_of()).count() == 0


def test_mix_keeps_budgets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source")
    total = docs.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    rows = mixing.op9_mixing(spark, data).collect()
    assert abs(sum(r["taken_tokens"] for r in rows) - total) <= 200  # a token a leaf
    per = {}
    for r in rows:
        per.setdefault(r["doc_id"], []).append(r["epoch"])
    assert all(sorted(v) == list(range(len(v))) or len(v) == len(set(v)) for v in per.values())


def brute(x, ids):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x]
    n = len(x)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                near[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    label = list(ids)
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in np.flatnonzero(near[i])]]) for i in range(n)]
    return {ids[i]: (int(near[i].sum()), label[i], label[i] == ids[i]) for i in range(n)}


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 24))
    x = [list(map(float, (c + rng.standard_normal(24) * s).astype(np.float32))) for c in centres for s in [0.02] * 8 + [0.3] * 3]
    hot = rng.standard_normal(24)
    x += [list(map(float, (hot + rng.standard_normal(24) * 0.05).astype(np.float32))) for _ in range(60)]
    x += [x[0]] * 9 + [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] * 24, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [5.0], [7.0]]
    ids = list(range(100, 100 + len(x)))
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int, kept int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(x, ids)
    assert embeddings.near_duplicates(df.where("false")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")).count() == 2


def test_list_decoding_is_complete():
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.standard_normal((20, 10)))
    limit = embeddings.threshold(10, 32, 0, 12)
    turn, a, b = embeddings.codes(10, 32, 0)
    y = x @ turn
    for row, got in zip(y, embeddings.decode(x, 32, 0, limit), strict=True):
        want = [(i * 32 + j) for i in range(32) for j in range(32) if row[:5] @ a[i] + row[5:] @ b[j] > limit]
        assert sorted(got.tolist()) == want


@pytest.mark.parametrize("edges", [15, 1 << 20])
@pytest.mark.parametrize("shape", ["chain", "star", "random", "empty"])
def test_components(spark, shape, edges, monkeypatch):
    monkeypatch.setattr(shared, "EDGES", edges)
    rng = random.Random(6)
    pairs = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "empty": [], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)]}[shape]
    label = {n: n for p in pairs for n in p}
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {n: c for n, c in label.items() if any(n in p and p[0] != p[1] for p in pairs)}
