"""Each stage of the pipeline on what the one before wrote, against brute force."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline as pipeline
from treescan.llm import mixing, passages, tokens, toxicity
from treescan.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, data))
        out.append((before, docs))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_in_order_with_their_columns(steps):
    assert [k for k, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "packing"]
    assert all(after.columns == COLUMNS for _, after in steps[:-1])


def test_toxicity(spark, data, steps):
    before, after = map(texts, steps[0])
    model = toxicity.fit(steps[0][0], spark.read.parquet(f"{data}/labels.parquet"))
    assert set(after) == {k for k, t in before.items() if model.score((t or "").encode()) < 0.3} and len(after) > 100


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_one_of_each_group(steps):
    """Documents with a Jaccard similarity of 0.8 or more on five-word shingles, by comparing all pairs."""
    before, after = map(texts, steps[1])
    sets = {k: shingled(t) for k, t in before.items()}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = {k: k for k in sets}
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links and set(after) == set(label.values()) and len(after) < len(before)


def test_repeated_passages(steps):
    """All pairs of paragraphs at 0.8: a document is cut if a run of paragraphs that have company holds enough words and is not the first."""
    before, after = map(texts, steps[2])
    own, sets, by = {}, {}, {}
    for doc in sorted(before):
        raw = (before[doc] or "").encode()
        u = passages.Units(raw, 1, 1)
        own[doc] = [b" ".join(raw[a:b].lower().split()) for a, b in zip(u.first, u.last, strict=True)]
        for words in own[doc]:
            if words not in sets:
                sets[words] = passages.shingles(words)
                for x in sets[words]:
                    by.setdefault(x, []).append(words)
    label = {w: w for w in sets}

    def find(w):
        while label[w] != w:
            w = label[w]
        return w

    for group in by.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if find(a) != find(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[find(a)] = find(b)
    count, first = Counter(find(w) for doc in own for w in own[doc]), {}
    cut = set()
    for doc in sorted(before):
        run = []
        for k, words in enumerate([*own[doc], None]):
            if words is not None:
                first.setdefault(find(words), (doc, k))
            if words is not None and count[find(words)] > 1:
                run.append((k, words))
                continue
            if sum(len(w.split()) - 4 for _, w in run) + 4 >= passages.PASSAGE and any(first[find(w)] != (doc, i) for i, w in run):
                cut.add(doc)
            run = []
    changed = {k for k in before if after.get(k) != before[k]}
    assert changed <= cut and len(changed) >= 0.95 * len(cut) > 0
    assert all(r["n_chars"] == len(r["text"] or "") < len(before[r["doc_id"]]) for r in steps[2][1].collect() if r["doc_id"] in changed)


def test_mixing(steps, tmp_path):
    steps[3][0].coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = Counter((r[0], r[1]) for r in con.execute(f"SELECT doc_id, taken_tokens FROM ({mixing.OP9_SQL})").fetchall())
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in steps[3][1].collect()) == want


def test_packing(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_tokenizer())
    docs = Counter()
    for r in steps[4][0].collect():
        docs[r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1] += 1
    rows = steps[4][1].collect()
    starts = Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert starts == docs
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert sorted(fill) == list(range(len(fill))) and all(fill[k] == 4096 for k in range(len(fill) - 1))
    assert sum(fill.values()) == sum(n * k for (_, n), k in docs.items())


def test_whole_run(spark, data, steps):
    assert pipeline.run(spark, data).count() == steps[4][1].count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, given string, row_key long, notes map<string,string>"
ROWS = [
    (7, None, None, None, None, 1.0, "g", 5, {"a": "b"}), (3, "", "en", "s", 0, None, None, None, None), (5, "one two", "en", "s", 7, None, None, None, {}),
    (5, "one two", "en", "s", 7, None, None, None, {}), (5, "other words", "en", "s", 7, None, None, None, None), (None, "no id here", "en", "s", 9, None, None, None, None),
    (None, None, None, None, None, None, None, None, None), (9, "word " * 30_000, "en", "s", 150_000, None, None, None, None), (11, "  \n\t ", "en", "s", 5, None, None, None, None),
]


@pytest.mark.parametrize("number", range(5))
def test_odd_rows_and_empty_tables(spark, data, number):
    docs, stage = spark.createDataFrame(ROWS, ODD), pipeline.STAGES[number][1]
    got = stage(spark, docs, data).collect()
    if number < 4:
        assert stage(spark, docs, data).columns == docs.columns
    ids = Counter(r["doc_id"] for r in got)
    if number == 1:  # empty texts are copies; of doc 5 the smallest text stays; null ids stay
        assert ids == Counter({3: 1, 5: 1, None: 2, 9: 1}) and [r["text"] for r in got if r["doc_id"] == 5] == ["one two"]
    elif number == 2:  # the long text repeats itself; all others stay as they are
        assert sum(ids.values()) == len(ROWS)
        assert Counter((r["doc_id"], r["text"]) for r in got if r["doc_id"] != 9) == Counter(x[:2] for x in ROWS if x[0] != 9)
        assert all(0 < r["n_chars"] == len(r["text"]) < 150_000 for r in got if r["doc_id"] == 9)
    elif number == 4:
        assert set(ids) == {x[0] for x in ROWS} and sum(r["start"] == 0 for r in got) == len(ROWS)
    else:
        assert set(ids) <= {x[0] for x in ROWS}
    assert stage(spark, docs.where("false"), data).count() == 0
