import pytest
from pyspark.sql import functions as F

from treescan.operators import control, counters, dedup, devices, history, ranking, traverse
from treescan.streaming import breaker

DAY = 86_400


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, "x"), ("a", 1, 1, 3, "y"), ("b", 1, 1, 9, "z")], "path string, dev bigint, ino bigint, n int, v string")
    assert {(r["path"], r["v"]) for r in dedup.first_wins(df, ["n"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r["path"], r["v"]) for r in dedup.last_wins(df, ["n"]).collect()} == {("a", "x"), ("b", "z")}


def test_limits(spark):
    df = spark.createDataFrame([(".", "/."), ("..", "/.."), (".x", "/.x"), ("n", "n" * 4095), ("n", "n" * 4096)], "name string, path string")
    assert dedup.within_limits(df).count() == 2


@pytest.mark.parametrize(("age", "mode", "known", "ino", "interval", "trusted"), [
    (7 * DAY, 0o100644, 8, 1, 7 * DAY, False),
    (7 * DAY + 1, 0o100644, 8, 1, 7 * DAY, True),
    (8 * DAY, 0o040755, 8, 1, 7 * DAY, False),
    (8 * DAY, 0o100644, 8, 0, 7 * DAY, False),
    (8 * DAY, 0, 0, 1, 7 * DAY, False),
    (8 * DAY, 0o100644, 8, 1, 0, False),
])
def test_trust(spark, age, mode, known, ino, interval, trusted):
    e = spark.createDataFrame([("/a", 1, ino, 9, 9, mode)], "path string, dev bigint, ino bigint, size bigint, mtime bigint, mode int")
    h = spark.createDataFrame([("/a", 1, ino, 10**9 - age, known)], "path string, dev bigint, ino bigint, mtime bigint, d_type int")
    row = history.trusted_rows(e, h, 10**9, interval).first()
    assert (row["stat_src"] == "history") is trusted
    assert row["size"] == (0 if trusted else 9)
    assert history.trusted_rows(e, h.where("false"), 10**9, interval).first()["stat_src"] == "stat"


def test_fold_and_stream_agree_on_hand_sequences(spark):
    runs = {1: "+-+", 2: "-", 3: "---+", 4: "--+--", 5: "+", 6: "+---"}
    rows = [(dev, k, c == "+") for dev, s in runs.items() for k, c in enumerate(s)]
    found = {r["dev"]: (r["state"], r["failures"]) for r in devices.folded(spark.createDataFrame(rows, "dev bigint, seq bigint, ok boolean"), 3).collect()}
    for dev, s in runs.items():
        state, failures = "NORMAL", 0
        for c in s:
            state, failures = breaker.next_state(state, failures, c == "+", 3)
        assert found[dev] == (state, failures)
    assert found[3][0] == "CONDEMNED"


def test_numbers_are_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert all(r["rn"] == r["x"] + 1 for r in ranking.numbered(df, "x").collect())
    assert ranking.numbered(df.where("false"), "x").count() == 0


def test_gap_of_fifty_goes_on_and_fifty_one_stops(spark):
    def kept(ids):
        return sorted(r["id"] for r in counters.slices_before_gap(spark.createDataFrame([(i,) for i in ids], "id bigint")).collect())

    assert kept([0, 1, 52, 53]) == [0, 1, 52, 53]
    assert kept([0, 1, 53, 54]) == [0, 1]
    assert kept([51]) == []


def test_batches_count_an_empty_last_one(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 5, "parent string")
    assert counters.batches(df, 4).first()[0] == 4


def test_walk(spark):
    rows = [("/a", "", True), ("/a/b", "/a", True), ("/a/b/f", "/a/b", False), ("/x/y", "/x", False)]
    df = spark.createDataFrame(rows, "path string, parent string, is_dir boolean")
    assert {(r["path"], r["depth"]) for r in traverse.walk(df, "").collect()} == {("/a", 1), ("/a/b", 2), ("/a/b/f", 3)}
    assert traverse.walk(df, "/none").count() == 0
    ring = spark.createDataFrame([("a", "b", True), ("b", "a", True)], "path string, parent string, is_dir boolean")
    with pytest.raises(ValueError):
        traverse.walk(ring, "a", levels=5)


def test_depths_of_more_than_a_million_rows(spark):
    top = spark.range(1_000_001).selectExpr("'/' || id AS path", "'' AS parent")
    below = top.selectExpr("path || '/x' AS path", "path AS parent").limit(3)
    rows = traverse.depths(top.unionByName(below), "").groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in rows} == {1: 1_000_001, 2: 3}


def test_depths_have_each_row_once(spark):
    rows = [("/a", ""), ("/a", ""), ("/a/b", "/a"), ("/a/b", "/a"), ("/a", "/a/b"), ("", "/a/b"), ("/a/n", "/a"), (None, "/a/n"), ("/z", "/y"), ("/w", None)]
    found = [(r["path"], r["depth"]) for r in traverse.depths(spark.createDataFrame(rows, "path string, parent string"), "").collect()]
    assert sorted(found, key=str) == sorted([("/a", 1), ("/a", 1), ("/a/b", 2), ("/a/b", 2), ("/a/n", 2), ("/a", 3), ("", 3), (None, 3)], key=str)
    assert traverse.depths(spark.createDataFrame(rows, "path string, parent string"), "/none").collect() == []


def test_depths_of_more_than_a_hundred_levels(spark):
    chain = spark.range(1, 103, 1, 1).selectExpr("'/' || id AS path", "if(id = 1, '', '/' || (id - 1)) AS parent")
    assert sorted((r["depth"], r["path"]) for r in traverse.depths(chain, "").collect()) == [(k, f"/{k}") for k in range(1, 103)]


def test_links(spark):
    e = spark.createDataFrame([("/d", 0o040755, 1)], "path string, mode int, size bigint")
    links = spark.createDataFrame([("/l", 0o120777, 3, "/d"), ("/m", 0o120777, 3, "/none")], "path string, mode int, size bigint, target string")
    assert [(r["path"], r["mode"]) for r in traverse.resolved(links, e, True).collect()] == [("/l", 0o040755)]
    assert traverse.resolved(links, e, False).count() == 2


def test_gap_limits(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 30, 1), (1, 61, 2)], "worker int, ts bigint, seq bigint")
    assert [r["seq"] for r in control.gaps(df, 30).collect()] == [2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq bigint, dev bigint, ok boolean")
    assert devices.folded(none).count() == 0
    assert counters.rates(spark.createDataFrame([], "ts bigint, total bigint")).count() == 0


def test_slices_end_at_the_first_wide_gap(spark):
    ids = [*range(40), *range(91, 120), *range(171, 300)]  # 51 missing, then 51 more
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert sorted(r["id"] for r in counters.slices_before_gap(df).collect()) == list(range(40))
    assert counters.slices_before_gap(df, 51).count() == len(ids)


def test_a_device_with_a_failure_now_and_then_is_healthy(spark):
    rows = [(k, 1, k % 5 != 0) for k in range(1, 100)] + [(k, 2, k < 90) for k in range(1, 100)] + [(k, 3, k < 98) for k in range(1, 100)]
    got = {r["dev"]: (r["state"], r["failures"]) for r in devices.folded(spark.createDataFrame(rows, "seq bigint, dev bigint, ok boolean"), 9).collect()}
    assert got == {1: ("NORMAL", 0), 2: ("CONDEMNED", 10), 3: ("DEAD", 2)}


def test_start_up_takes_longer_than_a_heartbeat(spark):
    rows = [(1, 100, "READY"), (2, 100, "READY"), (2, 101, "HEARTBEAT"), (3, 70, "READY"), (4, 131, "FINISH"), (5, 39, "READY"), (5, 90, "BATCH")]
    events = spark.createDataFrame(rows, "worker int, ts bigint, type string")
    for now, late in ((131, {3: True, 5: True}), (130, {5: True}), (132, {2: True, 3: True, 5: True}), (160, {2: True, 3: True, 5: True}), (161, {1: True, 2: True, 3: True, 5: True})):
        got = {r["worker"]: True for r in control.timeouts(events, F.lit(now)).where("timed_out").collect()}
        assert got == late, now
    assert control.timeouts(events.limit(0), F.lit(1)).count() == 0


def test_panel_lines(spark):
    scan = spark.createDataFrame([(2, 3, 61)], "dirs bigint, files bigint, age bigint")
    state = spark.createDataFrame([(1, 0)], "dead bigint, condemned bigint")
    workers = spark.createDataFrame([(0, "BUSY", "/home/anna/pictures/2020/may", 4), (1, "DEAD", None, 0)], "worker int, state string, path string, open bigint")
    rates = spark.createDataFrame([(1.6, 7.2)], "rate double, peak_rate double")
    probes = spark.createDataFrame([(7, "/mnt/x1")], "dev bigint, path string")
    assert [r["value"] for r in counters.panel(scan, state, workers, rates, probes).collect()] == [
        "directories 2, files 3", "elapsed 0d 00:01:01", "devices dead 1, condemned 0", "workers 1 of 2, tasks pending 4",
        "worker 0 BUSY .../***a/***s/***0/***y", "worker 1 DEAD -", "rate 2 an hour, most 7", "probe of device 7 /***t/***1",
    ]
    assert counters.panel(scan, state, workers.limit(0)).count() == 4
