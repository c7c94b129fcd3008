import os
import socket

import pytest
from pyspark.sql import functions as F

from treescan import cli
from treescan.operators import dedup
from treescan.plans.scan import Options, scan
from treescan.sinks import text as sink
from treescan.sources import binary, filesystem
from treescan.sources.ledger import Ledger


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    deep = root
    for k in range(9):
        deep = deep / f"d{k}"
    deep.mkdir(parents=True)
    (deep / "end").write_text("x")
    (root / "empty").mkdir()
    for name in ("a.txt", ".hidden", 'q"u,o'):
        (root / name).write_text(name)
    (root / "ring").symlink_to(root)
    (root / "dangling").symlink_to(root / "none")
    os.mkfifo(root / "pipe")
    return root


@pytest.fixture
def low(tmp_path):
    root = tmp_path / "low"
    (root / "d0" / "d1" / "d2").mkdir(parents=True)
    (root / "d0" / "d1" / "d2" / "end").write_text("x")
    (root / "a.txt").write_text("a")
    (root / "ring").symlink_to(root)
    os.mkfifo(root / "pipe")
    return root


def real(root):
    return sorted(os.path.join(d, x) for d, dirs, files in os.walk(root) for x in dirs + files)


def test_tree_without_following(spark, tree):
    rows = filesystem.scan(spark, str(tree)).collect()
    assert sorted(r["path"] for r in rows) == real(tree)
    assert {r["name"]: r["mode"] >> 12 for r in rows}["ring"] == 10
    assert max(r["level"] for r in rows) == 9


def test_following_drops_dangling_and_ends_rings(spark, tree):
    names = [r["path"] for r in filesystem.scan(spark, str(tree), follow=True).collect()]
    assert f"{tree}/dangling" not in names and f"{tree}/ring" in names and f"{tree}/ring/ring" not in names


def test_targets(spark, tree):
    assert [r["name"] for r in filesystem.scan(spark, f"{tree}/a.txt").collect()] == ["a.txt"]
    assert filesystem.scan(spark, f"{tree}/empty").count() == 0
    assert [r["mode"] >> 12 for r in filesystem.scan(spark, f"{tree}/ring").collect()] == [10]
    with pytest.raises(FileNotFoundError):
        filesystem.scan(spark, f"{tree}/none")


def test_long_paths_are_left_out(tmp_path):
    name = "n" * 250
    here = os.open(tmp_path, os.O_RDONLY)
    at, fds = str(tmp_path), [here]
    while len(at) + 1 + len(name) < 4096:
        os.mkdir(name, dir_fd=fds[-1])
        fds.append(os.open(name, os.O_RDONLY, dir_fd=fds[-1]))
        at += f"/{name}"
    rest = 4095 - len(at) - 1
    if rest > 0:
        for size in (rest, min(255, rest + 1)):
            os.close(os.open("x" * size, os.O_CREAT | os.O_WRONLY, dir_fd=fds[-1]))
        assert {len(r[0]) for r in filesystem.listed(at)} <= {4095}
    for f in fds:
        os.close(f)


def test_resume_trust_and_clean(spark, low, tmp_path):
    base, path = str(tmp_path / "ledger"), str(low)
    first = scan(spark, Options(path, ledger=base, include_dirs=True))
    assert first.dir_count + first.file_count == len(real(low)) == first.lines.count()
    again = scan(spark, Options(path, ledger=base, resume=True))
    assert again.dir_count + again.file_count == 0
    (low / "new").write_text("n")
    fresh = scan(spark, Options(path, ledger=base, resume=True, archive=False))
    assert [r["name"] for r in fresh.entries.collect()] == ["new"]
    late = scan(spark, Options(path, ledger=base, resume=True, skip_interval=60, now=2**33, include_dirs=True))
    sources = {r["name"]: r["stat_src"] for r in late.entries.collect()}
    # a listing doesn't tell a pipe's type, so it is asked for
    assert {k for k, v in sources.items() if v != "history"} == {"pipe"} and late.entries.count() == len(real(low))
    with pytest.raises(ValueError):
        scan(spark, Options(str(low / "d0"), ledger=base, resume=True))
    scan(spark, Options(path, ledger=base, clean=True))
    assert not Ledger(spark, base).runs


def test_listing_asks_for_no_status(tree, monkeypatch):
    asked = []
    monkeypatch.setattr(os, "lstat", lambda *a, **b: asked.append(a))
    rows = list(filesystem.named(str(tree), 1))
    assert not asked and {r[2]: r[5] for r in rows} == {"a.txt": 8, ".hidden": 8, 'q"u,o': 8, "ring": 10, "dangling": 10, "pipe": 0, "empty": 4, "d0": 4}
    monkeypatch.undo()
    assert all(r[4] == os.lstat(r[0]).st_ino and r[3] == os.lstat(r[0]).st_dev for r in rows)


def test_a_scan_that_broke_off_goes_on(spark, low, tmp_path):
    base, path = str(tmp_path / "ledger"), str(low)
    ledger = Ledger(spark, base)
    ledger.start(path, resume=False)
    levels = filesystem.scan_levels(spark, path)
    for k in range(2):
        ledger.append(next(levels)[0], k)
    with open(f"{base}/lock", "w") as f:  # of a process that is gone
        f.write(f"{socket.gethostname()} 999999999")
    frontier, level = ledger.frontier()
    assert {r["path"] for r in frontier.collect()} == {f"{low}/d0/d1"} and level == 2
    (low / "later").write_text("in a directory that was listed: not listed again")
    rest = scan(spark, Options(path, ledger=base, resume=True, include_dirs=True))
    below = [x for x in real(low) if x.startswith(f"{low}/d0/d1/")]
    assert sorted(r["path"] for r in rest.entries.collect()) == below and rest.complete
    assert ledger.frontier() is None and {r["level"] for r in ledger.runs} == set(range(4))
    assert [r["name"] for r in scan(spark, Options(path, ledger=base, resume=True)).entries.collect()] == ["later"]


def test_devices_that_fail(spark, low, tmp_path, monkeypatch):
    """A directory whose device fails is parked, the scan is incomplete, and a resumed one goes on there."""
    base, path, bad = str(tmp_path / "ledger"), str(low), f"{low}/d0/d1"
    listing = filesystem.list_frontier

    def failing(frontier):
        rows = listing(frontier.where(F.col("path") != bad))
        lost = frontier.where(F.col("path") == bad).selectExpr("path", "'' parent", "'' name", "dev", "0L ino", "4 d_type", "'EIO' error")
        return rows.unionByName(lost)

    monkeypatch.setattr(filesystem, "list_frontier", failing)
    broken = scan(spark, Options(path, ledger=base, include_dirs=True))
    assert not broken.complete and [(r["path"], r["error"]) for r in broken.skipped.collect()] == [(bad, "EIO")]
    ledger = Ledger(spark, base)
    assert ledger.session["status"] == "Incomplete" and [r["path"] for r in ledger.parked().collect()] == [bad]
    with pytest.raises(OSError):
        filesystem.scan(spark, path)
    monkeypatch.undo()
    rest = scan(spark, Options(path, ledger=base, resume=True, include_dirs=True))
    assert sorted(r["path"] for r in rest.entries.collect()) == [x for x in real(low) if x.startswith(bad + "/")] and rest.complete
    assert ledger.parked().count() == 0 and ledger.succeeded


def test_device_errors_are_told_from_others(tmp_path, monkeypatch):
    import errno

    def fails(code):
        def stat(*_, **__):
            raise OSError(code, "x")
        return stat

    for code, rows in ((errno.EIO, 1), (errno.ETIMEDOUT, 1), (errno.EACCES, 0), (errno.ENOENT, 0)):
        monkeypatch.setattr(os, "scandir", fails(code))
        got = list(filesystem.named(str(tmp_path), 7))
        assert len(got) == rows and all(r[0] == str(tmp_path) and r[3] == 7 and r[6] == errno.errorcode[code] for r in got)


def test_ledger_slices_lock_and_compaction(spark, tree, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), 5)
    entries = filesystem.scan(spark, str(tree))
    ledger.start(str(tree), resume=False)
    with pytest.raises(RuntimeError):
        Ledger(spark, ledger.base).start(str(tree), resume=True)
    n = ledger.append(entries)
    ledger.append(entries)
    ledger.finish()
    rows = ledger.read().collect()
    assert len(rows) == 2 * n and max(r["line"] for r in rows) == 4
    assert {r["slice"] for r in rows} == set(range(2 * -(-n // 5)))
    before = ledger.history().count()
    ledger.compact()
    assert len(ledger.runs) == 1 and ledger.history().count() == before == n
    assert dedup.unseen(entries, ledger.history()).count() == 0


def test_slices_have_their_lines(spark, tmp_path):
    rows = spark.range(10).selectExpr("lpad(cast(id as string), 2, '0') value")
    sink.write_slices(rows, str(tmp_path / "s"), 5)
    assert sorted(os.listdir(tmp_path / "s"))[-2:] == ["slice=1", "slice=2"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "s/slice=2")).collect()] == ["05", "06", "07", "08", "09"]


def test_byte_records(spark, tmp_path):
    body = b"".join(binary.record(f"/p{k}", 1, k, 5, 8) for k in range(3))
    (tmp_path / "run_000004.pbin").write_bytes(body + binary.footer(3))
    (tmp_path / "run_000005.pbin").write_bytes(body[:-3])
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = binary.read_slices(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r["slice"], r["line"], r["path"]) for r in rows) == [(4, k, f"/p{k}") for k in range(3)] + [(5, k, f"/p{k}") for k in range(2)]
    assert len(list(binary.records(body, 1))) == 1


def test_command_line(spark, tree, capsys):
    assert cli.main(["-p", str(tree), "-F", "%t %p", "-D"]) == 0
    assert len(capsys.readouterr().out.splitlines()) == len(real(tree))
    for bad in (["-p", str(tree), "-o", "a", "-O", "b"], ["-p", str(tree), "-Z", "-C"], ["-p", "/none/here"], ["-p", str(tree), "-R", "x"]):
        with pytest.raises(SystemExit):
            cli.options(bad)


def test_cursor_and_status_lines(spark, low, tmp_path):
    base = str(tmp_path / "state")
    scan(spark, Options(str(low), ledger=base, output_split=str(tmp_path / "out"), slice_rows=2))
    ledger = Ledger(spark, base, 2)
    files, n = 4, len(real(low))
    at = ledger.cursor
    assert (at.entries, at.output_slice, at.output_line) == (n, files // 2, 2) and at.slice == ledger.runs[-1]["last_slice"]
    keys = [x.partition("=")[0] for x in ledger.settings]
    assert keys == ["path", "output_split", "start_time", "archive", "clean", "csv", "status", "status", "end_time"]
    assert [x for x in ledger.settings if x.startswith("status")] == ["status=Running", "status=Success"]
    for broken in ("1 2 3 4", "1 2 x 4 5", ""):
        (tmp_path / "state" / "cursor").write_text(broken)
        assert ledger.cursor is None
    ledger.clean()
    assert ledger.cursor is None and ledger.settings == []
