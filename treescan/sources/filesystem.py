"""Real trees: a data source that lists the frontier's directories in parallel, and a scan by levels.

``spark.read.format("treescan_dirs")`` takes directories and lists them; each partition has a share
of them. What the executors see must be the same file system (a shared mount).
"""

from __future__ import annotations

import errno
import fcntl
import os
import stat
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.modes import FLAGS
from ..functions.template import NO_FLAGS
from ..operators.devices import DEVICE_ERRORS
from ..operators.history import from_history, marked
from ..schema import ENTRY
from ..storage import stored

LISTED = ENTRY + ", d_type int, xattr string"
PARKED = "path string, dev bigint, error string"
LIMIT = 4096
# The request that reads inode flags, and the bits of `FLAGS` in its answer.
GET_FLAGS = 0x80086601
FLAG_BITS = dict(zip(FLAGS, (0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x1000, 0x800, 0x4000, 0x10000, 0x40000, 0x80000, 0x2000, 0x8000), strict=True))


def flags_of(path: str, mode: int) -> str:
    """Sixteen flag letters, or why they can't be had."""
    if not (stat.S_ISREG(mode) or stat.S_ISDIR(mode)):
        return NO_FLAGS
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NONBLOCK)
    except OSError:
        return "[access_denied] "
    try:
        bits = struct.unpack("L", fcntl.ioctl(fd, GET_FLAGS, struct.pack("L", 0)))[0]
    except OSError:
        return "[ioctl_error]   "
    finally:
        os.close(fd)
    return "".join(x if bits & b else "-" for x, b in FLAG_BITS.items())


def stat_row(path: str, parent: str, name: str, follow: bool, xattr: bool = False) -> tuple:
    """An entry's row."""
    s = os.stat(path) if follow else os.lstat(path)
    is_dir, kind = stat.S_ISDIR(s.st_mode), s.st_mode >> 12
    ino = s.st_ino if s.st_ino < 1 << 63 else s.st_ino - (1 << 64)
    times = (int(s.st_atime), int(s.st_mtime), int(s.st_ctime))
    return (path, parent, name, is_dir, 0, s.st_dev, ino, s.st_size, *times, s.st_uid, s.st_gid, s.st_mode, kind, flags_of(path, s.st_mode) if xattr else NO_FLAGS)


def listed(directory: str, follow: bool = False, xattr: bool = False) -> Iterator[tuple]:
    """Rows of a directory's entries. What can't be listed or asked for is left out, and so are paths of 4096
    bytes or more. Names that aren't UTF-8 have replacement characters."""
    try:
        names = os.scandir(directory)
    except OSError:
        return
    with names:
        for e in names:
            path = f"{directory}/{e.name}"
            if len(os.fsencode(path)) >= LIMIT:
                continue
            try:
                yield _readable(stat_row(path, directory, e.name, follow, xattr))
            except OSError:
                continue


class _Share(InputPartition):
    def __init__(self, directories: list[str]):
        self.directories = directories


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.directories = options.get("directories", "").split("\0")
        self.follow = options.get("followsymlinks", "false") == "true"
        self.xattr = options.get("xattr", "false") == "true"
        self.shares = int(options.get("shares", "8"))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.shares, len(self.directories)))
        return [_Share(self.directories[k::n]) for k in range(n)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for directory in partition.directories:
            yield from listed(directory, self.follow, self.xattr)


class DirectorySource(DataSource):
    """Lists the directories in option ``directories`` (parted by NUL)."""

    @classmethod
    def name(cls) -> str:
        return "treescan_dirs"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


NAMED = "path string, parent string, name string, dev bigint, ino bigint, d_type int, error string"
ASKED = LISTED + ", error string"


def named(directory: str, dev: int) -> Iterator[tuple]:
    """A directory's names with what listing tells of them (inode, and the type of files, directories and links; else 0), without
    asking for any entry's status. A directory on a device that fails gives one row with the error and its own path."""
    try:
        own = os.stat(directory).st_dev
        with os.scandir(directory) as found:
            for e in found:
                path = f"{directory}/{e.name}"
                if len(os.fsencode(path)) < LIMIT:
                    kind = 10 if e.is_symlink() else 4 if e.is_dir(follow_symlinks=False) else 8 if e.is_file(follow_symlinks=False) else 0
                    ino = e.inode()
                    yield (path, directory, e.name, own, ino if ino < 1 << 63 else ino - (1 << 64), kind, None)
    except OSError as e:
        if device_error(e):
            yield (directory, os.path.dirname(directory), os.path.basename(directory), dev, 0, 4, errno.errorcode[e.errno])


def device_error(e: OSError) -> bool:
    return errno.errorcode.get(e.errno) in DEVICE_ERRORS


def _readable(row: tuple) -> tuple:
    return tuple(x.encode("utf-8", "replace").decode() if isinstance(x, str) else x for x in row)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]

    def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while chunk := [r for _, r in zip(range(1024), rows, strict=False)]:
            cols = zip(*chunk, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    return batches


def list_frontier(frontier: DataFrame) -> DataFrame:
    """`NAMED` rows of the directories in ``path, dev``: each task lists those it has, so the frontier never comes to the driver."""
    batched = _arrow(NAMED)

    def run(batches):
        for batch in batches:
            for directory, dev in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from batched(_readable(r) for r in named(directory, dev))

    return frontier.select("path", "dev").mapInArrow(run, NAMED)


def asked(names: DataFrame, follow: bool = False, xattr: bool = False) -> DataFrame:
    """`ASKED` rows of `NAMED` entries; an error of a listing comes along. What is gone or may not be asked for is left out; where the device
    fails, a row has the error and the path of the directory."""
    batched = _arrow(ASKED)
    nulls = (None,) * len(LISTED.split(", "))

    def rows(batch):
        for path, parent, name, dev, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if error:
                yield (path, *nulls[1:5], dev, *nulls[6:], error)
                continue
            try:
                yield (*_readable(stat_row(path, parent, name, follow, xattr)), None)
            except OSError as e:
                if device_error(e):
                    yield (parent, *nulls[1:5], dev, *nulls[6:], errno.errorcode[e.errno])

    def run(batches):
        for batch in batches:
            yield from batched(rows(batch))

    return names.select("path", "parent", "name", "dev", "error").mapInArrow(run, ASKED)


@dataclass
class Trust:
    """What history (``path, dev, ino, mtime, d_type``, a row for each key) lets a scan trust instead of asking."""

    history: DataFrame
    as_of: int
    skip_interval: int


@dataclass
class Start:
    """Where a scan goes on: directories (``path, dev``) at a level."""

    frontier: DataFrame
    level: int


def scan_levels(
    spark: SparkSession, path: str, follow: bool = False, xattr: bool = False, visited: DataFrame | None = None,
    trust: Trust | None = None, start: Start | None = None, shares: int | None = None,
) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """Level by level the entries (`LISTED` and ``stat_src``), and the directories (``path, dev, error``) that weren't
    scanned because their device fails (None: none).

    A directory is listed first. Entries that `trust` covers have the known mtime and type and zeros and are
    not asked for; all others are. A device with an error is left alone for the rest of the scan: its directories
    are parked. A level's rows are stored before it is yielded.
    """
    shares = shares or spark.sparkContext.defaultParallelism
    if start is None:
        root = stat_row(path, os.path.dirname(path), os.path.basename(path), follow, xattr)
        if not root[3]:
            yield spark.createDataFrame([(*_readable(root), "stat")], LISTED + ", stat_src string"), None
            return
        frontier, level = spark.createDataFrame([(path, root[5])], "path string, dev bigint"), 0
        seen = spark.createDataFrame([(root[5], root[6])], "dev bigint, ino bigint")
    else:
        frontier, level = start.frontier, start.level
        seen = spark.createDataFrame([], "dev bigint, ino bigint")
    broken = None  # devices that failed
    while True:
        lost = None
        if broken is not None:
            lost = frontier.join(broken, "dev", "left_semi").select("path", "dev", F.lit("parked").alias("error"))
            frontier = frontier.join(broken, "dev", "left_anti").select("path", "dev")
        names = list_frontier(frontier.repartition(shares, "path"))
        known = None
        if visited is not None:
            names = names.join(visited.select("path", "dev", "ino"), ["path", "dev", "ino"], "left_anti")
        if trust is not None and trust.skip_interval > 0:
            kind = F.when(F.lit(follow) & (F.col("d_type") == 10), 0).otherwise(F.col("d_type"))
            names = stored(marked(names, trust.history, trust.as_of, trust.skip_interval, kind))
            known, names = names.where("trusted"), names.where("not trusted")
        # without such joins a directory is listed and its entries are asked for in one task
        rows = stored(asked(names if visited is None and known is None else names.repartition(shares, "path"), follow, xattr))
        parked = rows.where("error is not null").select("path", "dev", "error")
        parked = parked if lost is None else parked.unionByName(lost)
        level_rows = rows.where("error is null").drop("error").withColumn("stat_src", F.lit("stat"))
        if visited is not None:  # a mount point's own device is known only now
            level_rows = level_rows.join(visited.select("path", "dev", "ino"), ["path", "dev", "ino"], "left_anti").select(*level_rows.columns)
        if known is not None:
            level_rows = level_rows.unionByName(from_history(known, LISTED))
        level_rows = level_rows.withColumn("level", F.lit(level))
        bad, some = bool(parked.take(1)), bool(level_rows.take(1))
        if not some and not bad:
            return
        yield level_rows, parked.dropDuplicates(["path"]) if bad else None
        if bad:
            failed = parked.select("dev")
            broken = stored((failed if broken is None else broken.unionByName(failed)).distinct())  # devices are few
        dirs = level_rows.where("is_dir").select("path", "dev", "ino")
        if follow:
            dirs = dirs.join(seen, ["dev", "ino"], "left_anti").select("path", "dev", "ino")
            seen = stored(seen.unionByName(dirs.select("dev", "ino")).distinct())
        frontier, level = dirs.select("path", "dev"), level + 1


def scan(spark: SparkSession, path: str, follow: bool = False, xattr: bool = False, visited: DataFrame | None = None, shares: int | None = None) -> DataFrame:
    """All entries below `path`, ``level`` from 0; the root is in no row. A target that is no directory is
    the only row. A link given as root is followed if `follow`.

    With `visited` (``path, dev, ino``), entries in it are neither returned nor entered. With `follow`
    rings of links end where the system or the path limit ends them, and directories already on the way are not entered again.
    A device that fails raises an error; :func:`scan_levels` goes on without it.
    """
    out = None
    for rows, parked in scan_levels(spark, path, follow, xattr, visited, shares=shares):
        if parked is not None:
            gone = parked.first()
            raise OSError(f"{gone['path']}: {gone['error']}")
        rows = rows.drop("stat_src")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], LISTED)


def owners(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``uid, user_name`` and ``gid, group_name`` of the driver's machine."""
    import grp
    import pwd

    users = {p.pw_uid: p.pw_name for p in reversed(pwd.getpwall())}
    groups = {g.gr_gid: g.gr_name for g in reversed(grp.getgrall())}
    return (
        spark.createDataFrame(list(users.items()), "uid bigint, user_name string"),
        spark.createDataFrame(list(groups.items()), "gid bigint, group_name string"),
    )
