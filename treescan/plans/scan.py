"""Whole scans of real trees: full, resumed, semi-incremental."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import template
from ..operators import counters, dedup
from ..sinks import text as sink
from ..sources import filesystem
from ..sources.ledger import Ledger
from ..storage import stored


@dataclass
class Options:
    """What a scan is asked for. skip_interval in seconds, 0 for none."""

    path: str
    form: str | None = None
    switches: dict[str, bool] = field(default_factory=dict)
    csv: bool = False
    quote: bool = False
    include_dirs: bool = False
    follow: bool = False
    output: str | None = None
    output_split: str | None = None
    slice_rows: int = 100_000
    dir_log: str | None = None
    ledger: str | None = None
    resume: bool = False
    skip_interval: int = 0
    archive: bool = False
    clean: bool = False
    now: int | None = None

    def check(self) -> None:
        if self.output and self.output_split:
            raise ValueError("output and output_split exclude each other")
        if self.archive and self.clean:
            raise ValueError("archive and clean exclude each other")
        if self.slice_rows < 1:
            raise ValueError("a slice has one row at least")
        if self.resume and not self.ledger:
            raise ValueError("resuming needs a ledger")
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)

    @property
    def template(self) -> str:
        return self.form if self.form is not None else template.CSV if self.csv else template.from_switches(**self.switches)


@dataclass
class Result:
    """skipped: directories (``path, dev, error``) left out because their device fails; with any, the scan is incomplete."""

    entries: DataFrame
    lines: DataFrame
    dir_count: int
    file_count: int
    skipped: DataFrame
    complete: bool


def scan(spark: SparkSession, o: Options) -> Result:
    """Scan, and write what the options name.

    The ledger gets each level as soon as it is whole. A resumed scan returns what its ledger hasn't seen; one whose first scan broke
    off goes on with the directories that weren't listed, and lists no other. After a scan that succeeded, with a skip
    interval, all entries are returned, and those that history lets trust are not asked for: they have its values
    and zeros. Directories of devices that fail go to the skip ledger, and the session ends as Incomplete.
    """
    o.check()
    ledger = Ledger(spark, o.ledger, o.slice_rows) if o.ledger else None
    succeeded = bool(ledger and o.resume and ledger.succeeded)
    begin = ledger.frontier() if ledger and o.resume else None
    if ledger:
        ledger.start(o.path, o.resume, o.archive, output=o.output, output_split=o.output_split, csv=o.csv, clean=o.clean)
    try:
        letters = template.letters_of(o.template)
        known = stored(ledger.history()) if ledger and o.resume else None
        trust = filesystem.Trust(known, o.now or _now(), o.skip_interval) if succeeded and o.skip_interval > 0 else None
        start = None
        if begin:
            start = filesystem.Start(stored(begin[0]), begin[1])
            ledger.unpark()
        all_rows = trust is not None or known is None
        found, skipped = None, None
        for level, (rows, parked) in enumerate(filesystem.scan_levels(spark, o.path, o.follow, "X" in letters, trust=trust, start=start), begin[1] if begin else 0):
            new = rows if known is None else stored(dedup.unseen(rows, known))
            if ledger:
                ledger.append(new, level)
            if parked is not None:
                if ledger:
                    ledger.park(parked)
                skipped = parked if skipped is None else skipped.unionByName(parked)
            rows = rows if all_rows else new
            found = rows if found is None else found.unionByName(rows)
        complete = skipped is None
        found, skipped = (spark.createDataFrame([], kind) if x is None else x for x, kind in ((found, filesystem.LISTED + ", stat_src string"), (skipped, filesystem.PARKED)))
        rows = dedup.emitted(found, o.include_dirs)
        if letters & {"u", "g"}:
            users, groups = filesystem.owners(spark)
            # names of one machine's accounts, known by now to be few
            rows = rows.join(F.broadcast(users), "uid", "left").join(F.broadcast(groups), "gid", "left")
        lines = sink.lines(rows, o.template, o.csv, o.quote, local=True)
        if o.output:
            sink.write_text(lines, o.output, append=o.resume)
        if o.output_split:
            sink.write_slices(rows.select("path", template.compiled(o.template, o.csv, o.quote, local=True).alias("value")), o.output_split, o.slice_rows, "path")
        if o.dir_log:
            sink.directory_log(found, o.dir_log)
        counts = counters.scan_counts(found).first()
        if ledger:
            if o.output_split:
                n = counts["file_count"] + counts["dir_count"] * o.include_dirs
                ledger.move_cursor(output_slice=-(-n // o.slice_rows), output_line=(n - 1) % o.slice_rows + 1 if n else 0)
            if o.archive and complete:
                ledger.compact()
            ledger.finish(*(() if complete else ("Incomplete", "devices failed")))
            if o.clean and complete:
                ledger.clean()
        return Result(rows, lines, counts["dir_count"], counts["file_count"], skipped, complete)
    except BaseException:
        if ledger:
            ledger.finish("Incomplete", "the scan broke off")
        raise


def _now() -> int:
    import time

    return int(time.time())
