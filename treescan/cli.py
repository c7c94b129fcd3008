"""Command line: ``python -m treescan.cli -p FOLDER [options]``."""

from __future__ import annotations

import argparse
import logging
import sys

from .functions.template import SWITCHES
from .plans.scan import Options, scan
from .sinks.text import printed

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="treescan", description="Lists a folder's tree, one line an entry.")
    a = p.add_argument
    a("-p", "--path", required=True)
    a("-f", "--progress-file", metavar="FOLDER", help="the ledger")
    a("-c", "--continue", dest="resume", action="store_true")
    a("--runone", action="store_true", help="a full scan, whatever the ledger has")
    a("-y", "--yes", action="store_true", help="no effect: nothing is asked")
    a("--skip-interval", type=int, default=0, metavar="SECONDS")
    a("--batch-size", type=int, default=1024)
    a("--estimated-files", type=int, help="no effect: sets grow as they need")
    a("--master-threads", type=int, help="shuffle partitions")
    a("--worker-count", type=int, help="parallel tasks")
    a("-t", "--timeout", type=int, default=30)
    a("-o", "--output")
    a("-O", "--output-split")
    a("--max-slice", type=int, default=100_000)
    a("--csv", action="store_true")
    a("-Q", "--quote", action="store_true")
    a("-D", "--dirs", action="store_true")
    a("-d", "--print-dir", metavar="FOLDER")
    a("-M", "--mute", action="store_true")
    a("-F", "--format")
    for name in SWITCHES:
        a(f"--{name}", action="store_true")
    a("--follow-symlinks", action="store_true")
    a("-Z", "--archive", action="store_true")
    a("-C", "--clean", action="store_true")
    a("-R", "--resume-from", help="reserved")
    a("-X", "--decompress", action="store_true", help="reserved")
    a("-v", "--verbose", action="store_true")
    a("--verbose-type", choices=("full", "versioned"), default="full")
    a("--verbose-level", type=int, default=0)
    a("-V", "--version", action="version", version=VERSION)
    return p


def options(argv: list[str]) -> tuple[Options, argparse.Namespace]:
    p = parser()
    n = p.parse_args(argv)
    if n.resume_from or n.decompress:
        p.error("reserved")
    o = Options(
        path=n.path, form=n.format, switches={k: True for k in SWITCHES if getattr(n, k)}, csv=n.csv, quote=n.quote, include_dirs=n.dirs,
        follow=n.follow_symlinks, output=n.output, output_split=n.output_split, slice_rows=n.max_slice, dir_log=None if n.mute else n.print_dir,
        ledger=n.progress_file, resume=n.resume and not n.runone, skip_interval=n.skip_interval, archive=n.archive, clean=n.clean,
    )
    try:
        o.check()
    except (ValueError, FileNotFoundError) as e:
        p.error(str(e))
    return o, n


def main(argv: list[str] | None = None) -> int:
    o, n = options(sys.argv[1:] if argv is None else argv)
    logging.basicConfig(level=logging.INFO if n.verbose or n.verbose_level else logging.WARNING, stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    b = SparkSession.builder.appName("treescan").config("spark.sql.execution.arrow.maxRecordsPerBatch", n.batch_size)
    if n.worker_count:
        b = b.master(f"local[{n.worker_count}]")
    if n.master_threads:
        b = b.config("spark.sql.shuffle.partitions", n.master_threads)
    result = scan(b.getOrCreate(), o)
    if not (o.output or o.output_split):
        for line in printed(result.lines):
            print(line)
    logging.info("%d directories, %d files", result.dir_count, result.file_count)
    if not result.complete:
        for row in result.skipped.toLocalIterator():
            logging.error("not scanned: %s (device %d, %s)", row["path"], row["dev"], row["error"])
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
