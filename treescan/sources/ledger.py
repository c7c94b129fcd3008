"""The ledger of a scan: what was seen, in which run, with a manifest and the session's settings.

A run's rows are one Parquet folder, committed by renaming nothing: the manifest names the runs that
count, and a run that died is not in it. Compaction writes one folder from all and names it alone.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.modes import d_type
from ..operators.history import latest
from ..operators.ranking import numbered
from ..schema import HISTORY, KEY, LEDGER, SKIPPED


@dataclass(frozen=True)
class Cursor:
    """How far a scan came: the last slice and its lines, entries in all, and the last slice of output and its lines."""

    slice: int = 0
    line: int = 0
    entries: int = 0
    output_slice: int = 0
    output_line: int = 0


class Ledger:
    """A ledger below a local or mounted folder `base`."""

    def __init__(self, spark: SparkSession, base: str, slice_rows: int = 100_000):
        if slice_rows < 1:
            raise ValueError("a slice has one row at least")
        self.spark, self.base, self.slice_rows = spark, base, slice_rows

    # settings and manifest are small JSON files, replaced whole

    def _read(self, name: str) -> dict:
        try:
            with open(f"{self.base}/{name}", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {}

    def _replace(self, name: str, value: dict) -> None:
        self._replace_text(name, json.dumps(value))

    def _replace_text(self, name: str, value: str) -> None:
        os.makedirs(self.base, exist_ok=True)
        temporary = f"{self.base}/.{name}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(value)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, f"{self.base}/{name}")

    @property
    def session(self) -> dict:
        return self._read("session.json")

    @property
    def runs(self) -> list[dict]:
        return self._read("manifest.json").get("runs", [])

    @property
    def cursor(self) -> Cursor | None:
        """Where the scan is; none if the file isn't there or hasn't five whole numbers."""
        try:
            with open(f"{self.base}/cursor", encoding="utf-8") as f:
                numbers = f.read().split()[:5]
        except FileNotFoundError:
            return None
        return Cursor(*map(int, numbers)) if len(numbers) == 5 and all(x.isdecimal() for x in numbers) else None

    def move_cursor(self, **at: int) -> None:
        self._replace_text("cursor", " ".join(map(str, astuple(replace(self.cursor or Cursor(), **at)))) + "\n")

    @property
    def settings(self) -> list[str]:
        """Lines ``key=value``: a session's settings, and below them how it went."""
        try:
            with open(f"{self.base}/settings", encoding="utf-8") as f:
                return f.read().splitlines()
        except FileNotFoundError:
            return []

    def _note(self, lines: list[str], **values) -> None:
        said = [f"{k}={int(v) if isinstance(v, bool) else v}" for k, v in values.items() if v is not None]
        self._replace_text("settings", "".join(f"{x}\n" for x in lines + said))

    def start(self, path: str, resume: bool, archive: bool = False, **settings) -> None:
        """Begin a session; a resumed one must be of the same path and archive setting. One scan at a time."""
        old = self.session
        if resume and old:
            for name, now in (("path", path), ("archive", archive)):
                if old.get(name) != now:
                    raise ValueError(f"the ledger is of {name} {old.get(name)!r}, not {now!r}")
        os.makedirs(self.base, exist_ok=True)
        self._take_lock()
        if not resume:
            self._replace("manifest.json", {"runs": []})
            self.move_cursor(**vars(Cursor()))
        # of a first scan, which goes on where it broke off; its runs are whole levels
        first = not self.runs or bool(old.get("first") and old.get("status") != "Success")
        self._replace("session.json", {**settings, "path": path, "archive": archive, "first": first, "status": "Running", "start_time": int(time.time())})
        say = settings.get
        self._note([], path=path, output=say("output"), output_split=say("output_split"), start_time=self.session["start_time"], archive=archive, clean=say("clean"), csv=say("csv"), status="Running")

    def _take_lock(self) -> None:
        """One scan at a time; the lock of a process of this machine that is gone is taken over."""
        path, own = f"{self.base}/lock", f"{socket.gethostname()} {os.getpid()}"
        for _ in range(2):
            try:
                with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(own)
                return
            except FileExistsError:
                with open(path, encoding="utf-8") as f:
                    host, _, pid = f.read().partition(" ")
                if host != socket.gethostname() or not pid.isdigit() or os.path.exists(f"/proc/{pid}"):
                    break
                os.remove(path)
        raise RuntimeError(f"another scan holds {path}")

    def finish(self, status: str = "Success", error: str | None = None) -> None:
        end = int(time.time())
        self._replace("session.json", {**self.session, "status": status, "end_time": end, **({"error": error} if error else {})})
        self._note(self.settings, status=status, error=error, end_time=end)
        self.release()

    def release(self) -> None:
        if os.path.exists(f"{self.base}/lock"):
            os.remove(f"{self.base}/lock")

    @property
    def succeeded(self) -> bool:
        return self.session.get("status") == "Success"

    def append(self, entries: DataFrame, level: int | None = None) -> int:
        """Add a run's entries as slices of `slice_rows` rows, numbered on from those there are. No rows, no run. level: theirs, if
        they are all there is of one."""
        first = 1 + max((r["last_slice"] for r in self.runs), default=-1)
        name = f"run-{uuid.uuid4().hex}"
        rows = entries.select(*KEY, "mtime", d_type(F.col("mode")).alias("d_type"))
        at = F.col("rn") - 1
        placed = numbered(rows, *KEY).select(*KEY, "mtime", "d_type", (F.floor(at / self.slice_rows) + first).alias("slice"), (at % self.slice_rows).alias("line"))
        placed.write.parquet(f"{self.base}/{name}")
        n = self.spark.read.parquet(f"{self.base}/{name}").count()
        if n:
            run = {"name": name, "rows": n, "first_slice": first, "last_slice": first + (n - 1) // self.slice_rows, "level": level}
            self._replace("manifest.json", {**self._read("manifest.json"), "runs": [*self.runs, run]})
            self.move_cursor(slice=run["last_slice"], line=(n - 1) % self.slice_rows + 1, entries=sum(r["rows"] for r in self.runs))
        return n

    def park(self, directories: DataFrame) -> int:
        """Add directories (``path, dev``) that wait for their device to the skip ledger."""
        name = f"skipped-{uuid.uuid4().hex}"
        rows = directories.select("path", "dev", F.lit(int(time.time())).cast("bigint").alias("blacklist_time"), F.lit(0).alias("retry_count"), F.lit(5).cast("bigint").alias("probe_interval"), F.lit(4).alias("d_type"), F.lit(0).alias("s_status"))
        rows.write.parquet(f"{self.base}/{name}")
        n = self.spark.read.parquet(f"{self.base}/{name}").count()
        if n:
            manifest = self._read("manifest.json")
            self._replace("manifest.json", {**manifest, "runs": self.runs, "skipped": [*manifest.get("skipped", []), name]})
        return n

    def parked(self) -> DataFrame:
        """The skip ledger: a row for each directory that waits."""
        paths = [f"{self.base}/{x}" for x in self._read("manifest.json").get("skipped", [])]
        return self.spark.read.schema(SKIPPED).parquet(*paths).dropDuplicates(["path"]) if paths else self.spark.createDataFrame([], SKIPPED)

    def unpark(self) -> None:
        """Forget the directories that waited: they are in a frontier again."""
        self._replace("manifest.json", {**self._read("manifest.json"), "runs": self.runs, "skipped": []})

    def frontier(self) -> tuple[DataFrame, int] | None:
        """Of a first scan that broke off: the directories (``path, dev``) that weren't listed yet, and their entries' level.

        They are those of the last level that is in the ledger, and those that wait for a device without being condemned.
        """
        old = self.session
        levels = [r["level"] for r in self.runs]
        if not self.runs or None in levels or not old.get("first") or old.get("status") == "Success":
            return None
        last = self.spark.read.schema(LEDGER).parquet(*[f"{self.base}/{r['name']}" for r in self.runs if r["level"] == max(levels)])
        waiting = self.parked().where("s_status != 1")
        return last.where("d_type = 4").select("path", "dev").unionByName(waiting.select("path", "dev")).distinct(), max(levels) + 1

    def read(self) -> DataFrame:
        """All rows, with ``slice, line``."""
        paths = [f"{self.base}/{r['name']}" for r in self.runs]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def history(self) -> DataFrame:
        """The last row of each entry."""
        rows = self.read()
        return latest(rows, ["slice", "line"]) if self.runs else self.spark.createDataFrame([], HISTORY)

    def compact(self) -> None:
        """One run from all, with zstd."""
        old = self.runs
        if len(old) < 2:
            return
        name = f"run-{uuid.uuid4().hex}"
        self.read().write.option("compression", "zstd").parquet(f"{self.base}/{name}")
        n = self.spark.read.parquet(f"{self.base}/{name}").count()
        if n != sum(r["rows"] for r in old):
            raise RuntimeError(f"compaction wrote {n} rows of {sum(r['rows'] for r in old)}")
        run = {"name": name, "rows": n, "first_slice": old[0]["first_slice"], "last_slice": max(r["last_slice"] for r in old), "level": None}
        self._replace("manifest.json", {**self._read("manifest.json"), "runs": [run]})

    def clean(self) -> None:
        """Remove the ledger."""
        import shutil

        for r in self.runs:
            shutil.rmtree(f"{self.base}/{r['name']}", ignore_errors=True)
        for name in ("manifest.json", "session.json", "cursor", "settings", "lock"):
            if os.path.exists(f"{self.base}/{name}"):
                os.remove(f"{self.base}/{name}")
