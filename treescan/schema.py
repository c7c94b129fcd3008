"""Record schemas."""

from __future__ import annotations

ENTRY = (
    "path string, parent string, name string, is_dir boolean, level int, dev bigint, ino bigint, size bigint, "
    "atime bigint, mtime bigint, ctime bigint, uid bigint, gid bigint, mode int"
)
HISTORY = "path string, dev bigint, ino bigint, mtime bigint, d_type int"
LEDGER = HISTORY + ", slice bigint, line bigint"
SKIPPED = "path string, dev bigint, blacklist_time bigint, retry_count int, probe_interval bigint, d_type int, s_status int"
CONTROL = "seq bigint, ts bigint, worker int, type string, dev bigint"

#: What makes two rows the same entry. The path belongs to it, so hard links stay apart.
KEY = ["path", "dev", "ino"]
