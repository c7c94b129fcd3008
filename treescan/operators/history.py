"""Semi-incremental scans: trust what history knows of an entry instead of asking again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modes import d_type, type_bits
from ..functions.template import NO_FLAGS
from ..schema import KEY
from .dedup import last_wins

DAY = 86_400


def latest(ledger: DataFrame, order: list[str]) -> DataFrame:
    """What the last row of each key says."""
    return last_wins(ledger, order).select(*KEY, "mtime", "d_type")


def marked(entries: DataFrame, history: DataFrame, as_of: int, skip_interval: int, kind: Column | None = None) -> DataFrame:
    """`entries` with ``trusted`` and, where it is, the known ``known_mtime, known_type``.

    An entry is trusted if its type is known, its inode isn't 0, history has its key with the same
    type, and its known mtime is more than `skip_interval` seconds before `as_of`. No interval, no trust. kind: the
    entry's type (0: unknown), by default that of its ``mode``; a listing knows it without the mode.
    """
    known = history.select(*KEY, F.col("mtime").alias("known_mtime"), F.col("d_type").alias("known_type"))
    kind = d_type(F.col("mode")) if kind is None else kind
    old = (F.lit(as_of) - F.col("known_mtime") > skip_interval) & F.lit(skip_interval > 0)
    trust = old & (kind != 0) & (F.col("ino") != 0) & (kind == F.col("known_type"))
    return entries.join(known, KEY, "left").withColumn("trusted", F.coalesce(trust, F.lit(False)))


def trusted_rows(entries: DataFrame, history: DataFrame, as_of: int, skip_interval: int) -> DataFrame:
    """`entries` with ``stat_src``: for trusted ones ``history``, the known mtime and type, zeros for the rest."""
    rows = marked(entries, history, as_of, skip_interval)
    own = {"mtime": F.col("known_mtime"), "mode": type_bits(F.col("known_type"))}
    zero = F.lit(0)
    columns = [
        F.when(F.col("trusted"), own.get(c, zero)).otherwise(F.col(c)).cast(entries.schema[c].dataType).alias(c)
        if c in ("size", "atime", "mtime", "ctime", "uid", "gid", "mode") else F.col(c)
        for c in entries.columns
    ]
    return rows.select(*columns, F.when(F.col("trusted"), "history").otherwise("stat").alias("stat_src"))


def from_history(names: DataFrame, schema: str) -> DataFrame:
    """Trusted names of :func:`marked` as rows of `schema` with ``stat_src``: the known mtime and type, zeros and no flags for what wasn't asked."""
    own = {"mtime": F.col("known_mtime"), "mode": type_bits(F.col("known_type")), "is_dir": F.col("known_type") == 4, "d_type": F.col("known_type"), "xattr": F.lit(NO_FLAGS)}
    fields = [x.split() for x in schema.split(", ")]
    kept = ("path", "parent", "name", "dev", "ino")
    return names.select(*[(F.col(n) if n in kept else own.get(n, F.lit(0))).cast(k).alias(n) for n, k in fields], F.lit("history").alias("stat_src"))
