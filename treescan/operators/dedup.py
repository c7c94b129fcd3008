"""Bags to sets: first wins, last wins, anti- and semi-joins on an entry's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY


def first_wins(df: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """One row for each key: that which comes first in `order`. Partial sums on the map side."""
    key = key or KEY
    rest = [c for c in df.columns if c not in key and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*key).agg(least).select(*key, *[F.col(f"_first.{c}").alias(c) for c in df.columns if c not in key])


def last_wins(df: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """One row for each key: that which comes last in `order`."""
    key = key or KEY
    rest = [c for c in df.columns if c not in key and c not in order]
    most = F.max(F.struct(*order, *rest)).alias("_last")
    return df.groupBy(*key).agg(most).select(*key, *[F.col(f"_last.{c}").alias(c) for c in df.columns if c not in key])


def unseen(df: DataFrame, seen: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose key isn't in `seen`."""
    return df.join(seen.select(*(key or KEY)), key or KEY, "left_anti")


def seen_before(df: DataFrame, seen: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows whose key is in `seen`."""
    return df.join(seen.select(*(key or KEY)), key or KEY, "left_semi")


def within_limits(df: DataFrame, limit: int = 4096) -> DataFrame:
    """Without ``.`` and ``..``, and without paths of `limit` bytes or more."""
    return df.where(~F.col("name").isin(".", "..") & (F.octet_length("path") < limit))


def emitted(df: DataFrame, include_dirs: bool) -> DataFrame:
    keep: Column = F.lit(include_dirs) | ~F.col("is_dir")
    return df.where(keep)
