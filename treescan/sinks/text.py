"""Text and CSV output: one folder, or slices of so many lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import template
from ..operators.ranking import numbered


def lines(entries: DataFrame, form: str = template.DEFAULT, csv: bool = False, quote: bool = False, local: bool = False) -> DataFrame:
    """One column ``value``."""
    return entries.select(template.compiled(form, csv, quote, local).alias("value"))


def write_text(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.select("value").write.mode("append" if append else "overwrite").text(path)


def write_slices(rows: DataFrame, path: str, slice_rows: int = 100_000, *order: str) -> None:
    """Folders ``slice=1``, ``slice=2`` ... of `slice_rows` lines each, in the order of the columns named (default: the lines).
    There is no empty last one."""
    if slice_rows < 1:
        raise ValueError("a slice has one row at least")
    placed = numbered(rows, *(order or ("value",)))
    placed = placed.select("value", "rn", (F.floor((F.col("rn") - 1) / slice_rows) + 1).alias("slice"))
    # a slice is a task's work; its rows are as many as the caller said
    placed.repartition("slice").sortWithinPartitions("slice", "rn").select("value", "slice").write.mode("overwrite").partitionBy("slice").text(path)


def directory_log(entries: DataFrame, path: str) -> None:
    """A line for each directory."""
    entries.where("is_dir").select(F.concat(F.lit("目录: "), "path").alias("value")).write.mode("overwrite").text(path)


def printed(rows: DataFrame) -> Iterator[str]:
    """Lines one partition at a time."""
    return (r["value"] for r in rows.select("value").toLocalIterator())
