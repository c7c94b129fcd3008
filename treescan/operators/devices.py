"""Devices that fail: states from control events, blacklists, requeues, probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Errors that tell of a device rather than of one entry.
DEVICE_ERRORS = ("ETIMEDOUT", "EIO")


def folded(events: DataFrame, condemn_after: int = 3) -> DataFrame:
    """``dev, state, failures`` after all of ``seq, dev, ok``.

    A failure makes a device DEAD and a success NORMAL; `condemn_after` failures in a row make it
    CONDEMNED for good. Streaks are found by counting the successes before: a count and a
    running sum per device.
    """
    by = Window.partitionBy("dev").orderBy("seq")
    runs = events.withColumn("run", F.sum(F.col("ok").cast("int")).over(by))
    streaks = runs.where("not ok").groupBy("dev", "run").agg(F.count("*").alias("n"))
    worst = streaks.groupBy("dev").agg(F.max("n").alias("worst"))
    last = runs.groupBy("dev").agg(F.max_by("ok", "seq").alias("ok"), F.max("run").alias("run"))
    now = last.join(streaks, ["dev", "run"], "left").join(worst, "dev", "left")
    state = F.when(F.coalesce("worst", F.lit(0)) >= condemn_after, "CONDEMNED").when(F.col("ok"), "NORMAL").otherwise("DEAD")
    return now.select("dev", state.alias("state"), F.coalesce("n", F.lit(0)).cast("bigint").alias("failures"))


def with_state(entries: DataFrame, devices: DataFrame) -> DataFrame:
    """`entries` with their device's state, NORMAL where none is known. Devices are few: the planner broadcasts them by size."""
    return entries.join(devices.select("dev", "state"), "dev", "left").withColumn("state", F.coalesce("state", F.lit("NORMAL")))


def reachable(entries: DataFrame, devices: DataFrame) -> DataFrame:
    """Entries that aren't on a dead or condemned device."""
    return entries.join(devices.where(F.col("state").isin("DEAD", "CONDEMNED")).select("dev"), "dev", "left_anti")


def requeued(skipped: DataFrame, recovered: DataFrame) -> DataFrame:
    """Parked directories of devices that came back, without condemned ones."""
    return skipped.where("s_status != 1").join(recovered.select("dev"), "dev", "left_semi")


def first_skipped(skipped: DataFrame) -> DataFrame:
    """For each device the path that was parked first: what a probe asks for."""
    return skipped.groupBy("dev").agg(F.min_by("path", "seq").alias("probe_path"))
