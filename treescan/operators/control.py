"""What control events tell of workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(events: DataFrame) -> DataFrame:
    """Each worker's state after its last event: an error is DEAD, a finished task or readiness IDLE, else BUSY."""
    last = events.groupBy("worker").agg(F.max_by("type", "seq").alias("type"), F.max("seq").alias("seq"))
    state = F.when(F.col("type") == "ERROR", "DEAD").when(F.col("type").isin("READY", "FINISH"), "IDLE").otherwise("BUSY")
    return last.select("worker", "seq", "type", state.alias("state"))


def gaps(events: DataFrame, limit: int) -> DataFrame:
    """Times at which a worker hadn't been heard of for more than `limit` seconds."""
    by = Window.partitionBy("worker").orderBy("ts", "seq")
    return events.withColumn("gap", F.col("ts") - F.lag("ts").over(by)).where(F.col("gap") > limit)


def timeouts(events: DataFrame, now: Column, limit: int = 30, startup: int = 60) -> DataFrame:
    """``worker, last, silence, timed_out`` at `now`: who hasn't been heard of for too long.

    Too long is more than `limit` seconds or, for a worker that said nothing since it was READY, more than `startup`.
    """
    heard = events.groupBy("worker").agg(F.max("ts").alias("last"), F.max(F.when(F.col("type") == "READY", F.col("ts"))).alias("born"))
    silence = now - F.col("last")
    allowed = F.when(F.col("last") == F.col("born"), startup).otherwise(limit)
    return heard.select("worker", "last", silence.alias("silence"), (silence > allowed).alias("timed_out"))


def sessions(events: DataFrame, limit: int) -> DataFrame:
    """``worker, start, events``: stretches without a pause of `limit` seconds or more."""
    at = F.timestamp_seconds("ts")
    found = events.groupBy("worker", F.session_window(at, f"{limit} seconds").alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("start"))
    return found.select("worker", "start", "events")


def outstanding(events: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Running balance of opened and closed tasks per worker."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    by = Window.partitionBy("worker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("open", F.sum(step).over(by))
