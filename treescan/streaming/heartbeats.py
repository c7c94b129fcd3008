"""Workers that fall silent, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import namespace as ns
from ..storage import scratch_path
from .dedup import run_available


def sessions(stream: DataFrame, silence: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """``worker, start, end, events``: a worker counts as dead from the end of a session on, `silence` after its last event.

    stream: ``worker, at`` (timestamp). Events more than `late` behind the newest are dropped by the watermark.
    """
    window = F.session_window("at", silence).alias("w")
    found = stream.withWatermark("at", late).groupBy("worker", window).agg(F.count("*").alias("events"))
    return found.select("worker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def drained(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """``worker, start, events`` of all control events, streamed; start in seconds since 1970.

    A second file has an event of no worker far ahead, which moves the watermark past all sessions.
    """
    source, out = scratch_path(spark), scratch_path(spark)
    rows = ns.control(spark, d).select("worker", F.timestamp_seconds("ts").alias("at"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    run_available(sessions(stream, f"{limit} seconds"), out)
    spark.createDataFrame([(-1, 4_000_000_000)], "worker int, s bigint").select("worker", F.timestamp_seconds("s").alias("at")).write.mode("append").parquet(source)
    run_available(sessions(stream, f"{limit} seconds"), out)
    found = spark.read.parquet(out).where("worker >= 0")
    return found.select("worker", F.col("start").cast("long").alias("start"), "events")
