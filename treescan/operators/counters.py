"""Counters and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def scan_counts(entries: DataFrame) -> DataFrame:
    """Directories and files; whatever is no directory is a file."""
    return entries.agg(F.count_if("is_dir").alias("dir_count"), F.count_if(~F.col("is_dir")).alias("file_count"))


def batches(entries: DataFrame, size: int) -> DataFrame:
    """Batches that listing the directories takes: a full multiple has an empty one at its end."""
    per = entries.groupBy("parent").agg(F.count("*").alias("n"))
    return per.agg(F.sum(F.floor(F.col("n") / size) + 1).cast("bigint").alias("batches"))


def rates(samples: DataFrame, frame: int = 60) -> DataFrame:
    """``rate`` over the last `frame` samples, ``mean_rate`` since the first, ``peak_rate`` so far.

    samples: ``ts`` seconds, ``total`` so far; one row each second or less, so that a scan's
    samples are few however many entries it has.
    """
    order = Window.orderBy("ts")
    recent, past = order.rowsBetween(1 - frame, 0), order.rowsBetween(Window.unboundedPreceding, 0)
    span, done = F.col("ts") - F.first("ts").over(recent), F.col("total") - F.first("total").over(recent)
    age, made = F.col("ts") - F.first("ts").over(past), F.col("total") - F.first("total").over(past)
    out = samples.withColumn("rate", F.when(span > 0, done / span).otherwise(0.0))
    out = out.withColumn("mean_rate", F.when(age >= 1, made / age).otherwise(0.0))
    return out.withColumn("peak_rate", F.max("rate").over(past))


def slices_before_gap(ids: DataFrame, most: int = 50) -> DataFrame:
    """Ids from 0 up to the first gap of more than `most` missing ones. Slices hold 100,000 rows each, so their ids are few."""
    order = Window.orderBy("id")
    missing = F.col("id") - F.coalesce(F.lag("id").over(order), F.lit(-1)) - 1
    return ids.withColumn("missing", missing).withColumn("stopped", F.max(F.col("missing") > most).over(order)).where("not stopped").select("id")


def panel(scan: DataFrame, devices: DataFrame, workers: DataFrame | None = None, rates: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
    """Lines ``value`` of a progress panel.

    scan: one row of ``dirs, files, age``; devices: one of ``dead, condemned``; workers: a row for each, ``worker, state, path, open``;
    rates: one row of ``rate, peak_rate`` an hour; probes: a row for each that runs, ``dev, path``. Paths are masked and cut
    to their last 20 characters; a null one is a dash.
    """

    def line(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")

    c = F.col
    at = F.coalesce(text.shortened(text.masked(c("path"))), F.lit("-"))
    of_scan = F.array(line("directories ", c("dirs"), ", files ", c("files")), line("elapsed ", text.elapsed(c("age"))))
    found = [scan.select(F.explode(of_scan).alias("value")), devices.select(line("devices dead ", c("dead"), ", condemned ", c("condemned")))]
    if workers is not None:
        total = workers.agg(F.count_if(c("state") != "DEAD").alias("alive"), F.count("*").alias("n"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"))
        found.append(total.select(line("workers ", c("alive"), " of ", c("n"), ", tasks pending ", c("open"))))
        found.append(workers.select(line("worker ", c("worker"), " ", c("state"), " ", at)))
    if rates is not None:
        found.append(rates.select(line("rate ", F.round("rate").cast("bigint"), " an hour, most ", F.round("peak_rate").cast("bigint"))))
    if probes is not None:
        found.append(probes.select(line("probe of device ", c("dev"), " ", at)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
