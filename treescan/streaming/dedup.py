"""Each entry of a stream once."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY
from ..sources import namespace as ns
from ..storage import scratch_path


def deduplicated(stream: DataFrame, key: list[str] | None = None, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The first row of each key to arrive. With a watermark, state older than it goes, and with it the promise
    for later repeats; without one all keys are kept (use the RocksDB state store)."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(key or KEY)
    return stream.dropDuplicates(key or KEY)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Run a stream over all there is, to a Parquet folder with its checkpoint beside it."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(spark: SparkSession, d: str) -> DataFrame:
    """The order lines as files, streamed and de-duplicated.

    They are put in arrival order into one folder first, so that the first to arrive is the first of its key.
    """
    source, out = scratch_path(spark), scratch_path(spark)
    rows = ns.files(spark, d, repeats=True).select(*KEY, "size", "mtime", "uid")
    first = rows.join(ns.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber") + 100_000_000).alias("ino")).distinct(), "ino", "left_semi")
    order = ns.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 100_000_000).alias("ino"), F.col("l_suppkey").alias("uid"), F.col("l_partkey").alias("part"),
        ns.seconds("l_shipdate").alias("mtime"), F.floor("l_extendedprice").alias("size"),
    )
    arrived = first.join(order, ["ino", "uid", "mtime", "size"]).select(*rows.columns, "part")
    arrived.repartition("ino").sortWithinPartitions("ino", "mtime", "part", "uid").write.parquet(source)
    stream = spark.readStream.schema(arrived.schema).parquet(source)
    run_available(deduplicated(stream), out)
    return spark.read.schema(arrived.schema).parquet(out).select("path", "dev", "ino", "size", "mtime")
