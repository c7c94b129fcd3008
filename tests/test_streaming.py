from pyspark.sql import functions as F

from treescan.streaming import dedup, heartbeats


def test_each_key_once_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("/a", 1, 1), ("/a", 1, 1), ("/b", 1, 1)], "path string, dev bigint, ino bigint")
    rows.write.parquet(source)
    for _ in range(2):
        dedup.run_available(dedup.deduplicated(spark.readStream.schema(rows.schema).parquet(source)), out)
        rows.write.mode("append").parquet(source)
    assert spark.read.parquet(out).count() == 2


def test_sessions_end_with_silence(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 0), (1, 20), (1, 100), (1, 10_000)], "worker int, s bigint").select("worker", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(source)
    dedup.run_available(heartbeats.sessions(spark.readStream.schema(rows.schema).parquet(source)), out)
    assert sorted(r["events"] for r in spark.read.parquet(out).collect()) == [1, 2]
