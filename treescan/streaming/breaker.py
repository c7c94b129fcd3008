"""The device breaker as a stateful operator, with back-off timers for probes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import namespace as ns
from ..storage import scratch_path

OUT = "dev long, seq long, state string, failures long, next_probe long"
STATE = "state string, failures long, last long"
FIRST_S, MOST_S = 5, 300


def next_state(state: str, failures: int, ok: bool, condemn_after: int) -> tuple[str, int]:
    """CONDEMNED stays; a success makes NORMAL, a failure DEAD, and `condemn_after` in a row CONDEMNED."""
    failures = 0 if ok else failures + 1
    if state == "CONDEMNED" or failures >= condemn_after:
        return "CONDEMNED", failures
    return ("NORMAL" if ok else "DEAD"), failures


def transitions(stream: DataFrame, condemn_after: int = 3) -> DataFrame:
    """A row ``dev, seq, state, failures, next_probe`` for each device and batch with news of it.

    stream: ``dev, seq, ts, ok``. next_probe is seconds since 1970 for a dead device (5 s after its
    last event, doubling up to 300 s with each failure), else null. Events of a batch count in the order of seq; events that come
    again or late (a seq no higher than the last) count for nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, failures, last = state.get if state.exists else ("NORMAL", 0, -1)
        at = 0
        for batch in batches:
            for seq, ts, ok in batch.sort_values("seq")[["seq", "ts", "ok"]].itertuples(index=False):
                if seq > last:
                    now, failures = next_state(now, failures, bool(ok), condemn_after)
                    last, at = int(seq), int(ts)
        state.update((now, failures, last))
        probe = at + min(MOST_S, FIRST_S << min(30, max(0, failures - 1))) if now == "DEAD" else None
        yield pd.DataFrame({"dev": [key[0]], "seq": [last], "state": [now], "failures": [failures], "next_probe": pd.array([probe], "Int64")})

    return stream.groupBy("dev").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, d: str, condemn_after: int) -> DataFrame:
    """Devices after all probes among the events, streamed in several batches."""
    source, out = scratch_path(spark), scratch_path(spark)
    rows = ns.control(spark, d).where("type in ('ERROR', 'FINISH')")
    rows = rows.select("dev", "seq", "ts", (F.col("type") != "ERROR").alias("ok"))
    for k in range(3):  # three files, three batches
        low, high = (F.expr(f"(select max(event_id) * {x} div 3 from parquet.`{d}/events.parquet`)") for x in (k, k + 1))
        part = rows.where((F.col("seq") > low) if k else F.lit(True)).where((F.col("seq") <= high) if k < 2 else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)

    transitions(stream, condemn_after).writeStream.foreachBatch(save).option("checkpointLocation", f"{out}.checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(OUT).parquet(out).groupBy("dev").agg(F.max_by(F.struct("state", "failures"), "seq").alias("s"))
    return last.select("dev", "s.state", "s.failures")
