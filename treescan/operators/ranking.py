"""Numbers over a whole ordered table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def numbered(df: DataFrame, *order: str | Column, name: str = "rn") -> DataFrame:
    """`df` with its rank from 1 in the order given, which must be total for a stable answer.

    A range sort puts ordered runs into partitions; a rank is the place in its run plus the sizes of
    the runs before, a table of one row a partition.
    """
    run, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_run", run)
    sizes = {r["_run"]: r["count"] for r in placed.groupBy("_run").count().collect()}
    base, total = [], 0
    for k in sorted(sizes):
        base.append((k, total))
        total += sizes[k]
    offsets = df.sparkSession.createDataFrame(base, "_run int, _base bigint")
    # as many rows as partitions
    out = placed.join(F.broadcast(offsets), "_run").withColumn(name, F.col("_base") + place + 1)
    return out.drop("_run", "_at", "_base")
