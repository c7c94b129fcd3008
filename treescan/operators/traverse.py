"""Trees by level: a frontier of directories is joined with their children until it is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import scratch_path, stored
from .dedup import unseen


def walk(children: DataFrame, root: str, levels: int = 4096, visited: DataFrame | None = None) -> DataFrame:
    """All below `root`, which itself isn't returned, with ``depth`` from 1.

    children: ``path, parent, is_dir`` and others; each row is a listed entry. A level is an equi-join of
    the frontier with parents, and levels are stored, so that lineage stays short and a lost
    executor costs one level. With `visited`, entries it has are neither returned nor entered.
    """
    if visited is not None:
        children = unseen(children, visited)
    children = stored(children)  # each level reads it
    frontier = children.sparkSession.createDataFrame([(root,)], "parent string")
    out = None
    for depth in range(1, levels + 1):
        level = stored(children.join(frontier, "parent", "left_semi").withColumn("depth", F.lit(depth)))
        if not level.take(1):
            return out if out is not None else level
        out = level if out is None else out.unionByName(level)
        frontier = level.where("is_dir").select(F.col("path").alias("parent"))
    raise ValueError(f"more than {levels} levels: the links may form a ring")


def depths(edges: DataFrame, root: str) -> DataFrame:
    """``path, depth`` of all below `root`, whatever their number: each row of `edges` (``path, parent``) that is reached, once.

    Levels are stored with their paths only. A path is entered at its least depth and not again, so rings end. A recursive
    query would stop at a million rows or a hundred levels.
    """
    spark, edges = edges.sparkSession, stored(edges.select("path", "parent"))
    out, above, level = scratch_path(spark), [], edges.where(F.col("parent") == root)
    paths = lambda *folders: spark.read.schema("path string").parquet(*folders)
    while True:
        level.select("path").write.parquet(here := f"{out}/depth={len(above) + 1}")
        frontier = paths(here)
        if not frontier.take(1):
            return spark.read.schema("path string, depth int").parquet(out)
        if above:
            frontier = frontier.join(paths(*above), "path", "left_anti")
        level = edges.join(frontier.where(F.col("path") != root).withColumnRenamed("path", "parent"), "parent", "left_semi")
        above.append(here)


def resolved(links: DataFrame, entries: DataFrame, follow: bool) -> DataFrame:
    """`links` (``target`` path or null) as scanned: with `follow` a link has its target's mode and size
    and is dropped if the target is missing; without it stays a link."""
    if not follow:
        return links.drop("target")
    real = entries.select(F.col("path").alias("target"), F.col("mode").alias("t_mode"), F.col("size").alias("t_size"))
    both = links.join(real, "target", "left").where("target is null or t_mode is not null")
    return both.withColumn("mode", F.coalesce("t_mode", "mode")).withColumn("size", F.coalesce("t_size", "size")).drop("target", "t_mode", "t_size")
