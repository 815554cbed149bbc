"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them. Minima combine map-side; no node's neighbours are collected."""
    if large:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = arcs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """page_id and group_id, the least id of its component, for every end of edges (a, b). Each round is a table in the shared folder."""
    now = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        now = scratch(_star(scratch(_star(now, True), "large"), False), "small")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    members = now.select(F.col("a").alias("page_id"), F.col("b").alias("group_id"))
    return members.unionByName(now.select(F.col("b").alias("page_id"), F.col("b").alias("group_id")).distinct())
