"""Facets over a page of hits or over all matches; every one is a partial and a final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _printed(df: DataFrame, name: str):
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in ("double", "float"):
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def terms(df: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """(key, count), count down; ties by first use (column order), then key. Nulls are skipped."""
    rows = df.where(F.col(name).isNotNull()).select(_printed(df, name).alias("key"), (F.col(order) if order else F.lit(0)).alias("_o"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("_o").alias("_first")).orderBy(F.desc("count"), "_first", "key").select("key", "count")


def stats(df: DataFrame, name: str) -> DataFrame:
    """One row: count, min, max, avg, sum of the finite numbers of a field; all 0 if there are none."""
    v = F.col(name).try_cast("double")
    rows = df.select(v.alias("v")).where("v IS NOT NULL AND NOT isnan(v) AND abs(v) <> double('Infinity')")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count("v").alias("count"), zero(F.min("v")).alias("min"), zero(F.max("v")).alias("max"), zero(F.avg("v")).alias("avg"), zero(F.sum("v")).alias("sum"))


def histogram(df: DataFrame, name: str, interval: float = 10.0) -> DataFrame:
    """(key, count) by floor(v / interval) * interval, key up; an interval of 0 or less gives no rows."""
    v = F.col(name).try_cast("double")
    width = float(interval) if interval > 0 else 1.0
    rows = df.select((F.floor(v / width) * width).alias("key")).where("key IS NOT NULL" if interval > 0 else "false")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("count")).orderBy("key")


def date_histogram(df: DataFrame, name: str, unit: str = "day") -> DataFrame:
    """(key, count) by calendar unit (an extension)."""
    return df.where(F.col(name).isNotNull()).groupBy(F.date_trunc(unit, F.col(name)).alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy("key")


def nested(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts by several fields and all their prefixes (an extension): one rollup."""
    return df.rollup(*names).agg(F.count(F.lit(1)).alias("count"))


def facet(df: DataFrame, spec: str, order: str | None = None) -> DataFrame:
    """A facet by its specification: field, stats:field, histogram:field:interval."""
    kind, _, rest = spec.partition(":")
    if kind == "stats" and rest:
        return stats(df, rest)
    if kind == "histogram" and rest:
        name, _, width = rest.partition(":")
        return histogram(df, name, float(width) if width else 10.0)
    return terms(df, spec, order)


def merge_terms(parts: list[DataFrame]) -> DataFrame:
    """Term facets of several shards as one: counts by key are summed."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "key")


def merge_stats(parts: list[DataFrame]) -> DataFrame:
    """Stats of several shards as one; empty shards don't count."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    full = out.where("count > 0")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return full.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), zero(F.min("min")).alias("min"), zero(F.max("max")).alias("max"), zero(F.sum("sum") / F.sum("count")).alias("avg"), zero(F.sum("sum")).alias("sum"))
