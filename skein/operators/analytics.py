"""Usage analytics over query_log(type, ts, index, query, mode, took_ms, hits_count, document_id, rank, dt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_days(log: DataFrame, days: int) -> DataFrame:
    """Events of the last days (dates that occur), as the date's dense rank says."""
    dates = log.select("dt").distinct().orderBy(F.desc("dt")).limit(days)
    return log.join(F.broadcast(dates), "dt", "left_semi")


def _at_rank(rows: DataFrame, name: str, share: float, cuts: int = 1024) -> float | None:
    """The value of rank floor(share * n) of a numeric column, exactly, without ordering the values.

    The range is cut into equal parts, each counted with its least and largest value, and the part that holds the rank is
    looked at next, until it holds one value: a few scans, of which at most cuts rows come to the driver each.
    """
    x = F.col(name).cast("double")
    values = rows.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    rank = int(share * n)
    while n and low < high:
        part = F.least(F.floor((F.col("x") - low) / (high - low) * cuts), F.lit(cuts - 1))
        found = values.where(F.col("x").between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(found, key=lambda r: r.part):
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def summary(log: DataFrame) -> DataFrame:
    """One row: queries, clicks, average and 95th percentile of took_ms (the value of rank floor(0.95 n)), zero-result queries."""
    q = log.where("type = 'query'")
    n = q.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("took_ms").alias("avg_ms"), F.count(F.when(F.col("hits_count") == 0, 1)).alias("n_zero"))
    p95 = _at_rank(q, "took_ms", 0.95)
    clicks = log.where("type = 'click'").agg(F.count(F.lit(1)).alias("n_clicks"))
    return n.crossJoin(clicks).select("n_queries", "n_clicks", F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"), F.lit(float(p95 or 0.0)).alias("p95_ms"), "n_zero")


def top_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    """(query, n): queries lower-cased and trimmed, most frequent first."""
    q = log.where("type = 'query' AND query IS NOT NULL").groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count(F.lit(1)).alias("n"))
    return q.where("query <> ''").orderBy(F.desc("n"), "query").limit(limit)


def zero_results(log: DataFrame, limit: int = 10) -> DataFrame:
    """(query): the first distinct queries without hits, by first time of use."""
    q = log.where("type = 'query' AND hits_count = 0 AND query IS NOT NULL").groupBy(F.lower(F.trim("query")).alias("query")).agg(F.min("ts").alias("first"))
    return q.orderBy("first", "query").limit(limit).select("query")
