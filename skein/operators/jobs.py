"""Listings of jobs and audit events, and the sweep of stale jobs. jobs(id, status, started_at, updated_at, ...)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


def listing(jobs: DataFrame, status: str | None = None, offset: int = 0, size: int = 20, by: str = "started_at") -> DataFrame:
    """A page of at most MAX_PAGE rows, newest first; ties by id."""
    rows = jobs.where(F.col("status") == status) if status else jobs
    return rows.orderBy(F.desc(by), "id").offset(offset).limit(min(size, MAX_PAGE))


def sweep(jobs: DataFrame, cutoff: datetime) -> DataFrame:
    """Running and queued jobs not updated since cutoff become failed."""
    stale = F.col("status").isin("running", "queued") & (F.coalesce("updated_at", "started_at") < F.lit(cutoff))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def retain(log: DataFrame, rows: int, by: str = "ts") -> DataFrame:
    """The last rows of a log, newest first."""
    return log.orderBy(F.desc(by)).limit(rows)
