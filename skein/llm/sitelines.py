"""Lines repeated across the pages of one site.

Summary pass: every (site, line) counts into one of 2^32 counters. Counters add up, so the summary merges map-side and
across partitions, and because a counter never undercounts, a line on n pages has a counter of at least n: no repeated
line is lost and no hot site's summary sits in one task. Verification: only lines whose counter reaches the threshold
are counted again exactly, by distinct page. Removal: confirmed lines are joined back, as a broadcast set when their
measured number is small.

Defined cases: pages with null text or null page_id have no lines; a site that can't be read is the empty site; a row
delivered twice counts once; a blank line is never repeated text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import maybe_broadcast, scratch
from skein.llm.common import site_column

MIN_PAGES = 12


def _normal(line):
    folded = F.regexp_replace(F.lower(line), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(folded, r"[0-9]+", "0"))


def line_keys(pages: DataFrame) -> DataFrame:
    """page_id, line_no and a 128-bit key (k1, k2) of site and normalised line, for every non-blank line."""
    lines = (
        pages.where("text IS NOT NULL AND page_id IS NOT NULL")
        .select("page_id", site_column(F.col("final_url"), F.col("url")).alias("site"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .select("page_id", "site", "line_no", _normal(F.col("line")).alias("line"))
        .where("line <> ''")
    )
    return lines.select("page_id", "line_no", F.xxhash64("site", "line").alias("k1"), F.xxhash64("line", "site", F.lit(1)).alias("k2"))


def repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, line_no) of each non-blank line found on at least min_pages different pages of its site."""
    lines = scratch(line_keys(pages), "lines").withColumn("cell", F.shiftright("k1", 32).cast("int"))
    summary = lines.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("cell")
    candidates = lines.join(maybe_broadcast(scratch(summary, "cells")), "cell", "left_semi")
    confirmed = (
        candidates.groupBy("k1", "k2", "page_id").agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("k1", "k2")
    )
    confirmed = scratch(confirmed, "confirmed")
    return lines.join(maybe_broadcast(confirmed), ["k1", "k2"], "left_semi").select("page_id", F.col("line_no").cast("int").alias("line_no")).distinct()


def without_repeated_lines(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page_id: its text without the lines that repeated_lines finds, and how many were removed."""
    drop = repeated_lines(pages, min_pages).groupBy("page_id").agg(F.collect_set("line_no").alias("drop"))
    texts = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("text").alias("text"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("drop"), i))
    return texts.join(drop, "page_id", "left").select(
        "page_id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("body_text"),
        F.coalesce(F.size("drop"), F.lit(0)).alias("n_removed"),
    )
