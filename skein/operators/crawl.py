"""Breadth-first crawl over a table of fetched pages (url, final_url, status, links, ...), and merging by final address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.html import host_allowed, path_allowed, robots_allowed
from skein.functions.runtime import scratch
from skein.functions.text import normalize_url, path_of


def crawl(pages: DataFrame, seeds: DataFrame, hosts: list[str] | None = None, max_depth: int | None = None, max_pages: int | None = None, allow: list[str] = (), deny: list[str] = (), robots: list[tuple[str, bool]] = ()) -> DataFrame:
    """(url, depth) of the pages reached from seeds (url). Links are followed from pages of status 2xx and 3xx.

    Each level joins the frontier to the pages and leaves out what has been seen; levels are tables in the shared folder.
    Of a page fetched several times the links of all its rows are followed. The crawl ends when no new address is left;
    max_depth and max_pages, if given, are budgets, spent in order of depth and address.
    """
    known = pages.select(normalize_url(F.col("url")).alias("url"), "status", "links").where("url IS NOT NULL")

    def admitted(urls: DataFrame) -> DataFrame:
        ok = path_allowed(path_of(F.col("url")), allow, deny) & robots_allowed(path_of(F.col("url")), list(robots))
        return urls.where(F.col("url").isNotNull() & (host_allowed(F.col("url"), hosts) if hosts else F.lit(True)) & ok)

    frontier = scratch(admitted(seeds.select(normalize_url(F.col("url")).alias("url"))).distinct(), "frontier")
    seen, out, left, depth = frontier, None, max_pages, 0
    while True:
        fetched = scratch(known.join(frontier, "url", "left_semi"), "fetched")
        urls = fetched.select("url").distinct()
        if left is not None:
            urls = urls.orderBy("url").limit(left)
        visited = scratch(urls.withColumn("depth", F.lit(depth)), "visited")
        out = visited if out is None else out.unionByName(visited)
        if left is not None:
            left -= visited.count()
        if left == 0 or depth == max_depth:
            break
        links = fetched.where("status >= 200 AND status < 400").select(F.explode("links").alias("link")).select(normalize_url(F.col("link")).alias("url")).distinct()
        frontier = scratch(admitted(links).join(seen, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen, depth = seen.unionByName(frontier), depth + 1
    return out.select("url", "depth")


def merge_by_address(pages: DataFrame) -> DataFrame:
    """One row per final address: the row of the longest text, roles of all rows together. Refused and non-HTML pages are left out."""
    usable = pages.where("coalesce(status, 0) NOT IN (401, 403) AND (content_type IS NULL OR lower(content_type) LIKE '%html%')")
    address = F.when(F.trim(F.coalesce("final_url", F.lit(""))) != "", F.col("final_url")).otherwise(F.col("url"))
    rows = usable.withColumn("address", address)
    longest = F.max_by(F.struct("page_id", "title", "status"), F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("page_id")))
    merged = rows.groupBy("address").agg(longest.alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("roles", F.array().cast("array<string>")))))).alias("roles"), F.countDistinct("page_id").alias("n_pages"))
    return merged.select("address", "x.page_id", "x.title", "x.status", "roles", "n_pages")


def link_graph(pages: DataFrame) -> DataFrame:
    """(source, target) of every distinct link between normalised addresses."""
    rows = pages.select(normalize_url(F.coalesce("final_url", "url")).alias("source"), F.explode("links").alias("link"))
    return rows.select("source", normalize_url(F.col("link")).alias("target")).where("source IS NOT NULL AND target IS NOT NULL").distinct()
