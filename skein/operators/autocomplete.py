"""Autocomplete from five sources: dictionary, titles, categories, visual tags, graph entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import facets, graph
from skein.operators.index import InvertedIndex
from skein.operators.keyword import page, search_many, suggest
from skein.plans.model import SearchQuery

_MOTIF = r"(?i)motif|border|pallu|checks"


def complete(index: InvertedIndex, docs: DataFrame, text: str, size: int = 10, entities: DataFrame | None = None, categories: bool = True, visual: bool = True, documents: bool = True, analysis: dict | None = None) -> DataFrame:
    """(text, type, score): of equal texts the source named first stays; score down, text up."""
    q = text.strip().lower()
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "text string, type string, score double, source int, ord long")
    if not q:
        return empty.select("text", "type", "score")
    parts = []
    number = lambda: F.monotonically_increasing_id()
    words = suggest(index, q, None, 2 * size)
    parts.append(words.select(F.col("term").alias("text"), F.lit("query").alias("type"), (1.0 - (F.length("term") - len(q)) * 0.05).alias("score"), F.lit(1).alias("source"), number().alias("ord")))
    titles = [f for f in ("name", "title", "product_name") if f in docs.columns]
    if documents and titles:
        hits = page(search_many(index, docs, [(0, SearchQuery(q=q, prefix=True))], titles, analysis=analysis), 0, 5)
        shown = hits.join(docs.select("id", F.coalesce(*titles).alias("text")), "id").where("text IS NOT NULL")
        parts.append(shown.select("text", F.lit("document").alias("type"), F.least(F.lit(0.95), F.col("score") / 10).alias("score"), F.lit(2).alias("source"), number().alias("ord")))
    if categories and "category" in docs.columns:
        found = facets.terms(docs, "category").where(F.contains(F.lower("key"), F.lit(q)))
        parts.append(found.select(F.col("key").alias("text"), F.lit("category").alias("type"), F.lit(0.90).alias("score"), F.lit(3).alias("source"), number().alias("ord")))
    for name in ("tags", "dominant_colors", "motifs") if visual else ():
        if name in docs.columns:
            found = facets.terms(docs, name).where(F.contains(F.lower("key"), F.lit(q)))
            kind = F.when(F.col("key").rlike(_MOTIF), "motif").otherwise("visual_tag")
            parts.append(found.select(F.col("key").alias("text"), kind.alias("type"), F.lit(0.85).alias("score"), F.lit(4).alias("source"), number().alias("ord")))
    if entities is not None:
        parts.append(graph.find_by_name(entities, q, 5).select(F.col("name").alias("text"), F.lit("entity").alias("type"), F.lit(0.92).alias("score"), F.lit(5).alias("source"), number().alias("ord")))
    out = empty
    for p in parts:
        out = out.unionByName(p)
    first = Window.partitionBy(F.lower("text")).orderBy("source", "ord")
    out = out.withColumn("r", F.row_number().over(first)).where("r = 1")
    return out.orderBy(F.desc("score"), "text").limit(size).select("text", "type", "score")
