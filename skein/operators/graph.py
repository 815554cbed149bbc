"""Knowledge graph over tables entities(id, name, type, aliases, doc_ids, seq) and triples(subject, predicate, object, weight, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.runtime import scratch


def add_triples(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Append; incomplete triples are skipped, a missing weight is 1. Duplicates stay."""
    ok = new.where("coalesce(subject, '') <> '' AND coalesce(predicate, '') <> '' AND coalesce(object, '') <> ''").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return triples.unionByName(ok, allowMissingColumns=True)


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id; entities without id or name are skipped."""
    new = new.where("coalesce(id, '') <> '' AND coalesce(name, '') <> ''")
    return entities.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def find_by_name(entities: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Entities whose name or an alias contains the text or is contained in it, in order of insertion."""
    t = text.strip().lower()
    names = F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.lower(F.trim(n)))
    hit = F.exists(names, lambda n: n.contains(t) | F.contains(F.lit(t), n))
    return entities.where(hit).orderBy("seq", "id").limit(limit)


def neighborhood(triples: DataFrame, roots: DataFrame, hops: int = 1, predicates: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) within hops of roots (id), both directions, and the edges met on the way.

    An edge is listed once for each hop and end it is met from. Each hop joins the frontier to the triples and is a table in
    the shared folder; the loop ends early when the frontier is empty.
    """
    t = triples.where(F.col("predicate").isin(predicates)) if predicates else triples
    arcs = t.withColumns({"at": F.col("subject"), "to": F.col("object")}).unionByName(t.withColumns({"at": F.col("object"), "to": F.col("subject")}))
    seen = roots.select("id").distinct().withColumn("hop", F.lit(0))
    frontier, edges = seen.select("id"), None
    for hop in range(1, hops + 1):
        met = scratch(arcs.join(frontier.withColumnRenamed("id", "at"), "at").withColumn("hop", F.lit(hop)), "hop")
        edges = met.drop("at", "to") if edges is None else edges.unionByName(met.drop("at", "to"))
        frontier = scratch(met.select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"), "frontier")
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
        if hop < hops and frontier.isEmpty():
            break
    return seen, edges if edges is not None else t.limit(0).withColumn("hop", F.lit(0))


def search(entities: DataFrame, triples: DataFrame, text: str, hops: int = 1, limit: int = 10, types: list[str] | None = None, predicates: list[str] | None = None) -> dict[str, DataFrame]:
    """Entities found by name and their neighbours (types limits the neighbours only), expanded terms, documents and edges."""
    found = find_by_name(entities, text, limit)
    nodes, edges = neighborhood(triples, found.select("id"), hops, predicates)
    near = entities.join(nodes, "id")
    if types:
        near = near.where((F.col("hop") == 0) | F.col("type").isin(types))
    near = near.orderBy("hop", "seq", "id").limit(2 * limit)
    names = near.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    return {
        "entities": near,
        "terms": names.select(F.lower("term").alias("term")).distinct(),
        "doc_ids": near.select(F.explode("doc_ids").alias("doc_id")).distinct(),
        "edges": edges.orderBy("hop", "seq").limit(4 * limit),
    }


def stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(type, entities, triples): entities per type; the row of type null has the totals."""
    n = triples.agg(F.count(F.lit(1)).alias("triples"))
    per = entities.rollup("type").agg(F.count(F.lit(1)).alias("entities"))
    return per.crossJoin(F.broadcast(n)).withColumn("triples", F.when(F.col("type").isNull(), F.col("triples")))


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
