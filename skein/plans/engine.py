"""The engine: requests compiled to DataFrames over the tables of a Store."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.embed import embed_column, embedder, text_of_fields
from skein.functions.highlight import highlight_column
from skein.functions.messages import format_message
from skein.functions.runtime import scratch
from skein.functions.text import js_round
from skein.operators import autocomplete, facets, filters, graph, index, keyword, projection, vectors
from skein.plans.model import EngineError, FieldMapping, IndexSettings, SearchQuery, check_bulk, check_window
from skein.sources.documents import infer_mappings, split_valid, typed
from skein.sources.store import Store


@dataclass
class SearchResult:
    """hits is one page, cut from its plan once; total and facets are lazy."""

    hits: DataFrame
    total: DataFrame
    facets: dict[str, DataFrame] = field(default_factory=dict)

    def message(self) -> str:
        return format_message("OK_SEARCH", total=self.total.first()[0])["message"]


class Engine:
    """Indexes, documents, search, suggestions and the graph of one root directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self._indexed: dict[tuple[str, int], index.InvertedIndex] = {}

    # --- writing ---------------------------------------------------------------------------------------------------
    def create_index(self, name: str, mappings: dict[str, FieldMapping] | None = None, settings: IndexSettings | None = None) -> None:
        self.store.create(name, mappings, settings)

    def bulk(self, name: str, documents: list[dict]) -> dict:
        """Upsert up to MAX_BULK documents {id, fields}; those that don't fit become dead letters, the others are written."""
        import json

        check_bulk(len(documents))
        text = lambda x: json.dumps(x) if isinstance(x, dict) else None
        rows = [(i, str(d.get("id", i)), text(d.get("fields")), text(d.get("meta"))) for i, d in enumerate(documents)]
        return self.bulk_frame(name, self.spark.createDataFrame(rows, "seq long, id string, fields string, meta string"))

    def bulk_frame(self, name: str, rows: DataFrame) -> dict:
        """Upsert any number of documents (seq, id, fields as JSON text) in one plan."""
        if name not in self.store.names() and name not in self.store.aliases():
            self.store.create(name)
        known, settings = self.store.mappings(name), self.store.settings(name)
        rows = scratch(rows, "bulk")
        if settings.dynamic_mapping:
            new = infer_mappings(rows.where("fields IS NOT NULL"), "fields", known)
            if new != known:
                self.store.update(name, {k: v for k, v in new.items() if k not in known})
                known = new
        good, bad = split_valid(rows, known)
        if known.get("vector", FieldMapping("text")).type == "vector":
            size = F.size(F.from_json(F.get_json_object("fields", "$.vector"), "array<float>"))
            fits = F.coalesce(size == settings.vector_dimensions, F.lit(True))
            good, wrong = good.where(fits), good.where(~fits)
            bad = bad.unionByName(wrong.select("id", F.col("fields").alias("payload"), F.lit("ERR_VECTOR_DIM").alias("error"), F.current_timestamp().alias("at")))
        counts = (good.count(), bad.count())
        if counts[0]:
            docs = typed(good, known, rest=True)
            if settings.auto_embed and "vector" not in docs.columns:
                docs = docs.withColumn("vector", embed_column(text_of_fields(docs), settings.embedder, settings.vector_dimensions))
            self.store.upsert(name, docs)
        if counts[1]:
            self.store.bury(bad, "bulk", self.store.resolve(name))
        return {"indexed": counts[0], "failed": counts[1], "message": format_message("OK_BULK", indexed=counts[0], failed=counts[1])["message"]}

    def replay(self, name: str, limit: int = 50) -> dict:
        """Send recent dead letters of an index through bulk again."""
        letters = scratch(self.store.dead_letters(index=self.store.resolve(name), limit=limit), "letters")
        self.store.mark_replayed(letters)
        rows = letters.select(F.monotonically_increasing_id().alias("seq"), "id", F.col("payload").alias("fields"))
        return self.bulk_frame(name, rows)

    def reindex(self, name: str, embedder_name: str | None = None, dims: int | None = None) -> int:
        """Embed every document anew, with another embedder or number of dimensions."""
        s = self.store.settings(name)
        chosen, d = embedder_name or s.embedder, dims or embedder(embedder_name or s.embedder)[1]
        docs = self.store.docs(name).drop("vector")
        self.store.update(name, settings={"embedder": chosen, "vector_dimensions": d})
        return self.store.upsert(name, docs.withColumn("vector", embed_column(text_of_fields(docs), chosen, d)).withColumn("seq", F.col("seq") - docs.agg(F.min("seq")).first()[0]))

    def update_by_query(self, name: str, clauses: list[dict], changes: dict[str, Any], max_docs: int = 100) -> int:
        """Set fields of matching documents; their vectors are worked out anew when an embedded field changes."""
        s = self.store.settings(name)

        def embedded(rows: DataFrame) -> DataFrame:
            text = any(isinstance(v, str) for v in changes.values())
            return rows.withColumn("vector", embed_column(text_of_fields(rows), s.embedder, s.vector_dimensions)) if text and "vector" in rows.columns else rows

        return self.store.update_by_query(name, lambda d: filters.all_of(d, clauses), changes, max_docs, embedded)

    # --- reading ---------------------------------------------------------------------------------------------------
    def _index(self, name: str) -> index.InvertedIndex:
        name = self.store.resolve(name)
        key = (name, self.store.manifest(name)["version"])
        if key not in self._indexed:
            self._indexed = {k: v for k, v in self._indexed.items() if k[0] != name}
            at = self.store.derived(name, "postings", key[1])
            if self.store.exists(f"{at}/size/_SUCCESS"):
                self._indexed[key] = index.load(self.spark, at)
            else:
                self._indexed[key] = index.build(self.store.docs(name), self.store.mappings(name), at=at)
        return self._indexed[key]

    def search(self, name: str, request: SearchQuery | dict) -> SearchResult:
        """Compile and cut one page. Filters and statistics are independent: filters never change a score."""
        q = request if isinstance(request, SearchQuery) else SearchQuery.of(request)
        check_window(q)
        mode = q.resolved_mode()
        docs, settings = self.store.docs(name), self.store.settings(name)
        if not q.q and not q.vector and not q.geo:
            raise EngineError("ERR_EMPTY_QUERY")
        if docs is None:
            empty = self.spark.createDataFrame([], "id string, score double")
            return SearchResult(empty, self.spark.createDataFrame([(0,)], "total long"))
        fields = [f for f, m in self.store.mappings(name).items() if m.type in ("text", "keyword")]
        if mode in ("semantic", "hybrid") and not q.vector:
            q.vector = embedder(settings.embedder)[0](q.q or "", settings.vector_dimensions)
        hits = {"keyword": self._keyword, "semantic": self._semantic, "hybrid": self._hybrid, "geo": self._geo}[mode](name, docs, q, settings, fields)
        hits, total = hits
        hits = scratch(hits, "page")  # at most a page of ids and scores, used by hits, facets and highlights
        rows = hits.join(docs, "id")
        if q.geo and q.geo.lat is not None:
            rows = rows.withColumn("distance_km", js_round(filters.geo_distance(q.geo)))
        if q.boost_rules:
            rows = filters.apply_boost_rules(rows, q.boost_rules)
        if q.highlight and q.q:
            for f in q.fields or fields:
                if f in docs.columns:
                    rows = rows.withColumn(f"highlight_{f}", highlight_column(F.col(f).cast("string"), q.q))
        scope = docs if q.facet_scope == "all_matches" or hits.isEmpty() else rows
        found = {f: facets.facet(scope, f, "seq") for f in q.facets}
        shown = projection.project(rows, q.projection_spec(), q.include_fields, q.exclude_fields, ("score", "distance_km", *[c for c in rows.columns if c.startswith("highlight_")]))
        order = [F.asc("distance_km")] if mode == "geo" and q.geo.lat is not None and "distance_km" in shown.columns else [F.desc("score")]
        return SearchResult(shown.orderBy(*order, *([F.col("id")] if "id" in shown.columns else [])), total, found)

    def _keyword(self, name, docs, q, settings, fields):
        hits = keyword.search_many(self._index(name), docs, [(0, q)], fields, settings).drop("qid")
        cut = hits if q.search_after is not None else keyword.search_many(self._index(name), docs, [(0, q)], fields, settings, top=q.offset + 3 * max(1, q.size)).drop("qid")
        if q.should or q.must_not:
            cond = filters.bool_clauses(docs, q.should, q.must_not)
            if q.exact_bool:
                hits = hits.join(docs.where(cond).select("id"), "id", "left_semi")
            else:
                window = keyword.page(cut, q.offset, 3 * q.size, q.search_after)
                kept = window.join(docs.where(cond).select("id"), "id", "left_semi")
                return kept.orderBy(F.desc("score"), "id").limit(q.size), kept.agg(F.count(F.lit(1)).alias("total"))
        total = hits.agg(F.count(F.lit(1)).alias("total"))
        return keyword.page(hits if q.exact_bool and (q.should or q.must_not) else cut, q.offset, q.size, q.search_after), total

    def _vector_hits(self, docs, q, settings, k):
        vectors.require_dims(q.vector, settings.vector_dimensions)
        kept = docs.where(filters.all_of(docs, q.filters) & (filters.geo(docs, q.geo) if q.geo else F.lit(True)))
        hits = vectors.knn(kept.select("id", F.col("vector").alias("vec")), q.vector, k, q.vector_metric or settings.vector_metric, None, q.min_score)
        return hits if q.min_score is not None else vectors.noise_floor(hits, k)

    def _semantic(self, name, docs, q, settings, fields):
        hits = self._vector_hits(docs, q, settings, max(q.offset + 5 * q.size, 100)).orderBy(F.desc("score"), "id").limit(q.offset + 3 * q.size)
        total = hits.agg(F.count(F.lit(1)).alias("total"))
        return hits.withColumn("score", js_round(F.col("score"))).orderBy(F.desc("score"), "id").offset(q.offset).limit(q.size), total

    def _hybrid(self, name, docs, q, settings, fields):
        k = max(5 * q.size, 50)
        words = keyword.page(keyword.search_many(self._index(name), docs, [(0, q)], fields, settings, top=k).drop("qid"), 0, k)
        near = self._vector_hits(docs, SearchQuery(vector=q.vector, filters=q.filters, geo=q.geo, vector_metric=q.vector_metric), settings, k)
        weight = settings.hybrid_keyword_weight if q.hybrid_weight is None else q.hybrid_weight
        blended = vectors.hybrid(words, near, q.ranking_mode or settings.hybrid_ranking_mode, weight, settings.rrf_k, q.min_score)
        return keyword.page(blended, q.offset, q.size), blended.agg(F.count(F.lit(1)).alias("total"))

    def _geo(self, name, docs, q, settings, fields):
        kept = docs.where(filters.geo(docs, q.geo) & filters.all_of(docs, q.filters))
        total = kept.agg(F.count(F.lit(1)).alias("total"))
        if q.geo.lat is None:
            return kept.select("id", F.lit(1.0).alias("score"), "seq").orderBy("seq").offset(q.offset).limit(q.size).drop("seq"), total
        scored = kept.select("id", (1 / (1 + filters.geo_distance(q.geo))).alias("score"))
        return keyword.page(scored, q.offset, q.size), total

    def suggest(self, name: str, prefix: str, size: int = 10) -> DataFrame:
        return keyword.suggest(self._index(name), prefix, None, size)

    def autocomplete(self, name: str, text: str, size: int = 10, entities: DataFrame | None = None) -> DataFrame:
        return autocomplete.complete(self._index(name), self.store.docs(name), text, size, entities)

    def graph_search(self, entities: DataFrame, triples: DataFrame, text: str, **options: Any) -> dict[str, DataFrame]:
        return graph.search(entities, triples, text, **options)

    def stats(self) -> DataFrame:
        rows = [(n, self.store.docs(n).count() if self.store.docs(n) is not None else 0) for n in self.store.names()]
        return self.spark.createDataFrame(rows, "name string, documents long")
