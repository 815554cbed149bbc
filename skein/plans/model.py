"""Requests, settings and errors of the engine."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any, ClassVar


class EngineError(Exception):
    """An error with a code such as ERR_INDEX_EXISTS."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


FIELD_TYPES = ("text", "keyword", "number", "boolean", "date", "vector", "geo_point")
INDEX_NAME = re.compile(r"^[a-z0-9][a-z0-9_-]{0,63}$")


@dataclass(frozen=True)
class FieldMapping:
    type: str
    index: bool = True
    analyzer: str = "standard"
    store: bool = True

    def __post_init__(self):
        if self.type not in FIELD_TYPES:
            raise EngineError("ERR_VALIDATION", f"unknown field type {self.type}")


@dataclass
class IndexSettings:
    bm25k1: float = 1.2
    bm25b: float = 0.75
    vector_dimensions: int = 384
    vector_metric: str = "cosine"
    vector_quantization: str = "none"
    auto_embed: bool = True
    hybrid_keyword_weight: float = 0.55
    rrf_k: int = 60
    hybrid_ranking_mode: str = "linear"
    dynamic_mapping: bool = True
    default_operator: str = "OR"
    enable_knowledge_graph: bool = False
    embedder: str = "micro-transformer"


@dataclass
class GeoQuery:
    field: str
    lat: float | None = None
    lon: float | None = None
    distance_km: float | None = None
    box: tuple[float, float, float, float] | None = None  # top, left, bottom, right
    sort_by_distance: bool = False

    def check(self) -> None:
        if self.box is None and (self.lat is None or self.lon is None):
            raise EngineError("ERR_VALIDATION", "geo needs an origin or a box")
        if self.lat is not None and not (-90 <= self.lat <= 90 and -180 <= (self.lon or 0) <= 180):
            raise EngineError("ERR_VALIDATION", "origin out of range")
        if self.distance_km is not None and not self.distance_km > 0:
            raise EngineError("ERR_VALIDATION", "distance must be positive")
        if self.box is not None and self.box[0] < self.box[2]:
            raise EngineError("ERR_VALIDATION", "top below bottom")


@dataclass
class BoostRule:
    when: list[dict[str, Any]]
    multiply: float | None = None
    add: float | None = None


@dataclass
class SearchQuery:
    """A flat request; unknown keys are dropped by of()."""

    q: str | None = None
    mode: str | None = None
    fields: list[str] | None = None
    filters: list[dict] = field(default_factory=list)
    must: list[dict] = field(default_factory=list)
    should: list[dict] = field(default_factory=list)
    must_not: list[dict] = field(default_factory=list)
    offset: int = 0
    size: int = 10
    min_score: float | None = None
    fuzziness: Any = None
    prefix: bool = False
    phrase: bool = False
    phrase_slop: int = 0
    operator: str | None = None
    minimum_should_match: Any = None
    boosts: dict[str, float] = field(default_factory=dict)
    boost_rules: list[BoostRule] = field(default_factory=list)
    search_after: Any = None
    vector: list[float] | None = None
    vector_metric: str | None = None
    hybrid_weight: float | None = None
    ranking_mode: str | None = None
    geo: GeoQuery | None = None
    facets: list[str] = field(default_factory=list)
    facet_scope: str = "page"
    highlight: bool = False
    projection: Any = None
    select: Any = None
    return_fields: Any = None
    source_filter: Any = None
    include_fields: list[str] | None = None
    exclude_fields: list[str] | None = None
    exact_bool: bool = False

    _ALIASES: ClassVar[dict[str, str]] = {"from": "offset", "mustNot": "must_not", "minScore": "min_score", "phraseSlop": "phrase_slop", "minimumShouldMatch": "minimum_should_match", "boostRules": "boost_rules", "searchAfter": "search_after", "vectorMetric": "vector_metric", "hybridKeywordWeight": "hybrid_weight", "hybridRankingMode": "ranking_mode", "returnFields": "return_fields", "_source": "source_filter", "includeFields": "include_fields", "excludeFields": "exclude_fields", "facetScope": "facet_scope", "exactBool": "exact_bool"}

    @classmethod
    def of(cls, request: dict) -> SearchQuery:
        names = {f.name for f in fields(cls)}
        kept = {k2: v for k, v in request.items() if (k2 := cls._ALIASES.get(k, k)) in names}
        if isinstance(kept.get("geo"), dict):
            kept["geo"] = GeoQuery(**kept["geo"])
        kept["boost_rules"] = [r if isinstance(r, BoostRule) else BoostRule(**r) for r in kept.get("boost_rules", [])]
        return cls(**kept)

    def resolved_mode(self) -> str:
        if self.mode:
            return self.mode
        if self.geo and not self.q and not self.vector:
            return "geo"
        if self.vector:
            return "hybrid" if self.q else "semantic"
        return "keyword"

    def projection_spec(self):
        return next((x for x in (self.projection, self.select, self.return_fields, self.source_filter) if x is not None), None)


#: Limits of one request.
MAX_BULK, MAX_WINDOW, MAX_SIZE, MAX_EXPANSIONS = 1000, 10_000, 100, 50


def check_window(q: SearchQuery) -> None:
    if q.size < 0 or q.offset < 0 or q.offset + q.size > MAX_WINDOW:
        raise EngineError("ERR_CIRCUIT_WINDOW", f"from + size is limited to {MAX_WINDOW}")
    if q.size > MAX_SIZE:
        raise EngineError("ERR_VALIDATION", f"size is limited to {MAX_SIZE}")


def check_bulk(n: int) -> None:
    if n > MAX_BULK:
        raise EngineError("ERR_CIRCUIT_BULK", f"a bulk request holds at most {MAX_BULK} documents")
