"""Requests as the JSON of other search servers, and their answers back. Requests are dicts as SearchQuery.of takes them."""

from __future__ import annotations

import re
from typing import Any

_RANGE = ("gte", "lte", "gt", "lt")


class UnsupportedFeature(Exception):
    def __init__(self, feature: str, backend: str):
        super().__init__(f"{feature} is not supported by {backend}")
        self.feature, self.backend = feature, backend


def _check(q: dict, backend: str) -> None:
    if q.get("vector"):
        raise UnsupportedFeature("vector search", backend)
    if q.get("mode") in ("semantic", "hybrid", "geo"):
        raise UnsupportedFeature(f"mode={q['mode']}", backend)
    if backend == "solr" and any(q.get(k) for k in ("must", "should", "mustNot")):
        raise UnsupportedFeature("must/should/mustNot bool clauses", backend)


def _projection(q: dict):
    return next((q[k] for k in ("projection", "select", "returnFields", "_source") if q.get(k) is not None), None)


def _flags(spec: dict) -> tuple[list[str], list[str]]:
    yes = [k for k, v in spec.items() if v in (1, True, "1", "true")]
    return yes, [k for k, v in spec.items() if v in (0, False, "0", "false") and k not in yes]


def _matching(q: dict) -> list[dict]:
    """Clauses of the query text."""
    text, fields = q.get("q"), q.get("fields") or ["*"]
    if not text:
        return []
    if q.get("phrase"):
        slop = q.get("phraseSlop") or 0
        if len(fields) == 1 and fields[0] != "*":
            return [{"match_phrase": {fields[0]: {"query": text, "slop": slop}}}]
        return [{"multi_match": {"query": text, "fields": fields, "type": "phrase", "slop": slop}}]
    if q.get("prefix"):
        return [{"prefix": {"_all" if f == "*" else f: text}} for f in fields]
    boosts = q.get("boosts") or {}
    named = [f"{f}^{boosts[f]}" if f in boosts else f for f in fields]
    best: dict[str, Any] = {"query": text, "fields": named, "type": "best_fields"}
    if q.get("fuzziness") not in (None, False):
        best["fuzziness"] = q["fuzziness"]
    phrase = {"query": text, "fields": named, "type": "phrase", "boost": 10}
    return [{"bool": {"must": [{"multi_match": best}], "should": [{"multi_match": phrase}]}}]


def _filter(f: dict) -> dict:
    bounds = {k: f[k] for k in _RANGE if f.get(k) is not None}
    return {"range": {f["field"]: bounds}} if any(k in f for k in _RANGE) else {"term": {f["field"]: f.get("value")}}


def to_elasticsearch(q: dict) -> dict:
    _check(q, "elasticsearch")
    groups = {"must": _matching(q) + [_filter(f) for f in q.get("must") or []], "should": [_filter(f) for f in q.get("should") or []], "must_not": [_filter(f) for f in q.get("mustNot") or []], "filter": [_filter(f) for f in q.get("filters") or []]}
    clauses = {k: v for k, v in groups.items() if v}
    body: dict[str, Any] = {"from": q.get("from") or 0, "size": q.get("size", 10)}
    spec = _projection(q)
    if isinstance(spec, str):
        body["_source"] = [x for x in re.split(r"[,\s]+", spec) if x]
    elif isinstance(spec, dict) and not {"includes", "excludes"} & set(spec):
        yes, no = _flags(spec)
        source = {"includes": yes, "excludes": no} if yes and no else yes or ({"excludes": no} if no else None)
        if source:
            body["_source"] = source
    elif spec is not None:
        body["_source"] = spec
    body["query"] = {"bool": clauses} if clauses else {"match_all": {}}
    return body


def from_elasticsearch(answer: dict, took_ms: float = 0) -> dict:
    found = (answer or {}).get("hits") or {}
    total = found.get("total", 0)
    total = int(total.get("value", 0)) if isinstance(total, dict) else int(total or 0)
    hits = []
    for h in found.get("hits") or []:
        source = h.get("_source") or {}
        key = str(h.get("_id", source.get("id", "")))
        hits.append({"id": key, "score": float(h.get("_score") or 0), "source": {"id": key, "fields": source}, "highlight": h.get("highlight")})
    return {"took_ms": answer.get("took", took_ms), "total": total, "hits": hits, "message": f"Search completed — {total} hit(s)."}


def mapping_to_elasticsearch(mappings: dict[str, dict]) -> dict:
    kinds = {"text": "text", "keyword": "keyword", "number": "double", "boolean": "boolean", "date": "date", "geo_point": "geo_point"}
    if any(m["type"] == "vector" for m in mappings.values()):
        raise UnsupportedFeature("vector field mapping", "elasticsearch")
    return {"properties": {n: {"type": kinds.get(m["type"], "text")} for n, m in mappings.items()}}


def _quoted(text: str) -> str:
    return re.sub(r'[+\-!():^"\[\]{}~*?\\]', lambda m: "\\" + m.group(), text)


def _solr_filter(f: dict) -> str:
    if any(k in f for k in _RANGE):
        low, high = f.get("gte", f.get("gt")), f.get("lte", f.get("lt"))
        left, right = "{" if "gt" in f else "[", "}" if "lt" in f else "]"
        return f"{f['field']}:{left}{'*' if low is None else low} TO {'*' if high is None else high}{right}"
    v = f.get("value")
    text = f'"{_quoted(v)}"' if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"{f['field']}:{text}"


def to_solr(q: dict) -> dict:
    _check(q, "solr")
    text, out = q.get("q"), {"wt": "json", "start": q.get("from") or 0, "rows": q.get("size", 10), "defType": "edismax"}
    if not text:
        out["q"] = "*:*"
    elif q.get("phrase"):
        out["q"] = f'"{_quoted(text)}"'
    elif q.get("prefix"):
        out["q"] = _quoted(text) + "*"
    elif q.get("fuzziness") not in (None, False):
        out["q"] = f"{_quoted(text)}~{2 if q['fuzziness'] == 'AUTO' else int(q['fuzziness'])}"
    else:
        out["q"] = text
    if q.get("boosts"):
        out["qf"] = " ".join(f"{f}^{b}" for f, b in q["boosts"].items())
    elif q.get("fields"):
        out["qf"] = " ".join(q["fields"])
    if q.get("filters"):
        out["fq"] = " AND ".join(map(_solr_filter, q["filters"]))
    spec = _projection(q)
    if isinstance(spec, str):
        out["fl"] = spec
    elif isinstance(spec, (list, dict)):
        names = spec if isinstance(spec, list) else spec.get("includes") or _flags(spec)[0]
        if names or isinstance(spec, list):
            out["fl"] = ",".join(["id", *(n for n in names if n not in ("id", "_id"))])
    return out


def from_solr(answer: dict, took_ms: float = 0) -> dict:
    r = (answer or {}).get("response") or {}
    hits = []
    for d in r.get("docs") or []:
        key = str(d.get("id", d.get("_root_", "")))
        fields = {k: v for k, v in d.items() if k not in ("_version_", "_root_")}
        hits.append({"id": key, "score": float(d.get("score", 0)), "source": {"id": key, "fields": fields}})
    total = int(r.get("numFound") or 0)
    return {"took_ms": took_ms, "total": total, "hits": hits, "message": f"Search completed — {total} hit(s)."}
