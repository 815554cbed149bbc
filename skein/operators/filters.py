"""Predicates of requests as columns; all of them can be pushed to the scan where their column is plain."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.geo import haversine_km, within_box, within_radius
from skein.plans.model import EngineError, GeoQuery

_NUMBERS = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def _kind(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        return "missing"
    t = df.schema[name].dataType
    return "number" if isinstance(t, _NUMBERS) else "boolean" if isinstance(t, T.BooleanType) else "string" if isinstance(t, T.StringType) else "other"


def js_text(v: Any) -> str:
    """A value as it prints: 5.0 is "5", true is "true"."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return str(v)


def _number(s: Any) -> float | None:
    if isinstance(s, bool):
        return None
    try:
        return float(s)
    except (TypeError, ValueError):
        return None


def term(df: DataFrame, name: str, value: Any, strict: bool = False) -> Column:
    """Equality, also of a number and its printed text unless strict. A missing field or null value matches nothing."""
    kind, c = _kind(df, name), F.col(name) if name in df.columns else None
    if value is None or kind in ("missing", "other"):
        return F.lit(False)
    if kind == "boolean":
        ok = isinstance(value, bool) or (not strict and value in ("true", "false"))
        return F.coalesce(c == F.lit(value in (True, "true")), F.lit(False)) if ok else F.lit(False)
    if kind == "number":
        if isinstance(value, bool) or (strict and isinstance(value, str)):
            return F.lit(False)
        n = _number(value)
        if n is None or (isinstance(value, str) and js_text(n) != value):
            return F.lit(False)
        return F.coalesce(c == F.lit(int(n) if n.is_integer() and abs(n) < 2**53 else n), F.lit(False))
    if strict and not isinstance(value, str):
        return F.lit(False)
    return F.coalesce(c == F.lit(js_text(value)), F.lit(False))


def value_range(df: DataFrame, name: str, gte=None, lte=None, gt=None, lt=None) -> Column:
    """Numbers and numeric strings compare as numbers, other strings by code point; other types and missing fields fail."""
    bounds = [(op, b) for op, b in (("gte", gte), ("lte", lte), ("gt", gt), ("lt", lt)) if b is not None]
    kind = _kind(df, name)
    if any(isinstance(b, float) and b != b for _, b in bounds):
        raise EngineError("ERR_VALIDATION", "NaN is no bound")
    if kind not in ("number", "string"):
        return F.lit(False)
    c = F.col(name)
    compare = {"gte": lambda x, b: x >= b, "lte": lambda x, b: x <= b, "gt": lambda x, b: x > b, "lt": lambda x, b: x < b}

    def test(numeric: bool) -> Column:
        out = c.isNotNull()
        for op, b in bounds:
            n = _number(b)
            if numeric:
                x = c if kind == "number" else c.try_cast("double")
                out = out & (compare[op](x, F.lit(n)) if n is not None else F.lit(False))
            else:
                out = out & compare[op](c, F.lit(js_text(b)))
        return F.coalesce(out, F.lit(False))

    if kind == "number":
        return test(True)
    if all(_number(b) is None for _, b in bounds):
        return test(False)
    return F.when(c.try_cast("double").isNotNull(), test(True)).otherwise(test(False))


def clause(df: DataFrame, f: dict) -> Column:
    ops = {k: f[k] for k in ("gte", "lte", "gt", "lt") if k in f}
    return value_range(df, f["field"], **ops) if ops else term(df, f["field"], f.get("value"))


def all_of(df: DataFrame, filters: list[dict]) -> Column:
    return reduce(lambda a, b: a & b, [clause(df, f) for f in filters], F.lit(True))


def bool_clauses(df: DataFrame, should: list[dict], must_not: list[dict]) -> Column:
    """Any of should (if there are any) and none of must_not, by strict equality."""
    some = reduce(lambda a, b: a | b, [term(df, f["field"], f.get("value"), True) for f in should], F.lit(False)) if should else F.lit(True)
    none = reduce(lambda a, b: a | b, [term(df, f["field"], f.get("value"), True) for f in must_not], F.lit(False))
    return some & ~none


def geo(df: DataFrame, g: GeoQuery) -> Column:
    g.check()
    if g.field not in df.columns or not isinstance(df.schema[g.field].dataType, T.StructType):
        raise EngineError("ERR_VALIDATION", f"{g.field} is not mapped as geo_point")
    lat, lon = F.col(f"{g.field}.lat"), F.col(f"{g.field}.lon")
    out = lat.isNotNull() & lon.isNotNull()
    if g.box is not None:
        out = out & within_box(lat, lon, *g.box)
    if g.distance_km is not None and g.lat is not None:
        out = out & within_radius(lat, lon, g.lat, g.lon, g.distance_km)
    return F.coalesce(out, F.lit(False))


def geo_distance(g: GeoQuery) -> Column:
    return haversine_km(F.lit(g.lat), F.lit(g.lon), F.col(f"{g.field}.lat"), F.col(f"{g.field}.lon"))


def boost_condition(df: DataFrame, cond: dict) -> Column:
    """One condition of a boost rule: equals, notEquals, in, gt, gte, lt, lte, exists; types must agree."""
    name = cond["field"]
    c = F.col(name) if name in df.columns else F.lit(None)
    out = F.lit(True)
    if "exists" in cond:
        out = out & (c.isNotNull() if cond["exists"] else c.isNull())
    if "equals" in cond:
        out = out & term(df, name, cond["equals"], True)
    if "notEquals" in cond:
        out = out & ~term(df, name, cond["notEquals"], True)
    if "in" in cond:
        out = out & reduce(lambda a, b: a | b, [term(df, name, v, True) for v in cond["in"]], F.lit(False))
    for op, fn in (("gt", lambda b: c > b), ("gte", lambda b: c >= b), ("lt", lambda b: c < b), ("lte", lambda b: c <= b)):
        if op in cond:
            out = out & (F.coalesce(fn(F.lit(cond[op])), F.lit(False)) if _kind(df, name) == "number" else F.lit(False))
    return out


def apply_boost_rules(df: DataFrame, rules, score: str = "score") -> DataFrame:
    """Rules in order: multiply, then add, rounded half up to 3 places each; a rule without effect leaves the score."""
    from skein.functions.text import js_round

    for r in rules:
        hit = reduce(lambda a, b: a & b, [boost_condition(df, c) for c in r.when], F.lit(True))
        new = F.col(score) * F.lit(float(r.multiply if r.multiply is not None else 1.0)) + F.lit(float(r.add or 0.0))
        df = df.withColumn(score, F.when(hit, js_round(new)).otherwise(F.col(score)))
    return df
