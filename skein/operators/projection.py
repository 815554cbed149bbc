"""Projections: a specification is resolved against the schema to a select list, so only the columns asked for are read.

One rule decides about a path: what an exclude names, or lies under, goes; with includes, a path stays if an include
names it, one of its parents, or something below it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_YES, _NO = (1, True, "1", "true"), (0, False, "0", "false")


@dataclass
class Projection:
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    with_id: bool = True
    nothing: bool = False

    def add(self, name: str, include: bool) -> None:
        if name in ("id", "_id"):
            self.with_id = include
            self.named_id = True
        else:
            (self.includes if include else self.excludes).append(name)

    named_id: bool = False


def _entries(spec: Any):
    """(name, include) of any form of specification."""
    if isinstance(spec, str):
        spec = re.split(r"[,\s]+", spec)
    if isinstance(spec, (list, tuple)):
        for t in (x.strip() for x in spec if isinstance(x, str)):
            if t:
                yield (t[1:], False) if t[0] in "-!" else (t, True)
    elif isinstance(spec, dict):
        lists = {k: spec[k] for k in ("includes", "excludes") if isinstance(spec.get(k), (list, tuple))}
        if lists:
            for k, names in lists.items():
                for t in names:
                    yield t, k == "includes"
        else:
            for t, v in spec.items():
                if v in _YES:
                    yield t, True
                elif v in _NO or t in ("id", "_id"):
                    yield t, False


def parse(spec: Any = None, include: list[str] | None = None, exclude: list[str] | None = None) -> Projection | None:
    """The normalised projection, or None for everything."""
    if spec is False:
        return Projection(nothing=True)
    p = Projection()
    for name, keep in (*(() if spec is None or spec is True else _entries(spec)), *((x, True) for x in include or ()), *((x, False) for x in exclude or ())):
        p.add(name, keep)
    return p if p.includes or p.excludes or p.named_id else None


def parse_parameter(text: str | None) -> Any:
    """A projection given as a parameter: JSON or a comma list."""
    import json

    if not text:
        return None
    try:
        return json.loads(text) if text.strip()[:1] in '[{"tf' else text
    except ValueError:
        return text


def _names(pattern: str, path: str) -> bool:
    if "*" in pattern or "?" in pattern:
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
        return re.fullmatch(body, path, re.IGNORECASE) is not None
    return pattern == path


def allowed(p: Projection, path: str) -> bool:
    parts = path.split(".")
    parents = [".".join(parts[: i + 1]) for i in range(len(parts))]
    if any(_names(x, path) for x in p.excludes):
        return False
    if not p.includes:
        return True
    below = any(x.startswith(path + ".") if "*" not in x and "?" not in x else _names(x, path + ".__any__") for x in p.includes)
    return below or any(_names(x, q) for x in p.includes for q in parents)


def _pruned(c: Column, kind: T.DataType, path: str, p: Projection) -> Column | None:
    """The column without what isn't allowed; structs that lose all their fields are dropped."""
    if not allowed(p, path):
        return None
    if not isinstance(kind, T.StructType) or (p.includes and any(_names(x, path) for x in p.includes) and not p.excludes):
        return c
    kept = [(f.name, x) for f in kind.fields if (x := _pruned(c[f.name], f.dataType, f"{path}.{f.name}", p)) is not None]
    return F.when(c.isNotNull(), F.struct(*[x.alias(n) for n, x in kept])) if kept else None


def project(df: DataFrame, spec: Any = None, include: list[str] | None = None, exclude: list[str] | None = None, always: tuple[str, ...] = ("score", "distance_km")) -> DataFrame:
    """df with the columns the specification keeps. vector never stays, meta only where an include names it."""
    p = parse(spec, include, exclude)
    names = [f for f in df.schema.fields if f.name != "vector"]
    if p is None:
        return df.select(*[f.name for f in names])
    if p.nothing:
        return df.select("id", *[c for c in always if c in df.columns])
    p.includes = [x.removeprefix("fields.") for x in p.includes]
    p.excludes = [x.removeprefix("fields.") for x in p.excludes]
    out = []
    for f in names:
        if f.name == "id":
            out += [F.col("id")] if p.with_id else []
        elif f.name in always:
            out.append(F.col(f.name))
        elif f.name == "meta" and p.includes and not any(x == "meta" or x.startswith("meta.") for x in p.includes):
            continue
        elif (c := _pruned(F.col(f"`{f.name}`"), f.dataType, f.name, p)) is not None:
            out.append(c.alias(f.name))
    return df.select(*out)


def for_role(df: DataFrame, role: str, acl: dict[str, list[str]]) -> DataFrame:
    """Only the fields a role may see; administrators and roles without a list see all."""
    fields = acl.get(role) or []
    return df if role == "admin" or not fields else df.select(*[c for c in df.columns if c in ("id", "score") or c in fields])
