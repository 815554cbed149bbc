"""JSON document sources: row shapes, mapping inference, coercion, validation, dead letters, page documents."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.geo import parse_point
from skein.functions.text import host_of, page_category, page_type, path_of, word_count
from skein.plans.model import FieldMapping

EXTENSIONS = ("jsonl", "ndjson", "json")

# Field names that decide a type.
KEYWORD_HINTS = "url final_url canonical canonical_url host path category categories tags tag roles role lang language locale content_type contenttype site site_name sitename author section type page_type pagetype source status_text og_type".split()
TEXT_HINTS = "title body text description summary content headings h1 keywords".split()
NUMBER_HINTS = "status depth word_count wordcount link_count linkcount price score".split()
DATE_HINTS = "fetched_at published_at updated_at created_at date".split()


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _all(kind, v: Any) -> bool:
    return isinstance(v, list) and all(map(kind, v))


def _is_text(v: Any) -> bool:
    return isinstance(v, str)


_ISO_DATE = re.compile(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?!\d)")
_ADDRESS = re.compile(r"(?i)https?://|/(?!.* )")

#: Types in the order in which they are tried, with what a value v of a field k must be; the first that fits decides.
_TYPES = (
    ("geo_point", lambda k, v: isinstance(v, dict) and _number(v.get("lat")) and _number(v.get("lon", v.get("lng")))),
    ("geo_point", lambda k, v: _all(_number, v) and len(v) == 2 and re.search("loc|geo|coord|point", k)),
    (None, lambda k, v: v is None or isinstance(v, dict)),
    ("boolean", lambda k, v: isinstance(v, bool)),
    ("keyword", lambda k, v: _all(_is_text, v)),
    ("number", lambda k, v: _number(v) or _all(_number, v)),
    ("text", lambda k, v: isinstance(v, list)),
    ("date", lambda k, v: k in DATE_HINTS or _ISO_DATE.match(v)),
    ("number", lambda k, v: k in NUMBER_HINTS and re.fullmatch(r"-?\d+(\.\d+)?", v.strip())),
    ("keyword", lambda k, v: k in KEYWORD_HINTS or _ADDRESS.match(v)),
    ("text", lambda k, v: k in TEXT_HINTS),
    ("keyword", lambda k, v: len(v) <= 64 and not re.search(r"\s", v.strip())),
    ("keyword", lambda k, v: len(v) <= 80 and len(re.split(r"\s+", v)) <= 4),
    ("text", lambda k, v: True),
)


def infer_type(name: str, value: Any) -> str | None:
    """Field type of a first non-null JSON value, None for objects that are no points."""
    key = re.sub(r"[^a-z0-9_]", "_", name.lower())
    return next(kind for kind, fits in _TYPES if fits(key, value))


def infer_mappings(rows: DataFrame, fields: str = "fields", known: dict[str, FieldMapping] | None = None) -> dict[str, FieldMapping]:
    """Mappings of the fields of JSON texts: each new field by its first non-null value in order of seq. Known ones stay.

    One aggregation by field name; only a row a field comes to the driver.
    """
    pairs = rows.select("seq", F.explode(F.from_json(fields, "map<string,string>")).alias("name", "text"))
    first = pairs.where("text IS NOT NULL").groupBy("name").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq"))
    kinds = rows.select("seq", F.col(fields).alias("_doc")).join(F.broadcast(first), "seq").select("name", "text", "_doc").collect()
    out = dict(known or {})
    for r in sorted(kinds, key=lambda r: r.name):
        if r.name not in out and (t := infer_type(r.name, json.loads(r["_doc"]).get(r.name))):
            out[r.name] = FieldMapping(t)
    return out


def coerced(doc: Column, name: str, m: FieldMapping) -> Column:
    """A field of a JSON text as its mapped type: string lists joined by spaces, the first of a number list, points as structs."""
    text = F.get_json_object(doc, f"$['{name}']")
    is_list = text.rlike(r"^\s*\[")
    items = F.from_json(text, "array<string>")
    if m.type == "geo_point":
        return parse_point(text)
    if m.type == "number":
        return F.when(is_list, F.get(items, F.lit(0)).try_cast("double")).otherwise(text.try_cast("double"))
    if m.type == "boolean":
        return F.lower(text).try_cast("boolean")
    if m.type == "vector":
        return F.from_json(text, "array<float>")
    numeric = F.forall(items, lambda x: x.try_cast("double").isNotNull()) & (F.size(items) > 0)
    plain = F.when(is_list & numeric & text.rlike(r"^\s*\[\s*[-0-9]"), F.get(items, F.lit(0))).when(is_list, F.array_join(items, " ")).otherwise(text)
    return F.when(text.rlike(r"^\s*\{"), None).otherwise(plain)


def typed(rows: DataFrame, mappings: dict[str, FieldMapping], fields: str = "fields", rest: bool = False) -> DataFrame:
    """id, seq and a column for each mapped field.

    rest: also extra, a JSON object of the fields without mapping (nested ones as JSON text), and meta where rows have it.
    """
    out = rows.select("id", "seq", *[coerced(F.col(fields), n, m).alias(n) for n, m in mappings.items()], *([F.col(fields).alias("_doc")] if rest else []), *(["meta"] if rest and "meta" in rows.columns and "meta" not in mappings else []))
    if not rest or "extra" in mappings:
        return out.drop("_doc")
    other = F.map_filter(F.from_json("_doc", "map<string,string>"), lambda k, v: v.isNotNull() & (~k.isin(*mappings) if mappings else F.lit(True)))
    return out.withColumn("extra", F.when(F.size(other) > 0, F.to_json(other))).drop("_doc")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, valid): the lines of the .jsonl and .ndjson files of a path, and whether each is a JSON object."""
    lines = spark.read.option("pathGlobFilter", "*.{jsonl,ndjson}").text(path).where("trim(value) <> ''")
    return lines.withColumn("valid", F.coalesce(F.expr("try_parse_json(value)").isNotNull() & F.trim("value").startswith("{"), F.lit(False)))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(value, valid) of the documents of .json files that hold an array or an object. A broken file raises."""
    whole = spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    items = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>", {"mode": "FAILFAST"})).otherwise(F.array("value"))
    return whole.select(F.explode(items).alias("value")).withColumn("valid", F.lit(True))


def to_payload(lines: DataFrame) -> DataFrame:
    """(id, fields, meta) of JSON rows: a crawled page, {id, fields, meta}, or a bare object that is the fields itself."""
    v = F.col("value")
    has = lambda p: F.get_json_object(v, p).isNotNull()
    page = has("$.url") & has("$.text") & has("$.roles") & has("$.finalUrl")
    inner = F.get_json_object(v, "$.fields")
    text = lambda p: F.get_json_object(v, p)
    page_fields = F.to_json(F.struct(text("$.title").alias("title"), text("$.text").alias("body"), text("$.finalUrl").alias("url"), text("$.description").alias("description"), text("$.lang").alias("lang")))
    return lines.select(
        F.coalesce(F.when(page, text("$.finalUrl")), text("$.id"), F.sha2(v, 256)).alias("id"),
        F.when(page, page_fields).when(inner.isNotNull(), inner).otherwise(v).alias("fields"),
        text("$.meta").alias("meta"),
    )


def page_documents(pages: DataFrame) -> DataFrame:
    """Crawled pages as documents: id is the address, with host, path, category, page type and counts."""
    address = F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")).otherwise(F.col("url"))
    p = pages.withColumn("_a", address)
    path = path_of(F.col("_a"))
    return p.select(
        F.col("_a").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("body"), F.col("_a").alias("url"), F.coalesce("description", F.lit("")).alias("description"),
        F.array_join("roles", " ").alias("roles"), "status", host_of(F.col("_a")).alias("host"), path.alias("path"),
        page_category(F.col("_a"), F.col("title"), F.col("keywords")).alias("category"), page_type(path, F.col("content_type"), F.col("has_article")).alias("page_type"),
        word_count(F.col("text")).alias("word_count"), F.coalesce(F.size("links"), F.lit(0)).alias("link_count"), "depth", "lang", "canonical", "author", "site_name",
        F.trim(F.get(F.split("content_type", ";"), F.lit(0))).alias("content_type"), F.array_join("keywords", " ").alias("keywords"), F.array_join(F.slice("headings", 1, 20), " | ").alias("headings"), "published_at", "og_type",
    )


def enrich(docs: DataFrame) -> DataFrame:
    """Fill missing host, path, category, page type and word count of documents."""
    has = lambda c: c in docs.columns
    url = F.coalesce(F.col("url") if has("url") else F.lit(None), F.when(F.col("id").cast("string").rlike("(?i)^https?://"), F.col("id")))
    body = F.coalesce(*[F.col(c) for c in ("body", "text", "content") if has(c)], F.lit(None).cast("string"))
    new = {"host": host_of(url), "path": path_of(url), "category": page_category(url, F.col("title") if has("title") else F.lit(""), F.split(F.col("keywords"), r"\s+") if has("keywords") else F.array().cast("array<string>"))}
    out = docs
    for name, c in new.items():
        value = F.when(url.isNotNull() & (url != ""), c)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if has(name) else value)
    kind = F.when(url.isNotNull() & (url != ""), page_type(F.col("path"), F.col("content_type") if has("content_type") else F.lit(""), F.lit(False)))
    out = out.withColumn("page_type", F.coalesce(F.col("page_type"), kind) if has("page_type") else kind)
    n = F.when(F.coalesce(body, F.lit("")) != "", word_count(body))
    return out.withColumn("word_count", F.coalesce(F.col("word_count"), n) if has("word_count") else n)


def issues(doc: Column, mappings: dict[str, FieldMapping], allow_unknown: bool = True, parsed: Column | None = None) -> Column:
    """ARRAY of what is wrong with the fields of a JSON text under the mappings. parsed: the same text as VARIANT, if there is one."""
    parsed = F.try_parse_json(doc) if parsed is None else parsed
    checks = []
    for name, m in mappings.items():
        text = F.get_json_object(doc, f"$['{name}']")
        variant = F.try_variant_get(parsed, f'$["{name}"]', "variant")
        shown = F.schema_of_variant(variant)
        number = shown.rlike("^(BIGINT|DOUBLE|DECIMAL|TINYINT|SMALLINT|INT|FLOAT)")
        ok = {
            "text": (shown == "STRING") | number, "keyword": (shown == "STRING") | number, "date": (shown == "STRING") | number,
            "number": number, "boolean": shown == "BOOLEAN", "vector": shown.rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL)"), "geo_point": parse_point(text).isNotNull(),
        }[m.type]
        absent = variant.isNull() | (shown == "VOID")
        checks.append(F.when(~absent & ~F.coalesce(ok, F.lit(False)), F.lit(f"{name}: expected {m.type}")))
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    if not allow_unknown:
        keys = F.coalesce(F.json_object_keys(doc), F.array().cast("array<string>"))
        unknown = F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(*mappings) if mappings else F.lit(True))), lambda k: F.concat(k, F.lit(": not in the mapping")))
        found = F.concat(found, unknown)
    return F.when(doc.isNull() | F.json_object_keys(doc).isNull(), F.array(F.lit("fields object is required"))).otherwise(found)


def split_valid(rows: DataFrame, mappings: dict[str, FieldMapping], fields: str = "fields", allow_unknown: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others as dead letters (id, payload, error, at)."""
    checked = rows.withColumn("_v", F.try_parse_json(F.col(fields))).withColumn("_issues", issues(F.col(fields), mappings, allow_unknown, F.col("_v"))).drop("_v")
    bad = checked.where(F.size("_issues") > 0).select("id", F.col(fields).alias("payload"), F.array_join("_issues", "; ").alias("error"), F.current_timestamp().alias("at"))
    return checked.where(F.size("_issues") == 0).drop("_issues"), bad
