import json

import pytest

from skein.plans.engine import Engine
from skein.plans.model import EngineError, FieldMapping, IndexSettings, SearchQuery, check_window
from skein.plans.plugins import Tool, load
from skein.sources import documents

MAPS = {"title": FieldMapping("text"), "category": FieldMapping("keyword"), "price": FieldMapping("number"), "location": FieldMapping("geo_point")}
DOCS = [
    {"id": "r1", "fields": {"title": "Red running shoes", "category": "footwear", "price": 89, "location": {"lat": 12.97, "lon": 77.59}}},
    {"id": "r2", "fields": {"title": "Blue ceramic mug", "category": "kitchen", "price": 12, "location": [77.6, 12.98]}},
    {"id": "r3", "fields": {"title": "Trail running vest", "category": "footwear", "price": 120, "location": "40.7,-74.0"}},
    {"id": "bad", "fields": {"title": "x", "price": "many"}},
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('root')}")
    e.create_index("shop", MAPS, IndexSettings(vector_dimensions=64, embedder="local"))
    e.result = e.bulk("shop", DOCS)
    return e


def ids(r):
    return [x["id"] for x in r.hits.collect()]


def test_bulk_and_dead_letters(engine):
    assert (engine.result["indexed"], engine.result["failed"]) == (3, 1)
    assert engine.store.dead_letters(index="shop").first()["error"].startswith("price: expected number")


def test_modes(engine):
    assert ids(engine.search("shop", {"q": "running", "size": 5})) == ["r1", "r3"] or set(ids(engine.search("shop", {"q": "running"}))) == {"r1", "r3"}
    assert ids(engine.search("shop", {"q": "ceramic mug", "mode": "semantic"}))[0] == "r2"
    assert ids(engine.search("shop", {"q": "ceramic mug", "mode": "hybrid"}))[0] == "r2"
    near = engine.search("shop", {"geo": {"field": "location", "lat": 12.9716, "lon": 77.5946, "distance_km": 10.0}})
    assert ids(near) == ["r1", "r2"] and near.total.first()[0] == 2


def test_page_features(engine):
    r = engine.search("shop", {"q": "running", "filters": [{"field": "price", "gt": 100}], "facets": ["category", "stats:price"], "highlight": True, "projection": "title"})
    row = r.hits.first()
    assert row["id"] == "r3" and "<em>running</em>" in row["highlight_title"] and "price" not in r.hits.columns
    assert [tuple(x) for x in r.facets["category"].collect()] == [("footwear", 1)]
    assert ids(engine.search("shop", {"q": "running", "mustNot": [{"field": "category", "value": "footwear"}]})) == []
    with pytest.raises(EngineError):
        engine.search("shop", {})
    with pytest.raises(EngineError):
        check_window(SearchQuery(q="x", offset=9_999, size=10))


def test_documents_and_snapshots(engine):
    s = engine.store
    assert s.get("shop", "r1").first()["price"] == 89.0 and s.listing("shop", 1, 1)[1] == 3
    sid = s.snapshot("shop")
    s.delete_ids("shop", s.docs("shop").where("id = 'r1'"))
    with pytest.raises(EngineError):
        s.get("shop", "r1")
    s.revert("shop", sid)
    assert s.docs("shop").count() == 3
    assert engine.update_by_query("shop", [{"field": "category", "value": "kitchen"}], {"price": 15.0}) == 1
    assert s.get("shop", "r2").first()["price"] == 15.0 and s.listing("shop")[0].collect()[-1]["id"] == "r2"
    s.alias("store", "shop")
    assert s.resolve("store") == "shop"


def test_parts_vacuum_and_repair(spark, tmp_path):
    from skein.sources.store import Store

    s = Store(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    rows = lambda lo, hi, x: spark.createDataFrame([(i, i, x) for i in range(lo, hi)], "id long, seq long, x string")
    s.upsert("t", rows(0, 100, "old"))
    sid = s.snapshot("t")
    s.upsert("t", rows(90, 110, "new"))
    s.delete_ids("t", rows(0, 5, ""))
    m = s.manifest("t")
    assert [(p["rows"], p["gone"]) for p in m["parts"]] == [(100, False), (20, False), (5, True)]
    got = {r.id: r.x for r in s.docs("t").collect()}
    assert got == {i: "new" if i >= 90 else "old" for i in range(5, 110)}
    for f in (tmp_path / "a/t/v=2").glob("part-*"):
        f.unlink()
    assert {r.id: r.x for r in s.docs("t").collect()} == got
    for k in range(6):
        s.upsert("t", rows(50 + k, 51 + k, f"k{k}"))
    assert len(s.manifest("t")["parts"]) < 8 and s.docs("t").count() == 105 and s.docs("t").where("id = 53").first().x == "k3"
    assert s.vacuum("t") and s.docs("t").count() == 105
    s.revert("t", sid)
    assert s.docs("t").count() == 100 and s.docs("t").where("x = 'old'").count() == 100
    s.clear("t")
    assert s.docs("t").count() == 0
    (part,) = s.manifest("t")["parts"]
    s.fallback = None
    for f in (tmp_path / f"a/t/v={part['v']}").glob("part-*"):
        f.unlink()
    with pytest.raises(EngineError):
        s.docs("t")


def test_second_process_reads_the_postings(engine):
    first = engine.search("shop", {"q": "ceramic"}).hits.collect()
    other = Engine(engine.spark, engine.store.root)
    at = other.store.derived("shop", "postings", other.store.manifest("shop")["version"])
    assert other.store.exists(f"{at}/size/_SUCCESS") and other.search("shop", {"q": "ceramic"}).hits.collect() == first


def test_rest_of_the_fields_and_dimensions(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.create_index("v", {"title": FieldMapping("text"), "vector": FieldMapping("vector")}, IndexSettings(vector_dimensions=3, dynamic_mapping=False, auto_embed=False))
    got = e.bulk("v", [{"id": "a", "fields": {"title": "x", "vector": [1, 2, 3], "attrs": {"k": 1}, "n": 2}, "meta": {"m": True}}, {"id": "b", "fields": {"title": "y", "vector": [1, 2]}}, {"id": "c", "fields": {"title": "z"}}])
    assert (got["indexed"], got["failed"]) == (2, 1) and e.store.dead_letters(index="v").first()["error"] == "ERR_VECTOR_DIM"
    row = e.store.get("v", "a").first()
    assert json.loads(row["extra"]) == {"attrs": '{"k":1}', "n": "2"} and json.loads(row["meta"]) == {"m": True} and e.store.get("v", "c").first()["extra"] is None
    with pytest.raises(EngineError):
        check_window(SearchQuery(q="x", size=101))


def test_replay_and_embedding_anew(engine):
    assert engine.replay("shop")["failed"] == 1
    assert engine.store.dead_letters(index="shop").where("replayed_at IS NOT NULL").count() >= 1
    before = engine.store.get("shop", "r3").first()["vector"]
    engine.update_by_query("shop", [{"field": "price", "value": 120}], {"title": "Winter coat"})
    assert engine.store.get("shop", "r3").first()["vector"] != before


def test_config(engine):
    spec = {"indexes": [{"name": "shop", "mappings": {"brand": {"type": "keyword"}}}, {"name": "new", "settings": {"rrf_k": 10}}]}
    actions = engine.store.plan(spec)
    assert [(a["type"], a["target"]) for a in actions] == [("update_index", "shop"), ("create_index", "new")]
    assert all(a["ok"] for a in engine.store.apply(actions)) and engine.store.plan(spec) == []
    assert [a["type"] for a in engine.store.plan({"indexes": spec["indexes"][:1]}, prune=True)] == ["delete_index"]
    with pytest.raises(EngineError):
        engine.create_index("shop")
    with pytest.raises(EngineError):
        engine.create_index("Bad Name")
    engine.store.drop("new")
    assert "new" not in engine.store.names()


def test_inference(spark):
    cases = [("title", "x", "text"), ("url", "/a", "keyword"), ("price", "12.5", "number"), ("when", "2024-01-02", "date"), ("ok", True, "boolean"), ("n", 3, "number"), ("loc", [1, 2], "geo_point"), ("tags2", ["a"], "keyword"), ("o", {"a": 1}, None), ("note", "one two three four five", "text"), ("code", "abc", "keyword")]
    assert [documents.infer_type(n, v) for n, v, _ in cases] == [t for *_, t in cases]
    rows = spark.createDataFrame([(1, json.dumps({"a": None, "b": 1})), (2, json.dumps({"a": "x y z w v"}))], "seq long, fields string")
    assert {k: v.type for k, v in documents.infer_mappings(rows).items()} == {"a": "text", "b": "number"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "fields": {"t": "x"}}\nbroken\n\n{"t": "bare"}\n')
    (tmp_path / "b.json").write_text('[{"id": "2", "fields": {"t": "y"}}]')
    lines = documents.read_lines(spark, str(tmp_path))
    assert lines.where("valid").count() == 2 and lines.where("NOT valid").first()["value"] == "broken"
    got = {r.fields for r in documents.to_payload(lines.where("valid").unionByName(documents.read_array(spark, str(tmp_path)))).collect()}
    assert got == {'{"t":"x"}', '{"t": "bare"}', '{"t":"y"}'}


def test_plugins(spark):
    r = load()
    assert "OK_BULK" in r.run("list_codes") and r.run("correct_summary", message="Retrieved 1 index(es)") == "Retrieved 1 index"
    with pytest.raises(EngineError):
        r.run("format_message")
    assert load("none").tools() == []
    r.add("shout", [Tool("shout", lambda x: x.upper())])
    r.register_function(spark, "shout", "string")
    assert [x[0] for x in spark.sql("SELECT shout(v) FROM VALUES ('a'), (NULL), ('a') t(v)").collect()] == ["A", None, "A"]
