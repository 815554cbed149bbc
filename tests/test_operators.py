import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import autocomplete, crawl, facets, filters, graph, index, keyword, projection, spatial, vectors
from skein.plans.model import BoostRule, EngineError, FieldMapping, GeoQuery, SearchQuery

MAPS = {"name": FieldMapping("text"), "description": FieldMapping("text"), "category": FieldMapping("keyword")}


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        ("1", 1, "Silk saree", "silk saree with elephant motif", "saree", 89.0), ("2", 2, "Cotton saree", "plain cotton saree", "saree", 40.0),
        ("3", 3, "Brass elephant", "elephant figurine of brass", "decor", 12.0), ("4", 4, "Red running shoes", "lightweight trail runners", "footwear", None),
    ]
    docs = spark.createDataFrame(rows, "id string, seq long, name string, description string, category string, price double").cache()
    return docs, index.build(docs, MAPS)


def ids(df):
    return [r["id"] for r in df.collect()]


def search(shop, q, fields=("name", "description"), **o):
    docs, ix = shop
    return keyword.page(keyword.search_many(ix, docs, [(0, SearchQuery(q=q, **o))], list(fields)).drop("qid"), 0, 10)


def test_bm25_against_plain_python(shop):
    docs, ix = shop
    tokens = {"1": ["silk", "sare"], "2": ["cotton", "sare"], "3": ["brass", "eleph"], "4": ["red", "run", "shoe"]}
    got = {r.id: r.score for r in search(shop, "saree", ["name"]).collect()}
    stems = {k: [t for t in v] for k, v in tokens.items()}
    df, n, avg = 2, 4, sum(map(len, stems.values())) / 4
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / avg))
    assert got == {"1": pytest.approx(want), "2": pytest.approx(want)}


def test_operators_and_boosts(shop):
    assert ids(search(shop, "saree with elephant")) == ["1"]
    assert set(ids(search(shop, "saree elephant"))) == {"1", "2", "3"}
    assert ids(search(shop, "saree elephant", minimum_should_match="100%")) == ["1"]
    assert ids(search(shop, "elephant elephant", operator="AND")) == []
    assert ids(search(shop, "brass elephant", boosts={"name": 3.0}))[0] == "3"


def test_expansion(shop):
    assert set(ids(search(shop, "eleph", prefix=True))) == {"1", "3"}
    assert set(ids(search(shop, "el*nt cotto?"))) in ({"2"}, {"1", "2", "3"})
    assert set(ids(search(shop, "coton", fuzziness=1))) == {"2"}
    assert ids(search(shop, "zzz")) == [] and ids(search(shop, "the of")) == []


def test_phrase(shop):
    assert ids(search(shop, "silk saree", phrase=True)) == ["1"]
    assert ids(search(shop, "silk elephant", ["description"], phrase=True)) == []
    assert ids(search(shop, "silk elephant", ["description"], phrase=True, phrase_slop=2)) == ["1"]


def test_filters_keep_scores(shop):
    free = {r.id: r.score for r in search(shop, "saree").collect()}
    kept = {r.id: r.score for r in search(shop, "saree", filters=[{"field": "price", "lt": 50}]).collect()}
    assert kept == {"2": pytest.approx(free["2"])}


def test_paging_and_cursor(shop):
    docs, ix = shop
    hits = keyword.search_many(ix, docs, [(0, SearchQuery(q="saree elephant"))], ["name", "description"]).drop("qid").cache()
    every = ids(keyword.page(hits, 0, 10))
    assert ids(keyword.page(hits, 0, 2)) + ids(keyword.page(hits, 2, 2)) == every
    assert ids(keyword.page(hits, size=5, search_after=every[0])) == every[1:]
    assert ids(keyword.page(hits, size=5, search_after="none")) == every


def test_many_queries_in_one_plan(shop):
    docs, ix = shop
    got = keyword.pages(keyword.search_many(ix, docs, [(1, SearchQuery(q="cotton")), (2, SearchQuery(q="brass"))], ["name"]), 5)
    assert {(r.qid, r.id) for r in got.collect()} == {(1, "2"), (2, "3")}


def test_term_and_range(spark):
    df = spark.createDataFrame([(1, "5", 5.0, True), (2, "x", None, None), (3, "07", 7.0, False)], "id int, s string, n double, b boolean")
    pick = lambda c: ids(df.where(c))
    assert pick(filters.term(df, "s", 5)) == [1] and pick(filters.term(df, "n", "5")) == [1] and pick(filters.term(df, "n", "5.0")) == []
    assert pick(filters.term(df, "b", "true")) == [1] and pick(filters.term(df, "nope", "undefined")) == [] and pick(filters.term(df, "n", "5", True)) == []
    assert pick(filters.value_range(df, "s", gte=6)) == [2, 3] and pick(filters.value_range(df, "s", gte="w")) == [2] and pick(filters.value_range(df, "n")) == [1, 3]
    assert pick(filters.value_range(df, "b", gte=0)) == []
    with pytest.raises(EngineError):
        filters.value_range(df, "n", gte=float("nan"))
    assert pick(filters.bool_clauses(df, [{"field": "s", "value": "x"}], [])) == [2] and pick(filters.bool_clauses(df, [], [{"field": "s", "value": "x"}])) == [1, 3]


def test_boost_rules(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, None)], "id string, score double, c string")
    out = filters.apply_boost_rules(df, [BoostRule([{"field": "c", "equals": "x"}], 3.0, 0.1), BoostRule([{"field": "c", "exists": False}], None, 1.0)])
    assert {r.id: r.score for r in out.collect()} == {"a": 3.1, "b": 3.0}


def test_facets(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, "b", 12.0), (3, "b", None)], "seq int, k string, n double")
    assert [tuple(r) for r in facets.facet(df, "k", "seq").collect()] == [("b", 2), ("a", 1)]
    assert tuple(facets.facet(df, "stats:n").first()) == (2, 1.5, 12.0, 6.75, 13.5)
    assert [tuple(r) for r in facets.facet(df, "histogram:n:10").collect()] == [(0.0, 1), (10.0, 1)]
    assert facets.histogram(df, "n", 0).count() == 0 and tuple(facets.stats(df.limit(0), "n").first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(facets.merge_stats([facets.stats(df, "n"), facets.stats(df.limit(0), "n")]).first()) == (2, 1.5, 12.0, 6.75, 13.5)


def test_projection(spark):
    df = spark.createDataFrame([("1", "t", {"a": "x", "c": {"e": "m"}}, [1.0], "z")], "id string, title string, meta struct<a:string,c:struct<e:string>>, vector array<double>, price string")
    names = lambda **k: projection.project(df, **k).columns
    assert names() == ["id", "title", "meta", "price"] and names(spec=False) == ["id"] and names(spec="title -id") == ["title"]
    assert names(spec=["ti*"]) == ["id", "title"] and names(spec={"price": 0}) == ["id", "title", "meta"] and names(spec={"includes": ["price"], "excludes": ["title"]}) == ["id", "price"]
    nested = projection.project(df, spec="meta.c.e").first().asDict(True)
    assert nested == {"id": "1", "meta": {"c": {"e": "m"}}}
    assert projection.project(df, spec="-meta.c").first().asDict(True)["meta"] == {"a": "x"}
    assert projection.parse_parameter('{"a": 1}') == {"a": 1} and projection.parse_parameter("a,b") == "a,b"


def test_vectors(spark):
    v = spark.createDataFrame([("doc1", [1.0, 0.0, 0.0]), ("doc2", [0.0, 2.0, 0.0]), ("doc3", [0.5, 0.5, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("bad", [1.0]), ("none", None)], "id string, vec array<float>")
    assert ids(vectors.knn(v, [1, 0, 0], 2)) == ["doc1", "doc3"] and ids(vectors.knn(v, [1, 1, 0], 1, "dot")) == ["doc2"] and ids(vectors.knn(v, [0, 2, 0], 1, "euclidean")) == ["doc2"]
    assert ids(vectors.knn(v, [1, 0, 0], 5, min_score=0.5)) == ["doc1", "doc3"]
    assert {r.id for r in vectors.knn_many(v, {0: [1, 0, 0], 1: [0, 1, 0]}, 1).collect()} == {"doc1", "doc2"}
    q = v.where("id = 'doc3'").select(vectors.dequantize(vectors.quantize(F.col("vec")))).first()[0]
    assert np.allclose(q, [0.5, 0.5, 0], atol=0.01)
    good, bad = vectors.check_dims(v, 3)
    assert good.count() == 4 and {r.id for r in bad.collect()} == {"bad", "none"}
    s = spark.createDataFrame([("a", 0.8), ("b", 0.5), ("c", 0.05)], "id string, score double")
    assert set(ids(vectors.noise_floor(s))) == {"a", "b"}
    rrf = {r.id: r.score for r in vectors.reciprocal_rank([s, s.where("id <> 'a'")]).collect()}
    assert rrf["b"] == pytest.approx(1 / 62 + 1 / 61) and rrf["a"] == pytest.approx(1 / 61)
    lin = {r.id: r.score for r in vectors.linear(s, s.limit(0), 0.5).collect()}
    assert lin["a"] == 0.5 and lin["c"] == 0.0


def test_graph(spark):
    e = spark.createDataFrame([("p", "Elephant saree", "product", ["jumbo"], ["doc-101"], 1), ("m", "Motif", "motif", None, [], 2), ("c", "Craft", "craft", [], ["d2"], 3)], "id string, name string, type string, aliases array<string>, doc_ids array<string>, seq int")
    t = spark.createDataFrame([("p", "has", "m", 1.0, 1), ("m", "of", "c", 1.0, 2)], "subject string, predicate string, object string, weight double, seq int")
    nodes, edges = graph.neighborhood(t, spark.createDataFrame([("p",)], "id string"), 1)
    assert {r.id for r in nodes.collect()} == {"p", "m"} and edges.count() == 1
    assert graph.neighborhood(t, spark.createDataFrame([("p",)], "id string"), 2)[0].count() == 3
    assert ids(graph.find_by_name(e, "JUMBO")) == ["p"]
    found = graph.search(e, t, "elephant")
    assert {r.doc_id for r in found["doc_ids"].collect()} == {"doc-101"} and graph.add_triples(t, t.withColumn("subject", F.lit(""))).count() == 2


def test_autocomplete_and_suggest(shop):
    docs, ix = shop
    assert [r.term for r in keyword.suggest(ix, "sa", ["name"]).collect()] == ["sare"]
    got = {(r.text, r.type) for r in autocomplete.complete(ix, docs, "sare").collect()}
    assert {("sare", "query"), ("saree", "query"), ("Silk saree", "document")} <= got
    assert autocomplete.complete(ix, docs, " ").count() == 0


def test_crawl(spark):
    rows = [("http://a/", 200, ["http://a/1", "http://b/", "http://a/x#f"]), ("http://a/1", 200, ["http://a/2"]), ("http://a/2", 404, ["http://a/3"]), ("http://a/3", 200, []), ("http://a/x", 200, None)]
    pages = spark.createDataFrame(rows, "url string, status int, links array<string>")
    got = {(r.url, r.depth) for r in crawl.crawl(pages, pages.limit(1), ["a"], deny=["/x"]).collect()}
    assert got == {("http://a/", 0), ("http://a/1", 1), ("http://a/2", 2)}
    assert crawl.crawl(pages, pages.limit(1), max_pages=2).count() == 2


def test_crawl_has_no_default_bounds(spark):
    rows = [(f"http://a/{i:03}", 200, []) for i in range(600)] + [("http://a/000", 200, ["http://a/c0"])] + [(f"http://a/c{i}", 200, [f"http://a/c{i + 1}"]) for i in range(12)]
    pages = spark.createDataFrame(rows, "url string, status int, links array<string>")
    got = [(r.url, r.depth) for r in crawl.crawl(pages, pages.where("url NOT LIKE '%c%'")).collect()]
    assert len(got) == 612 and dict(got)["http://a/c11"] == 12
    assert crawl.crawl(pages, pages.where("url NOT LIKE '%c%'"), max_depth=2).count() == 602


def _brute(points, km):
    out = set()
    for i, (a, x, y) in enumerate(points):
        for b, u, v in points[i + 1 :]:
            if spatial.distance_km(np.array(x), np.array(y), np.array(u), np.array(v)) <= km:
                out.add((min(a, b), max(a, b)))
    return out


def test_near_pairs_everywhere(spark):
    rng = np.random.default_rng(4)
    lat = np.concatenate([rng.uniform(89.5, 90, 60), rng.uniform(-1, 1, 60), [10.0] * 30, rng.uniform(-90, -89.8, 30)])
    lon = np.concatenate([rng.uniform(-180, 180, 60), np.where(rng.random(60) < 0.5, rng.uniform(179, 180, 60), rng.uniform(-180, -179, 60)), [20.0] * 30, rng.uniform(-180, 180, 30)])
    points = [(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    df = spark.createDataFrame(points, "id string, lat double, lon double")
    for km, hot in ((0.001, 20000), (20.0, 10), (500.0, 25)):
        rows = [(r.id_a, r.id_b) for r in spatial.near_pairs(df, km, hot).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == _brute(points, km)
    assert spatial.near_pairs(df.limit(0), 1.0).count() == 0


def test_latest_points_and_regions(spark):
    rows = [("a", 1, 1.0, 1.0), ("a", 2, 5.0, 179.5), ("b", 1, None, 1.0), ("c", 1, 0.0, 0.0), ("d", 1, 95.0, 0.0), ("e", 1, 5.0, -179.5), (None, 1, 5.0, 5.0), ("e", 1, 5.0, -179.5)]
    p = spatial.latest_points(spark.createDataFrame(rows, "id string, seq int, lat double, lon double"))
    assert {(r.id, r.lon) for r in p.collect()} == {("a", 179.5), ("e", -179.5)}
    ring = [(0.0, 179.0), (10.0, 179.0), (10.0, 181.0), (0.0, 181.0)]
    g = spark.createDataFrame([("z", [dict(lat=a, lon=b) for a, b in ring]), ("empty", [])], "area_id string, ring array<struct<lat:double,lon:double>>")
    assert {tuple(r) for r in spatial.containing_regions(p, g).collect()} == {("a", "z"), ("e", "z")}


def test_geo_query_checks(spark):
    with pytest.raises(EngineError):
        GeoQuery("location").check()
    with pytest.raises(EngineError):
        GeoQuery("location", 99.0, 0.0).check()
