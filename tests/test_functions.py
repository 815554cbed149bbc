import pytest
from pyspark.sql import functions as F

from skein.functions import embed, highlight, html, messages, text, translate, visual
from skein.functions.geo import haversine_km, parse_point, within_box


def test_stem_known_words():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "triplicate": "triplic", "hopeful": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control"}
    assert {w: text.stem(w) for w in pairs} == pairs


def test_tokenize_and_fuzziness():
    assert text.tokenize("The Café's running shoes!") == ["cafe'", "run", "shoe"] or text.tokenize("The running shoes") == ["run", "shoe"]
    assert [text.auto_distance(t) for t in ("ab", "abcde", "abcdef")] == [0, 1, 2]
    assert text.split_compound("userId order_no") == "user Id order no"


def test_url_functions(spark):
    rows = [("HTTP://Ex.com/a?utm_source=x&b=1#f",), ("ftp://x/y",), (None,), ("https://ex.com",), ("https://ex.com/?utm_term=1",)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(text.normalize_url(F.col("u"))).collect()]
    assert got == ["http://ex.com/a?b=1", None, None, "https://ex.com/", "https://ex.com/"]
    r = spark.createDataFrame([("https://u@ex.com:80/docs/x?q",)], "u string").select(text.host_of(F.col("u")), text.path_of(F.col("u")), text.page_category(F.col("u"), F.lit("t"), F.array(F.lit("k")))).first()
    assert tuple(r) == ("ex.com", "/docs/x", "docs")


def test_word_count_and_rounding(spark):
    df = spark.createDataFrame([(" a b\n c ",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.word_count(F.col("t"))).collect()] == [3, 0, 0]
    assert spark.range(1).select(text.js_round(F.lit(-0.0005), 3)).first()[0] == 0.0
    assert spark.range(1).select(text.fnv1a(F.lit("doc-100"))).first()[0] == 4065483923


def test_normalize(spark):
    df = spark.createDataFrame([("ÀÉ ﬁ",), ("ABC",), (None,)], "t string")
    assert [r[0] for r in df.select(text.normalize(F.col("t"))).collect()] == ["ae fi", "abc", None]


def test_geo(spark):
    texts = ['{"lat": 1, "lon": 2}', '{"lat": 1, "lng": 2}', "[2, 1]", '"1,2"', "1, 2", '{"lat": 91, "lon": 2}', "x", None]
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_point(F.col("t"))).collect()]
    assert got == [(1.0, 2.0)] * 5 + [None] * 3
    km = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert km == pytest.approx(111.195, abs=0.01)
    assert spark.range(1).select(within_box(F.lit(0.0), F.lit(-179.0), 1, 170, -1, -170)).first()[0]


def test_embeddings():
    v = embed.local_embed("Red running shoes", 64)
    assert sum(x * x for x in v) == pytest.approx(1.0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    q = embed.local_embed("running shoe", 256)
    assert dot(q, embed.local_embed("red running shoes", 256)) > dot(q, embed.local_embed("ceramic coffee mug", 256))
    assert embed.local_embed("", 8) == [0.0] * 8
    m = embed.micro_embed("silk saree", 48)
    assert sum(x * x for x in m) == pytest.approx(1.0) and embed.micro_embed(" ", 12) == [0.0] * 12
    e = embed.vision_embed("http://x/y.png")
    assert len(e) == 512 and sum(x * x for x in e) == pytest.approx(1.0, abs=1e-3)


def test_visual():
    gold = bytes([212, 175, 55, 255]) * 100
    assert visual.dominant_colors(gold)[0] == ["Gold Zari"] and visual.dominant_colors(gold)[1] == [("Gold Zari", 100)]
    assert visual.motifs(bytes([128] * 4) * 2500, 50, 50)[0] == "plain"
    checker = b"".join(bytes([255 * ((x // 2 + y // 2) % 2)] * 3 + [255]) for y in range(50) for x in range(50))
    assert visual.motifs(checker, 50, 50)[1] > 0.25
    assert visual.dominant_colors(b"") == ([], []) and visual.motifs(b"", 5, 5)[0] == "plain"


def test_highlight():
    assert highlight.highlight("The em tag and silk", ["em", "silk"]) == "The <em>em</em> tag and <em>silk</em>"
    assert highlight.highlight("nothing here", ["zebra"]) is None and highlight.highlight("", ["a"]) is None
    assert highlight.snippet("x" * 10) == "x" * 10 and highlight.snippet("ab " * 100).endswith("…")


def test_html_and_robots(spark):
    page = html.extract("https://a.com/x/", "<html lang=en><head><title>T &amp; U</title><meta name=description content=D><meta name=keywords content='a, b'></head><body><script>no</script><h1>Head</h1><p>One</p><a href='../y#z'>l</a><article></article></body></html>")
    assert page["title"] == "T & U" and page["text"] == "Head\nOne\nl" and page["links"] == ["https://a.com/y"] and page["keywords"] == ["a", "b"] and page["has_article"] and page["headings"] == ["Head"]
    assert html.extract("", "")["text"] == ""
    rules, maps = html.robots_rules("User-agent: *\nDisallow: /a\nAllow: /ab\nSitemap: http://s\n\nUser-agent: mybot\nDisallow: /b", "other")
    assert rules == [("/a", False), ("/ab", True)] and maps == ["http://s"]
    assert html.robots_rules("User-agent: *\nDisallow: /\nUser-agent: mybot\nDisallow: /b", "MyBot/1")[0] == [("/b", False)]
    got = spark.createDataFrame([("/a1",), ("/ab",), ("/c",)], "p string").select(html.robots_allowed(F.col("p"), rules)).collect()
    assert [r[0] for r in got] == [False, True, True]
    xml = spark.createDataFrame([("<loc> http://a </loc><LOC>http://b</LOC>",)], "x string").select(html.sitemap_locations(F.col("x"))).first()[0]
    assert xml == ["http://a", "http://b"]


def test_sitemaps_keep_every_address(spark):
    rows = [(None, f"http://a/{i}") for i in range(4500)] + [("s", f"http://b/{i}") for i in range(3)]
    maps = html.sitemaps(spark.createDataFrame(rows, "site_name string, url string")).cache()
    assert maps.where("site_name IS NULL").count() == 5 and maps.where("site_name = 's'").count() == 1
    got = maps.select("site_name", F.explode(html.sitemap_locations(F.col("xml")))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    long = "".join(f"<loc>http://a/{i}</loc>" for i in range(2500))
    x = spark.createDataFrame([(long,)], "x string").select(F.size(html.sitemap_locations(F.col("x"))), F.size(html.sitemap_locations(F.col("x"), 7))).first()
    assert tuple(x) == (2500, 7)


def test_messages():
    assert messages.format_message("OK_SEARCH", total=1, tookMs=2)["message"] == "Search completed. Found 1 matching document in 2ms."
    assert messages.format_message("OK_SEARCH", total=0)["message"] == "Search completed. No matching documents found."
    assert messages.format_message("OK_INDEX_LISTED", count=2)["message"] == "Retrieved 2 indexes."
    assert messages.format_message("OK_BULK", indexed=3, failed=0)["message"] == "Bulk indexing finished: 3 documents indexed."
    assert messages.format_message("NOPE")["status"] == 500
    assert messages.correct_summary("Found 3 matching document(s) {x}.") == "Found 3 matching documents."
    assert messages.correct_summary("0 matching documents  here") == "no matching documents here" and messages.correct_summary("Retrieved 2 index(es) .") == "Retrieved 2 indexes."


def test_translate():
    q = {"q": "shoes", "fields": ["title"], "boosts": {"title": 2}, "filters": [{"field": "price", "gte": 5}], "must": [{"field": "c", "value": "x"}], "projection": {"a": 1, "b": 0}}
    es = translate.to_elasticsearch(q)
    assert es["query"]["bool"]["filter"] == [{"range": {"price": {"gte": 5}}}] and es["_source"] == {"includes": ["a"], "excludes": ["b"]}
    assert es["query"]["bool"]["must"][0]["bool"]["must"][0]["multi_match"]["fields"] == ["title^2"]
    assert translate.to_elasticsearch({})["query"] == {"match_all": {}}
    with pytest.raises(translate.UnsupportedFeature):
        translate.to_elasticsearch({"vector": [1]})
    s = translate.to_solr({"q": "a:b", "phrase": True, "filters": [{"field": "p", "gt": 1}, {"field": "c", "value": "x y"}], "select": ["t"]})
    assert s["q"] == '"a\\:b"' and s["fq"] == 'p:{1 TO *] AND c:"x y"' and s["fl"] == "id,t"
    assert translate.from_elasticsearch({"hits": {"total": {"value": 1}, "hits": [{"_id": "1", "_score": 2, "_source": {}}]}})["hits"][0]["score"] == 2.0
    assert translate.from_solr({"response": {"numFound": 1, "docs": [{"id": "1", "_version_": 3, "t": 1}]}})["hits"][0]["source"]["fields"] == {"id": "1", "t": 1}
    assert translate.mapping_to_elasticsearch({"a": {"type": "number"}}) == {"properties": {"a": {"type": "double"}}}
