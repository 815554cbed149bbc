"""Registered queries of the core operators and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, spread, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- points ---------------------------------------------------------------------------------------------------------

_POINTS = """last AS (SELECT id, unnest(max(struct_pack(seq, lat := fields.location.lat, lon := fields.location.lon)), recursive := true) FROM articles WHERE id IS NOT NULL GROUP BY id),
pts AS (SELECT id, lat, lon FROM last WHERE abs(lat) <= 90 AND abs(lon) <= 180 AND NOT (lat = 0 AND lon = 0))"""
_KM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_AREAS = """corners AS (SELECT area_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM geo_areas),
edges AS (SELECT area_id, ring[i].lat AS y1, ring[i].lon AS x1, ring[i % len(ring) + 1].lat AS y2, ring[i % len(ring) + 1].lon AS x2 FROM corners),
inside AS (SELECT id, area_id FROM (SELECT id, lat, lon + t.turn AS x, turn FROM pts, (VALUES (-360), (0), (360)) t(turn)) p JOIN edges e
 ON (y1 > lat) <> (y2 > lat) AND x < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, area_id, turn HAVING count(*) % 2 = 1)"""


def _article_points(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.spatial import latest_points

    rows = table(spark, d, "articles").select("id", "seq", F.col("fields.location.lat").alias("lat"), F.col("fields.location.lon").alias("lon"))
    return scratch(latest_points(rows), "points")


@query(f"""WITH {_POINTS}, {_AREAS} SELECT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM pts a JOIN pts b ON a.id < b.id AND abs(a.lat - b.lat) < 0.01 WHERE {_KM} <= 0.15
 UNION ALL SELECT DISTINCT id, area_id FROM inside""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.spatial import containing_regions, near_pairs

    points = _article_points(spark, d)
    pairs = near_pairs(points, 0.15).select("id_a", "id_b")
    regions = containing_regions(points, table(spark, d, "geo_areas")).select(F.col("id").alias("id_a"), F.col("area_id").alias("id_b"))
    return pairs.unionByName(regions)


@query(f"""WITH {_POINTS} SELECT id, count(*) AS n_near, min(km) AS nearest_km FROM (
 SELECT a.id, round({_KM}, 6) AS km FROM pts a JOIN pts b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.1 WHERE {_KM} <= 1.0) GROUP BY id""")
def p1_near_counts(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.spatial import near_pairs

    pairs = near_pairs(_article_points(spark, d), 1.0)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id"), "km")
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.round("km", 6)).alias("nearest_km"))


# --- scans, filters, facets, projections ------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def scan_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(40).limit(20)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


def _where(spark: SparkSession, d: str, name: str, clauses: list[dict]) -> DataFrame:
    from skein.operators.filters import all_of

    df = table(spark, d, name)
    return df.where(all_of(df, clauses))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 7")
def filter_term(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "lineitem", [{"field": "l_returnflag", "value": "R"}, {"field": "l_quantity", "value": "7"}]).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12.5 AND l_discount <= 0.05")
def filter_range_num(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "lineitem", [{"field": "l_quantity", "gte": 10, "lt": "12.5"}, {"field": "l_discount", "lte": 0.05}]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '2' AND o_orderpriority < '4'")
def filter_range_str(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "orders", [{"field": "o_orderpriority", "gte": "2-", "lt": "4-"}]).select("o_orderkey", "o_orderpriority")


SQL["filter_range_str"] = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '2-' AND o_orderpriority < '4-'"


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey = 3")
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "customer", [{"field": "c_mktsegment", "value": "BUILDING"}, {"field": "c_acctbal", "gt": 0}, {"field": "c_nationkey", "value": 3}]).select("c_custkey")


@query("""SELECT p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60) WHERE (p_brand = 'Brand#11' OR p_size = 7 OR p_size > 20 AND p_size = 21) AND p_brand <> 'Brand#12'""")
def bool_post_window(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.filters import bool_clauses

    p = table(spark, d, "part")
    window = p.orderBy(F.desc("p_retailprice"), "p_partkey").limit(60)
    cond = bool_clauses(p, [{"field": "p_brand", "value": "Brand#11"}, {"field": "p_size", "value": 7}, {"field": "p_size", "value": 21}], [{"field": "p_brand", "value": "Brand#12"}])
    return window.where(cond).select("p_partkey", "p_retailprice")


@query("SELECT p_partkey FROM part WHERE (p_brand = 'Brand#11' OR p_size = 7) AND NOT (p_brand = 'Brand#12')")
def bool_must_should_not(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.filters import bool_clauses

    p = table(spark, d, "part")
    return p.where(bool_clauses(p, [{"field": "p_brand", "value": "Brand#11"}, {"field": "p_size", "value": 7}], [{"field": "p_brand", "value": "Brand#12"}])).select("p_partkey")


@query("SELECT l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY 1")
def facet_terms(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import facet

    return facet(table(spark, d, "lineitem"), "l_returnflag")


@query("SELECT count(l_extendedprice) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS avg, round(sum(l_extendedprice), 2) AS sum FROM lineitem")
def facet_stats(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import facet

    return facet(table(spark, d, "lineitem"), "stats:l_extendedprice").withColumns({"avg": F.round("avg", 4), "sum": F.round("sum", 2)})


@query("SELECT floor(l_quantity / 5) * 5 AS key, count(*) AS count FROM lineitem GROUP BY 1")
def facet_histogram(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import facet

    return facet(table(spark, d, "lineitem"), "histogram:l_quantity:5")


@query("SELECT p_brand AS key, count(*) AS count FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100) GROUP BY 1")
def facet_page_scope(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import terms

    page = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    return terms(page, "p_brand")


@query("SELECT date_trunc('month', o_orderdate) AS key, count(*) AS count FROM orders GROUP BY 1")
def facet_date_histogram(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import date_histogram

    return date_histogram(table(spark, d, "orders"), "o_orderdate", "month").withColumn("key", F.col("key").cast("timestamp_ntz"))


@query("SELECT p_brand, p_size, count(*) AS count FROM part GROUP BY ROLLUP (p_brand, p_size)")
def facet_nested(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import nested

    return nested(table(spark, d, "part"), ["p_brand", "p_size"])


@query("SELECT l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY 1")
def facet_merge(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.facets import merge_terms, terms

    li = table(spark, d, "lineitem")
    return merge_terms([terms(li.where(F.col("l_orderkey") % 2 == k), "l_returnflag") for k in (0, 1)])


def _projected(spark: SparkSession, d: str, **how) -> DataFrame:
    from skein.operators.projection import project

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return project(c, **how)


@query("SELECT c_custkey AS id, c_name, c_acctbal FROM customer")
def projection_include(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, spec="c_name, c_acctbal")


@query("SELECT c_name, c_nationkey, c_mktsegment FROM customer")
def projection_exclude(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, spec={"c_acctbal": 0, "_id": 0})


@query("SELECT c_custkey AS id, c_name, c_nationkey FROM customer")
def projection_glob(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, spec={"includes": ["c_na*"]})


@query("SELECT c_custkey AS id, c_mktsegment FROM customer")
def field_acl(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.projection import for_role

    return for_role(_projected(spark, d), "viewer", {"viewer": ["c_mktsegment"]})


@query("SELECT id FROM articles QUALIFY row_number() OVER (ORDER BY id, seq) BETWEEN 11 AND 20")
def offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").orderBy("id", "seq").offset(10).limit(10).select("id")


# --- keyword search ---------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+(?:''[a-z0-9]+)?'), lambda x: length(x) > 1)"


def _tok(column: str = "text", name: str = "t") -> str:
    words = _TOKENS.format(c=column)
    return f"""{name}w AS (SELECT doc_id, {words} AS w FROM documents WHERE {column} IS NOT NULL),
{name}tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM {name}w),
{name}dl AS (SELECT doc_id, count(*) AS dl FROM {name}tok GROUP BY 1), {name}avg AS (SELECT avg(dl) AS a FROM {name}dl), {name}n AS (SELECT count(*) AS n FROM documents),
{name}post AS (SELECT doc_id, term, count(*) AS tf FROM {name}tok GROUP BY 1, 2), {name}df AS (SELECT term, count(*) AS df, min(doc_id) AS fd FROM {name}post GROUP BY 1)"""


_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / a))"


def _bm25_sql(words: list[str], extra: str = "", having: str = "", boost: str = "1.0", phrase: str = "") -> str:
    ws = ", ".join(f"('{w}', {i})" for i, w in enumerate(words))
    both = f"* CASE WHEN count(DISTINCT q.word) = {len(words)} THEN 1.35 ELSE 1.0 END" if len(words) > 1 else ""
    exact = f"* CASE WHEN contains(lower(max(d.text)), '{phrase or ' '.join(words)}') THEN 1.5 ELSE 1.0 END" if len(words) > 1 else ""
    return f"""WITH {_tok()}, q(word, ord) AS (VALUES {ws})
 SELECT p.doc_id AS id, round(sum({_BM25} * {boost}) {both} {exact}, 6) AS score FROM q JOIN tpost p ON p.term = q.word JOIN tdf USING (term) JOIN tdl USING (doc_id) JOIN documents d USING (doc_id), tavg, tn
 {extra} GROUP BY p.doc_id {having}"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "title", "text", "lang", "source")


_BUILT: dict = {}
_PLAIN = {"stopwords": False, "stemming": False}


def _index(spark: SparkSession, d: str, fields: tuple[str, ...] = ("text",)):
    """The plain-token index of documents, built once a session and directory and read by every query."""
    from skein.operators.index import build
    from skein.plans.model import FieldMapping

    key = (spark.sparkContext.applicationId, d, fields)
    if key not in _BUILT:
        maps = {f: FieldMapping("keyword" if f in ("source", "lang") else "text") for f in fields}
        _BUILT[key] = build(_docs(spark, d), maps, **_PLAIN, ascii_only=True)
    return _BUILT[key]


def _search(spark: SparkSession, d: str, q: str, fields: tuple[str, ...] = ("text",), **options) -> DataFrame:
    from skein.operators.keyword import search_many
    from skein.plans.model import SearchQuery

    hits = search_many(_index(spark, d, fields), _docs(spark, d), [(0, SearchQuery(q=q, **options))], list(fields), analysis=_PLAIN)
    return hits.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_tok()} SELECT doc_id, term, count(*) AS tf FROM ttok GROUP BY ALL")
def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).postings.select(F.col("id").alias("doc_id"), "term", "tf")


@query(f"WITH {_tok()} SELECT term, df, fd AS first_seq FROM tdf")
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", "first_seq")


@query(_bm25_sql(["harbour"]))
def bm25_single(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbour")


@query(_bm25_sql(["quiet", "harbour", "office"]))
def bm25_multi_term(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "quiet harbour office")


@query(_bm25_sql(["harbour", "office"], having="HAVING count(DISTINCT q.word) = 2"))
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbour office", operator="AND")


@query(_bm25_sql(["quiet", "harbour", "office", "records"], having="HAVING count(DISTINCT q.word) >= 3"))
def min_should_match(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "quiet harbour office records", minimum_should_match="75%")


@query(_bm25_sql(["harbour", "office"], extra="WHERE d.lang = 'en' AND d.doc_id >= 100"))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbour office", filters=[{"field": "lang", "value": "en"}, {"field": "id", "gte": 100}])


@query(f"""WITH {_tok()}, {_tok('title', 's')}, q(word) AS (VALUES ('harbour'), ('office')),
 parts AS (SELECT p.doc_id, q.word, {_BM25} AS x FROM q JOIN tpost p ON p.term = q.word JOIN tdf USING (term) JOIN tdl USING (doc_id), tavg, tn
  UNION ALL SELECT p.doc_id, q.word, 3 * {_BM25} FROM q JOIN spost p ON p.term = q.word JOIN sdf USING (term) JOIN sdl USING (doc_id), savg, sn)
 SELECT doc_id AS id, round(sum(x) * CASE WHEN count(DISTINCT word) = 2 THEN 1.35 ELSE 1 END * CASE WHEN contains(lower(max(d.text)), 'harbour office') OR coalesce(contains(lower(max(d.title)), 'harbour office'), false) THEN 1.5 ELSE 1 END, 6) AS score
 FROM parts JOIN documents d USING (doc_id) GROUP BY doc_id""")
def bm25_two_fields_boost(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbour office", ("title", "text"), boosts={"title": 3.0})


def _expanded_sql(match: str, order: str = "fd, fp") -> str:
    return f"""WITH {_tok()}, fp AS (SELECT term, min(pos) AS fp FROM ttok JOIN tdf USING (term) WHERE doc_id = fd GROUP BY 1),
 v AS (SELECT term, df, dist FROM (SELECT term, df, fd, fp, {match} AS dist FROM tdf JOIN fp USING (term)) WHERE dist IS NOT NULL ORDER BY {order}, term LIMIT 50)
 SELECT p.doc_id AS id, round(sum({_BM25} / (1 + dist)), 6) AS score FROM v JOIN tpost p USING (term) JOIN tdl USING (doc_id), tavg, tn GROUP BY p.doc_id"""


@query(_expanded_sql("CASE WHEN starts_with(term, 'ha') THEN 0 END"))
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "ha", prefix=True)


@query(_expanded_sql("CASE WHEN regexp_full_match(term, 'h.*r') THEN 0 END"))
def wildcard_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "h*r")


@query(_expanded_sql("CASE WHEN abs(length(term) - 7) <= 2 AND levenshtein(term, 'harbuor') <= 2 THEN levenshtein(term, 'harbuor') END", "CASE WHEN dist = 0 THEN 0 ELSE 1 END, fd, fp"))
def fuzzy_expand(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbuor", fuzziness=2)


@query(SQL["fuzzy_expand"])
def fuzzy_auto(spark: SparkSession, d: str) -> DataFrame:
    """A misspelt word of seven letters, for which AUTO allows two edits."""
    return _search(spark, d, "harbuor", fuzziness="AUTO")


@query(f"""WITH {_tok()} SELECT doc_id AS id, 2.5 * 1.35 * CASE WHEN contains(lower(max(d.text)), 'harbour office') THEN 1.5 ELSE 1 END AS score
 FROM (SELECT DISTINCT a.doc_id FROM ttok a JOIN ttok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'harbour' AND b.term = 'office') JOIN documents d USING (doc_id) GROUP BY doc_id""")
def phrase(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "harbour office", phrase=True)


@query(f"""WITH {_tok()} SELECT doc_id AS id, 2.5 * 1.35 * CASE WHEN contains(lower(max(d.text)), 'every office') THEN 1.5 ELSE 1 END AS score
 FROM (SELECT DISTINCT a.doc_id FROM ttok a JOIN ttok b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.term = 'every' AND b.term = 'office') JOIN documents d USING (doc_id) GROUP BY doc_id""")
def phrase_slop(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, "every office", phrase=True, phrase_slop=2)


@query(f"SELECT id, score FROM ({_bm25_sql(['quiet', 'harbour', 'office'])}) ORDER BY score DESC, id LIMIT 10")
def topk_score(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.keyword import page

    return page(_search(spark, d, "quiet harbour office"), 0, 10)


@query(f"""WITH ranked AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_bm25_sql(['quiet', 'harbour', 'office'])}))
 SELECT id, score FROM ranked WHERE r > 10 ORDER BY r LIMIT 10""")
def search_after(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.keyword import page

    hits = scratch(_search(spark, d, "quiet harbour office"), "hits")
    last = page(hits, 0, 10).orderBy("score", F.desc("id")).first()
    return page(hits, size=10, search_after=last["id"] if last else None)


@query(f"""WITH b AS ({_bm25_sql(['harbour', 'office'])}) SELECT id, CASE WHEN lang = 'en' THEN floor((score * 2 + 0.5) * 1000 + 0.5) / 1000 ELSE score END AS score FROM b JOIN documents ON doc_id = id""")
def boost_rules(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.filters import apply_boost_rules
    from skein.plans.model import BoostRule

    rows = _search(spark, d, "harbour office").join(_docs(spark, d), "id")
    return apply_boost_rules(rows, [BoostRule([{"field": "lang", "equals": "en"}], 2.0, 0.5)]).select("id", "score")


@query(f"WITH {_tok()}, fp AS (SELECT term, min(pos) AS fp FROM ttok JOIN tdf USING (term) WHERE doc_id = fd GROUP BY 1) SELECT term FROM tdf JOIN fp USING (term) WHERE starts_with(term, 'pa') ORDER BY fd, fp LIMIT 10")
def suggest(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.keyword import suggest as run

    return run(_index(spark, d), "pa")


@query(f"""WITH {_tok()}, words AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS i FROM tdf WHERE length(term) > 3 QUALIFY i <= 1000),
 asked AS (SELECT a.i AS qid, a.term AS x, b.term AS y FROM words a JOIN words b ON b.i = a.i + 1), q AS (SELECT qid, x AS word FROM asked UNION ALL SELECT qid, y FROM asked),
 parts AS (SELECT qid, p.doc_id, word, {_BM25} AS s FROM q JOIN tpost p ON p.term = q.word JOIN tdf USING (term) JOIN tdl USING (doc_id), tavg, tn),
 sums AS (SELECT qid, doc_id, sum(s) * CASE WHEN count(*) = 2 THEN 1.35 ELSE 1 END AS s FROM parts GROUP BY ALL),
 near AS (SELECT *, nth_value(s, 10) OVER (PARTITION BY qid ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t FROM sums),
 full_ AS (SELECT qid, doc_id AS id, round(n.s * CASE WHEN contains(lower(d.text), x || ' ' || y) THEN 1.5 ELSE 1 END, 6) AS score FROM near n JOIN asked USING (qid) JOIN documents d USING (doc_id) WHERE t IS NULL OR n.s * 1.5 >= t)
 SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM full_ QUALIFY rank <= 10""")
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    """A thousand requests of two words of the dictionary in one plan, ten hits each."""
    from skein.operators.keyword import pages, search_many
    from skein.plans.model import SearchQuery

    ix = _index(spark, d)
    words = [r.term for r in ix.terms.where("field = 'text' AND length(term) > 3").orderBy(F.desc("df"), "term").limit(1001).collect()]
    asked = [(i, SearchQuery(q=f"{a} {b}", operator="OR")) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return pages(search_many(ix, _docs(spark, d), asked, ["text"], analysis=_PLAIN, top=10).withColumn("score", F.round("score", 6)), 10)


@query()
def autocomplete(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.autocomplete import complete

    docs = _docs(spark, d).withColumn("category", F.lower(F.trim("source")))
    return complete(_index(spark, d, ("title", "text")), docs, "har", 10, _entities(spark, d), analysis=_PLAIN)


@query()
def highlight(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.highlight import highlight_column
    from skein.operators.keyword import page

    hits = page(_search(spark, d, "quiet harbour office"), 0, 10)
    return hits.join(_docs(spark, d), "id").select("id", "score", highlight_column(F.col("text"), "quiet harbour office").alias("shown"))


# --- vectors and hybrid -----------------------------------------------------------------------------------------------

_Q0 = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    row = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0])


def _knn(spark: SparkSession, d: str, metric: str, **how) -> DataFrame:
    from skein.operators.vectors import knn

    return knn(_vectors(spark, d), _query_vector(spark, d), 20, metric, **how).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_Q0} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 20")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine")


@query(f"WITH {_Q0} SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id LIMIT 20")
def knn_dot(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "dot")


@query(f"WITH {_Q0} SELECT vec_id AS id, round(1 / (1 + list_distance(embedding::DOUBLE[], v::DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], v::DOUBLE[]), vec_id LIMIT 20")
def knn_euclid(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "euclidean")


@query(f"WITH {_Q0} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY 2 DESC, vec_id LIMIT 20")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, "cosine", candidates=_vectors(spark, d).where("label = 3"))


@query(f"""WITH {_Q0}, s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 100)
 SELECT id, round(score, 6) AS score FROM s WHERE score >= greatest(0.15, 0.45 * (SELECT max(score) FROM s))""")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.vectors import knn, noise_floor as floor

    return floor(knn(_vectors(spark, d), _query_vector(spark, d), 100)).select("id", F.round("score", 6).alias("score"))


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE AS span FROM embeddings)
 SELECT vec_id, list_transform(e, lambda x: (floor((x - lo) * (255.0 / CASE WHEN span = 0 THEN 1 ELSE span END) + 0.5) - 128)::INT) AS q FROM m""")
def sq8_quantize(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.vectors import quantize

    return table(spark, d, "embeddings").select("vec_id", quantize(F.col("embedding"))["q"].cast("array<int>").alias("q"))


@query("""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE AS s FROM embeddings),
 q AS (SELECT vec_id, e, list_transform(e, lambda x: floor((x - lo) * 255.0 / CASE WHEN s = 0 THEN 1 ELSE s END + 0.5) * CASE WHEN s = 0 THEN 1 ELSE s END / 255.0 + lo) AS back FROM m)
 SELECT vec_id, round(list_cosine_similarity(e, back), 5) AS cosine, round(list_max(list_transform(list_zip(e, back), lambda p: abs(p[1] - p[2]))), 5) AS most FROM q""")
def sq8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.vectors import cosine, dequantize, quantize

    e = table(spark, d, "embeddings").withColumn("q", quantize(F.col("embedding")))
    back = dequantize(F.col("q"))
    gap = F.array_max(F.zip_with(F.col("embedding").cast("array<double>"), back, lambda x, y: F.abs(x - y)))
    return e.select("vec_id", F.round(cosine(F.col("embedding"), back), 5).alias("cosine"), F.round(gap, 5).alias("most"))


@query("""WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
 SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, against all."""
    from skein.operators.vectors import knn_many

    v = _vectors(spark, d)
    asked = {r.id: list(r.vec) for r in v.where("id % 100 = 0").orderBy("id").collect()}
    return knn_many(v, asked, 10).withColumn("score", F.round("score", 6))


def _lists_sql(k: int = 50) -> str:
    return f"""kw AS (SELECT id, score FROM ({_bm25_sql(['harbour', 'office'])}) ORDER BY score DESC, id LIMIT {k}),
 {_Q0}, sem AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT {k})"""


def _lists(spark: SparkSession, d: str, k: int = 50) -> tuple[DataFrame, DataFrame]:
    from skein.operators.keyword import page
    from skein.operators.vectors import knn

    return page(_search(spark, d, "harbour office"), 0, k), knn(_vectors(spark, d), _query_vector(spark, d), k)


@query(f"""WITH {_lists_sql()}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM kw UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM sem),
 s AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM a GROUP BY id) SELECT id, floor(score * 1000 + 0.5) / 1000 AS score FROM s WHERE score > 0.01""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.vectors import hybrid

    return hybrid(*_lists(spark, d), "rrf")


@query(f"""WITH {_lists_sql()}, a AS (SELECT id, (score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0) AS x FROM kw), b AS (SELECT id, (score - min(score) OVER ()) / nullif(max(score) OVER () - min(score) OVER (), 0) AS y FROM sem),
 s AS (SELECT coalesce(a.id, b.id) AS id, 0.55 * coalesce(x, 0) + 0.45 * coalesce(y, 0) AS score FROM a FULL JOIN b ON a.id = b.id) SELECT id, floor(score * 1000 + 0.5) / 1000 AS score FROM s WHERE score > 0.01""")
def hybrid_linear(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.vectors import hybrid

    return hybrid(*_lists(spark, d), "linear", 0.55)


# --- geo ----------------------------------------------------------------------------------------------------------------

_CUST = "cust AS (SELECT c_custkey AS id, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat, ((c_custkey * 91) % 360 - 180)::DOUBLE AS lon FROM customer)"
_FROM = "2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(lat - 12.5) / 2), 2) + cos(radians(12.5)) * cos(radians(lat)) * pow(sin(radians(lon - 77.5) / 2), 2))))"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    lat, lon = ((F.col("c_custkey") * 37) % 180 - 90).cast("double"), ((F.col("c_custkey") * 91) % 360 - 180).cast("double")
    return c.select(F.col("c_custkey").alias("id"), F.struct(lat.alias("lat"), lon.alias("lon")).alias("location"))


def _geo(spark: SparkSession, d: str, **how) -> DataFrame:
    from skein.operators.filters import geo
    from skein.plans.model import GeoQuery

    c = _customers(spark, d)
    return c.where(geo(c, GeoQuery("location", **how)))


@query(f"WITH {_CUST} SELECT id FROM cust WHERE {_FROM} <= 1500")
def geo_radius(spark: SparkSession, d: str) -> DataFrame:
    return _geo(spark, d, lat=12.5, lon=77.5, distance_km=1500.0).select("id")


@query(f"WITH {_CUST} SELECT id FROM cust WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN 20 AND 60")
def geo_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _geo(spark, d, box=(30.0, 20.0, -10.0, 60.0)).select("id")


@query(f"WITH {_CUST} SELECT id FROM cust WHERE lat BETWEEN -10 AND 30 AND (lon >= 170 OR lon <= -150)")
def geo_antimeridian(spark: SparkSession, d: str) -> DataFrame:
    return _geo(spark, d, box=(30.0, 170.0, -10.0, -150.0)).select("id")


@query(f"WITH {_CUST} SELECT id, floor({_FROM} * 1000 + 0.5) / 1000 AS distance_km FROM cust ORDER BY {_FROM}, id LIMIT 25")
def geo_sort(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.text import js_round
    from skein.operators.filters import geo_distance
    from skein.plans.model import GeoQuery

    km = geo_distance(GeoQuery("location", 12.5, 77.5))
    return _customers(spark, d).withColumn("km", km).orderBy("km", "id").limit(25).select("id", js_round(F.col("km")).alias("distance_km"))


@query("SELECT c_custkey AS id, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat, ((c_custkey * 91) % 360 - 180)::DOUBLE AS lon FROM customer")
def geo_parse(spark: SparkSession, d: str) -> DataFrame:
    """Points written in each of the accepted forms, read back."""
    from skein.functions.geo import parse_point

    c = _customers(spark, d).select("id", F.col("location.lat").alias("a"), F.col("location.lon").alias("o"))
    forms = [F.to_json(F.struct(F.col("a").alias("lat"), F.col("o").alias("lon"))), F.to_json(F.array("o", "a")), F.concat_ws(",", "a", "o"), F.to_json(F.struct(F.col("a").alias("latitude"), F.col("o").alias("longitude")))]
    text = F.element_at(F.array(*forms), (F.col("id") % 4 + 1).cast("int"))
    return c.select("id", parse_point(text).alias("p")).select("id", "p.lat", "p.lon")


# --- graph --------------------------------------------------------------------------------------------------------------


def _entities(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for i, (name, key) in enumerate((("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))):
        t = table(spark, d, name)
        parts.append(t.select(F.concat(F.lit(name + ":"), F.col(key).cast("string")).alias("id"), F.col(key[0] + "_name").alias("name"), F.lit(name).alias("type"), (F.col(key).cast("bigint") + i * 1_000_000_000).alias("seq")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"aliases": F.array().cast("array<string>"), "doc_ids": F.array("id")})


def _triples(spark: SparkSession, d: str) -> DataFrame:
    def rows(name: str, own: str, kind: str, to: str, target: str, i: int) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(name + ":"), F.col(own).cast("string")).alias("subject"), F.lit(kind).alias("predicate"), F.concat(F.lit(target + ":"), F.col(to).cast("string")).alias("object"), F.lit(1.0).alias("weight"), (F.col(own).cast("bigint") + i * 1_000_000_000).alias("seq"))

    return rows("nation", "n_nationkey", "inRegion", "n_regionkey", "region", 0).unionByName(rows("customer", "c_custkey", "inNation", "c_nationkey", "nation", 1)).unionByName(rows("supplier", "s_suppkey", "inNation", "s_nationkey", "nation", 2))


_TRIPLES = """tri AS (SELECT 'nation:' || n_nationkey AS s, 'region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier),
arc AS (SELECT s AS a, o AS b FROM tri UNION ALL SELECT o, s FROM tri)"""


def _around(spark: SparkSession, d: str, hops: int) -> DataFrame:
    from skein.operators.graph import neighborhood

    root = spark.createDataFrame([("nation:3",)], "id string")
    return neighborhood(_triples(spark, d), root, hops)[0]


@query(f"WITH {_TRIPLES} SELECT 'nation:3' AS id, 0 AS hop UNION SELECT DISTINCT b, 1 FROM arc WHERE a = 'nation:3'")
def graph_neighborhood_1(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d, 1)


@query(f"""WITH {_TRIPLES}, one AS (SELECT DISTINCT b FROM arc WHERE a = 'nation:3'), two AS (SELECT DISTINCT arc.b FROM arc JOIN one ON arc.a = one.b WHERE arc.b <> 'nation:3' AND arc.b NOT IN (SELECT b FROM one))
 SELECT 'nation:3' AS id, 0 AS hop UNION ALL SELECT b, 1 FROM one UNION ALL SELECT b, 2 FROM two""")
def graph_neighborhood_2(spark: SparkSession, d: str) -> DataFrame:
    return _around(spark, d, 2)


@query("""SELECT 'region' AS type, count(*) AS entities FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.graph import stats

    return stats(_entities(spark, d), _triples(spark, d)).where("type IS NOT NULL").select("type", "entities")


@query()
def graph_search(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.graph import search

    return search(_entities(spark, d), _triples(spark, d), table(spark, d, "region").orderBy("r_regionkey").first()["r_name"], 1)["entities"].select("id", "name", "type", "hop")


# --- writing ------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey BETWEEN 500 AND 1500 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey <= 1500""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.index import upsert

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    new = o.where("id BETWEEN 500 AND 1500").withColumns({"price": F.col("price") * 2, "seq": F.col("seq") + 10_000_000_000})
    return upsert(o.where("id <= 1000"), new).select("id", "price")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders
 UNION ALL SELECT -1 - o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 0""")
def upsert_orders(spark: SparkSession, d: str) -> DataFrame:
    """All orders; the new rows are a third of the ids, half of them in two versions, and ids not yet present for a tenth."""
    from skein.operators.index import upsert

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    later = lambda rows, n, price: rows.withColumns({"price": price, "seq": F.col("seq") + n * 10_000_000_000})
    changed = later(o.where("id % 3 = 0"), 2, F.col("price") * 2)
    outdated = later(o.where("id % 6 = 0"), 1, F.lit(0.0))
    added = o.where("id % 10 = 0").withColumn("id", -1 - F.col("id"))
    return upsert(o, changed.unionByName(outdated).unionByName(added)).select("id", "price")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 <> 0")
def delete_docs(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.index import delete

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return delete(o, o.where("id % 7 = 0"))


def _event_docs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    fields = F.to_json(F.struct("event_type", F.when(F.col("event_id") % 5 == 0, F.col("value").cast("string")).alias("label"), F.when(F.col("event_id") % 11 != 0, F.col("value").cast("double")).alias("amount"), F.when(F.col("event_id") % 13 == 0, F.lit("oops")).alias("flag")))
    return e.select(F.col("event_id").alias("id"), F.col("event_id").alias("seq"), fields.alias("fields"))


def _event_maps():
    from skein.plans.model import FieldMapping

    return {"event_type": FieldMapping("keyword"), "amount": FieldMapping("number"), "flag": FieldMapping("boolean"), "label": FieldMapping("text")}


@query("SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN 'flag: expected boolean' ELSE '' END AS error FROM events")
def validate_docs(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import issues

    return _event_docs(spark, d).select("id", F.array_join(issues(F.col("fields"), _event_maps()), "; ").alias("error"))


@query("SELECT event_id % 13 = 0 AS dead, count(*) AS n FROM events GROUP BY 1")
def dlq_split(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import split_valid

    good, bad = split_valid(spread(_event_docs(spark, d)), _event_maps())
    return good.select(F.lit(False).alias("dead")).unionByName(bad.select(F.lit(True).alias("dead"))).groupBy("dead").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id, event_type, CASE WHEN event_id % 11 <> 0 THEN value END AS amount FROM events")
def coerce_fields(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import typed

    return typed(_event_docs(spark, d), _event_maps()).select("id", "event_type", "amount")


@query("SELECT unnest(['amount', 'event_type', 'flag', 'label']) AS name, unnest(['number', 'keyword', 'keyword', 'keyword']) AS type")
def mapping_inference(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import infer_mappings

    return spark.createDataFrame([(k, v.type) for k, v in infer_mappings(_event_docs(spark, d)).items()], "name string, type string")


@query("SELECT p_partkey AS id, CASE WHEN r <= 50 THEN 99.5 ELSE p_retailprice END AS price FROM (SELECT p.*, CASE WHEN p_size = 7 THEN row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) ELSE 1000000 END AS r FROM part p)")
def update_by_query(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.runtime import shared_folder
    from skein.sources.store import Store

    store = Store(spark, shared_folder(spark, "update"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    store.upsert("parts", p)
    store.update_by_query("parts", F.col("size") == 7, {"price": 99.5}, 50)
    return store.docs("parts").select("id", "price")


@query()
def config_plan(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.runtime import shared_folder
    from skein.plans.model import FieldMapping
    from skein.sources.store import Store

    store = Store(spark, shared_folder(spark, "config"))
    store.create("old")
    store.create("kept", {"a": FieldMapping("text")})
    actions = store.plan({"indexes": [{"name": "kept", "mappings": {"b": {"type": "number"}}}, {"name": "new"}]}, prune=True)
    return spark.createDataFrame([(a["type"], a["target"]) for a in actions], "type string, target string")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30 OFFSET 10")
def job_listing(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.jobs import listing

    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"))
    return listing(jobs, "O", 10, 30).select("id", "status")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-01-01' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'running' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def job_sweep(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    from skein.operators.jobs import sweep

    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus"))
    jobs = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    return sweep(jobs, datetime(1995, 1, 1)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- analytics ----------------------------------------------------------------------------------------------------------

_LOG = "log AS (SELECT CASE WHEN event_type = 'click' THEN 'click' ELSE 'query' END AS type, event_type AS query, value AS took_ms, event_id % 5 AS hits_count, ts FROM events)"


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.when(F.col("event_type") == "click", "click").otherwise("query").alias("type"), F.col("event_type").alias("query"), F.col("value").alias("took_ms"), (F.col("event_id") % 5).alias("hits_count"), "ts", F.to_date("ts").alias("dt"))


@query(f"""WITH {_LOG}, q AS (SELECT *, row_number() OVER (ORDER BY took_ms) - 1 AS r, count(*) OVER () AS n FROM log WHERE type = 'query')
 SELECT (SELECT count(*) FROM q) AS n_queries, (SELECT count(*) FROM log WHERE type = 'click') AS n_clicks, (SELECT round(avg(took_ms), 6) FROM q) AS avg_ms, (SELECT took_ms::DOUBLE FROM q WHERE r = floor(0.95 * n)) AS p95_ms, (SELECT count(*) FROM q WHERE hits_count = 0) AS n_zero""")
def analytics_summary(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.analytics import summary

    return summary(_log(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {_LOG} SELECT lower(trim(query)) AS query, count(*) AS n FROM log WHERE type = 'query' GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def top_queries(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.analytics import top_queries as run

    return run(_log(spark, d))


@query(f"WITH {_LOG} SELECT lower(trim(query)) AS query FROM log WHERE type = 'query' AND hits_count = 0 GROUP BY 1 ORDER BY min(ts), 1 LIMIT 10")
def zero_results(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.analytics import zero_results as run

    return run(_log(spark, d))


# --- pages --------------------------------------------------------------------------------------------------------------

_ADDR = "CASE WHEN coalesce(final_url, '') <> '' THEN final_url ELSE url END"
_HOST = r"lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"(CASE WHEN regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1) END)"


@query(f"SELECT DISTINCT page_id, {_HOST.format(c=_ADDR)} AS host, {_PATH.format(c=_ADDR)} AS path FROM crawled_pages")
def host_path(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import page_documents

    pages = table(spark, d, "crawled_pages")
    docs = page_documents(pages.withColumn("title", F.col("page_id").cast("string")))
    return docs.select(F.col("title").cast("bigint").alias("page_id"), "host", "path").distinct()


@query(r"SELECT DISTINCT page_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda x: x <> ''))::INT AS word_count FROM crawled_pages")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.text import word_count as words

    return table(spark, d, "crawled_pages").select("page_id", words(F.col("text")).alias("word_count")).distinct()


@query()
def page_category(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import page_documents

    return page_documents(table(spark, d, "crawled_pages")).select("id", "category", "page_type").distinct()


@query()
def enrich(spark: SparkSession, d: str) -> DataFrame:
    from skein.sources.documents import enrich as run

    pages = table(spark, d, "crawled_pages").select(F.col("final_url").alias("id"), "title", F.col("text").alias("body"))
    return run(pages).select("id", "host", "path", "category", "page_type", "word_count")


@query()
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.text import normalize_url

    return table(spark, d, "crawled_pages").select("page_id", normalize_url(F.col("url")).alias("url")).distinct()


@query(f"SELECT {_ADDR} AS address, count(DISTINCT page_id) AS n_pages FROM crawled_pages WHERE coalesce(status, 0) NOT IN (401, 403) AND (content_type IS NULL OR lower(content_type) LIKE '%html%') GROUP BY 1")
def page_merge(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.crawl import merge_by_address

    pages = table(spark, d, "crawled_pages").withColumn("final_url", F.when(F.coalesce("final_url", F.lit("")) != "", F.col("final_url")))
    return merge_by_address(pages).select("address", "n_pages")


@query()
def link_graph(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.crawl import link_graph as run

    return run(table(spark, d, "crawled_pages"))


@query()
def crawl_bfs(spark: SparkSession, d: str) -> DataFrame:
    from skein.operators.crawl import crawl

    pages = table(spark, d, "crawled_pages")
    return crawl(pages, pages.where("depth = 0").select("url"), deny=["/private"])


@query()
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as HTML and read back."""
    from skein.functions.html import extract_column

    pages = table(spark, d, "crawled_pages").where("text IS NOT NULL").select("page_id", "url", "title", "text").distinct()
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;")
    html = F.concat(F.lit("<html><head><title>"), esc(F.col("title")), F.lit("</title></head><body><p>"), F.regexp_replace(esc(F.col("text")), "\n", "</p><p>"), F.lit("</p></body></html>"))
    return pages.select("page_id", extract_column(F.col("url"), html).alias("x")).select("page_id", "x.title", "x.text")


@query(f"SELECT DISTINCT page_id, (starts_with(p, '/ab') OR NOT (starts_with(p, '/a') OR starts_with(p, '/z'))) AS allowed FROM (SELECT page_id, {_PATH.format(c='url')} AS p FROM crawled_pages)")
def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.html import robots_allowed, robots_rules
    from skein.functions.text import path_of

    rules, _ = robots_rules("User-agent: *\nDisallow: /a\nAllow: /ab\nDisallow: /z", "reader")
    return table(spark, d, "crawled_pages").select("page_id", robots_allowed(path_of(F.col("url")), rules).alias("allowed")).distinct()


@query("SELECT DISTINCT site_name, url FROM crawled_pages WHERE url IS NOT NULL")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.html import sitemap_locations, sitemaps

    urls = table(spark, d, "crawled_pages").where("url IS NOT NULL").select("site_name", "url").distinct()
    return sitemaps(urls).select("site_name", F.explode(sitemap_locations(F.col("xml"))).alias("url"))


# --- embeddings, pixels, hashes, streams --------------------------------------------------------------------------------


@query()
def embed_local(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.embed import embed_column, text_of_fields

    docs = spread(_docs(spark, d).select("id", "title", "text"))
    return docs.select("id", embed_column(text_of_fields(docs), "local").alias("vec"))


@query()
def embed_micro(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.embed import embed_column, text_of_fields

    docs = spread(_docs(spark, d).select("id", "title", "text"))
    return docs.select("id", embed_column(text_of_fields(docs), "micro-transformer").alias("vec"))


@query()
def vision_embed(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.embed import vision_column

    return table(spark, d, "part").select("p_partkey", vision_column(F.col("p_name"), 64).alias("vec"))


@query()
def palette_motif(spark: SparkSession, d: str) -> DataFrame:
    """Buffers of pixels worked out from part keys, analysed."""
    from skein.functions.visual import visual_features

    pixels = F.unhex(F.repeat(F.concat(F.hex((F.col("p_partkey") * 37) % 128 + 128), F.hex((F.col("p_size") * 5) % 112 + 16), F.hex(F.col("p_partkey") % 112 + 16), F.lit("FF")), 100))
    return table(spark, d, "part").select("p_partkey", visual_features(pixels, F.lit(10), F.lit(10), F.lit(4)).alias("v")).select("p_partkey", "v.texture", F.element_at("v.dominant", 1).alias("color"))


@query("""SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('doc-' || doc_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h,
 (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('doc-' || doc_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 8)::INT AS shard FROM documents""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.text import fnv1a, shard_of

    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", fnv1a(key).alias("h"), shard_of(key, 8).alias("shard"))


@query("SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1")
def checksums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from skein.streaming.ingest import windowed_counts as run

    return run(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same counts, worked out by a stream that reads the table to its end."""
    from skein.functions.runtime import shared_folder
    from skein.streaming.ingest import windowed_counts as run

    at = shared_folder(spark, "stream")
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    run(source).writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id % 13 = 0 AS dead, count(*) AS n FROM events GROUP BY 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines, read by a stream into an index and its dead letters, and counted."""
    from skein.functions.runtime import shared_folder
    from skein.sources.store import Store
    from skein.streaming.ingest import ingest, json_lines

    at = shared_folder(spark, "ingest")
    _event_docs(spark, d).select(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.from_json("fields", "event_type string, label string, amount double, flag string").alias("fields"))).alias("value")).write.text(f"{at}/in")
    store = Store(spark, f"{at}/store")
    store.create("events", _event_maps())
    ingest(json_lines(spark, f"{at}/in"), store, "events", f"{at}/state").awaitTermination()
    dead = spark.read.parquet(f"{at}/store/_dead_letter").select(F.lit(True).alias("dead"))
    return store.docs("events").select(F.lit(False).alias("dead")).unionByName(dead).groupBy("dead").agg(F.count(F.lit(1)).alias("n"))


@query()
def es_translate(spark: SparkSession, d: str) -> DataFrame:
    import json

    from skein.functions.translate import to_elasticsearch, to_solr

    asked = [{"q": "red shoes", "fields": ["title"], "boosts": {"title": 2}}, {"q": "silk", "phrase": True, "fields": ["name"], "filters": [{"field": "price", "gte": 10, "lt": 20}]}]
    return spark.createDataFrame([(i, json.dumps(to_elasticsearch(q)), json.dumps(to_solr(q))) for i, q in enumerate(asked)], "id int, elasticsearch string, solr string")


@query()
def messages(spark: SparkSession, d: str) -> DataFrame:
    from skein.functions.messages import CATALOGUE, format_message

    return spark.createDataFrame([(c, format_message(c, total=1, tookMs=3, count=2, indexed=1, failed=0)["message"]) for c in sorted(CATALOGUE)], "code string, message string")
