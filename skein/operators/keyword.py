"""Keyword search: expansion, BM25, phrases, boosts, ranking. Any number of requests is answered by one plan."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import auto_distance, has_wildcard, tokenize, wildcard_regex
from skein.operators import filters
from skein.operators.index import InvertedIndex, field_text
from skein.plans.model import MAX_EXPANSIONS, EngineError, IndexSettings, SearchQuery

PHRASE_SCORE, COMPLETE_BOOST, EXACT_BOOST = 2.5, 1.35, 1.5
_CONJUNCTION = re.compile(r"\b(with|and|having|containing|plus)\b", re.IGNORECASE)


def query_tokens(q: str, stopwords: bool = True, stemming: bool = True) -> tuple[list[str], bool]:
    """Tokens of a query, and whether it holds wildcards (then raw words in lower case)."""
    raw = q.split()
    if any(has_wildcard(t) for t in raw):
        return [t.lower() for t in raw], True
    return tokenize(q, stopwords, stemming), False


def required_matches(q: SearchQuery, tokens: list[str], wild: bool, default_operator: str = "OR") -> int:
    operator = q.operator or ("AND" if _CONJUNCTION.search(q.q or "") else default_operator)
    if operator == "AND" and not wild and len(tokens) > 1:
        return len(tokens)
    least = q.minimum_should_match
    if least and not wild:
        if isinstance(least, str) and least.endswith("%"):
            return max(1, math.ceil(len(tokens) * float(least[:-1]) / 100))
        return min(len(tokens), int(least))
    return 1


def allowed_distance(fuzziness: Any, token: str) -> int:
    if fuzziness is None or fuzziness is False or fuzziness == 0:
        return 0
    return auto_distance(token) if fuzziness in (True, "AUTO") else int(fuzziness)


def bm25(n_docs: int, average: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """Score of a posting (tf, dl, df)."""
    idf = F.log(1 + (F.lit(float(max(n_docs, 1))) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - b + b * F.col("dl") / F.when(average > 0, average).otherwise(1.0)
    return idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * norm)


def expand(index: InvertedIndex, tokens: DataFrame, cap: int = MAX_EXPANSIONS) -> DataFrame:
    """Dictionary terms of each query token: (qid, ord, token, field, term, df, distance).

    tokens: (qid, ord, token, how, pattern, dist, auto, field), small and broadcast against the dictionary. Exact tokens are an
    equi-join; prefixes, wildcards and fuzzy tokens meet the dictionary by a condition, and at most cap terms of each, in
    order of first use, are kept.
    """
    exact = index.terms.join(F.broadcast(tokens.where("how = 'exact'")), (F.col("term") == F.col("token")) & (index.terms["field"] == tokens["field"])).select("qid", "ord", "token", index.terms["field"], "term", "df", F.lit(0).alias("distance"))
    loose = F.broadcast(tokens.where("how <> 'exact'"))
    d = F.levenshtein("term", "token", 2)
    near = (F.abs(F.length("term") - F.length("token")) <= F.col("dist")) & ((F.col("dist") != 1) | (F.substring("term", 1, 1) == F.substring("token", 1, 1))) & (d >= 0) & (d <= F.col("dist"))
    cond = F.when(F.col("how") == "prefix", F.expr("startswith(term, token)")).when(F.col("how") == "wild", F.expr("regexp_like(term, pattern)")).otherwise(near)
    met = index.terms.join(loose, (index.terms["field"] == tokens["field"]) & cond).select("qid", "ord", "token", "how", "auto", index.terms["field"], "term", "df", "first_seq", "first_pos", F.when(F.col("how") == "fuzzy", d).otherwise(0).alias("distance"))
    order = Window.partitionBy("qid", "ord", "field").orderBy(F.when((F.col("how") == "fuzzy") & (F.col("distance") == 0), 0).otherwise(1), "first_seq", "first_pos", "term")
    met = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)
    first = F.first("distance").over(Window.partitionBy("qid", "ord", "field").orderBy("r"))
    met = met.withColumn("best", first).where(~(F.col("auto") & (F.col("best") == 0) & (F.col("distance") > 0)))
    return exact.unionByName(met.select("qid", "ord", "token", "field", "term", "df", "distance"))


def _token_frame(spark, queries: list[tuple[Any, SearchQuery]], fields: list[str], analysis: dict) -> tuple[DataFrame, dict]:
    rows, info = [], {}
    for qid, q in queries:
        tokens, wild = query_tokens(q.q or "", **analysis)
        info[qid] = (tokens, wild)
        for i, t in enumerate(tokens):
            dist = allowed_distance(q.fuzziness, t)
            how = "wild" if wild and has_wildcard(t) else "prefix" if q.prefix else "fuzzy" if dist else "exact"
            rows += [(qid, i, t, how, wildcard_regex(t), dist, q.fuzziness in (None, "AUTO"), f) for f in (q.fields or fields)]
    kind = "bigint" if all(isinstance(k, int) for k, _ in queries) else "string"
    schema = f"qid {kind}, ord int, token string, how string, pattern string, dist int, auto boolean, field string"
    return spark.createDataFrame(rows, schema), info


def phrase_hits(index: InvertedIndex, tokens: list[str], fields: list[str], boosts: dict, slop: int = 0) -> DataFrame:
    """(id, score) of documents in which the tokens follow each other, each at the first place within slop of the last."""
    words = list(dict.fromkeys(tokens))
    rows = index.postings.where(F.col("field").isin(fields) & F.col("term").isin(words))
    at = rows.groupBy("field", "id").agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(words)])
    at = at.where(" AND ".join(f"p{i} IS NOT NULL" for i in range(len(words))))

    def after(cursor: Column, word: str) -> Column:
        return F.get(F.filter(F.col(f"p{words.index(word)}"), lambda p: (p >= cursor + 1) & (p <= cursor + 1 + slop)), F.lit(0))

    def follow(start: Column) -> Column:
        for t in tokens[1:]:
            start = after(start, t)
        return start

    # positions are sorted, so the first that fits is the least
    found = at.where(F.exists("p0", lambda p: follow(p).isNotNull()))
    boost = F.lit(1.0)
    for f, b in boosts.items():
        boost = F.when(F.col("field") == f, float(b)).otherwise(boost)
    return found.groupBy("id").agg(F.sum(PHRASE_SCORE * boost).alias("score"))


def search_many(index: InvertedIndex, docs: DataFrame, queries: list[tuple[Any, SearchQuery]], fields: list[str], settings: IndexSettings | None = None, analysis: dict | None = None, top: int | None = None) -> DataFrame:
    """(qid, id, score) of every matching document of every request, before paging. Requests of one call share filters and boosts.

    top: the caller wants no more than so many of each request. Then texts are only read of documents that can still be
    among them: those whose score, raised by the boost for the exact phrase, reaches the top-th score without it.
    """
    s, analysis = settings or IndexSettings(), analysis or {}
    spark = docs.sparkSession
    shared = queries[0][1]
    tokens, info = _token_frame(spark, queries, fields, analysis)
    if not any(t for t, _ in info.values()):
        return tokens.select("qid", F.lit(None).cast(docs.schema["id"].dataType).alias("id"), F.lit(0.0).alias("score")).where("false")
    boost, average = F.lit(1.0), F.lit(1.0)
    for f, b in shared.boosts.items():
        boost = F.when(F.col("field") == f, float(b)).otherwise(boost)
    for f, a in index.average.items():
        average = F.when(F.col("field") == f, float(a)).otherwise(average)
    wanted = sorted({f for _, q in queries for f in (q.fields or fields)})
    postings = index.postings.where(F.col("field").isin(wanted))
    words = sorted({t for ts, _ in info.values() for t in ts})
    if all(not w and not q.prefix and all(allowed_distance(q.fuzziness, t) == 0 for t in info[k][0]) for (k, q), (_, w) in zip(queries, info.values(), strict=True)):
        postings = postings.where(F.col("term").isin(words))  # reaches the sorted scan
    variants = expand(index, tokens)
    kept = docs
    clauses = [*shared.filters, *shared.must]
    if clauses or shared.geo:
        cond = filters.all_of(docs, clauses)
        kept = docs.where(cond & filters.geo(docs, shared.geo) if shared.geo else cond)
        postings = postings.join(kept.select("id"), "id", "left_semi")
    if shared.phrase and len(info[queries[0][0]][0]) > 1 and not info[queries[0][0]][1]:
        hits = phrase_hits(InvertedIndex(postings, index.terms, index.fields, index.n_docs, index.average), info[queries[0][0]][0], wanted, shared.boosts, shared.phrase_slop)
        matched = hits.withColumn("qid", F.lit(queries[0][0])).withColumn("n", F.lit(len(set(info[queries[0][0]][0]))))
    else:
        scored = postings.join(F.broadcast(variants), ["field", "term"])
        part = bm25(index.n_docs, average, s.bm25k1, s.bm25b) * F.when(F.col("distance") == 0, 1.0).otherwise(1 / (1 + F.col("distance"))) * boost
        matched = scored.groupBy("qid", "id").agg(F.sum(part).alias("score"), F.size(F.collect_set("token")).alias("n"))
    need = spark.createDataFrame([(k, len(info[k][0]), required_matches(q, info[k][0], info[k][1], s.default_operator), float(q.min_score or 0.0), (q.q or "").lower(), info[k][1]) for k, q in queries], f"qid {dict(tokens.dtypes)['qid']}, n_tokens int, need int, least double, raw string, wild boolean")
    ranked = matched.join(F.broadcast(need), "qid").where((F.col("n") >= F.col("need")) & (F.col("score") >= F.col("least")))
    score = F.col("score") * F.when((F.col("n_tokens") > 1) & (F.col("n") == F.col("n_tokens")), COMPLETE_BOOST).otherwise(1.0)
    if any(len(t) > 1 and not w for t, w in info.values()):
        texts = [F.contains(F.lower(field_text(docs, f)), F.col("raw")) for f in wanted if f in docs.columns]
        exact = F.lit(False)
        for t in texts:
            exact = exact | F.coalesce(t, F.lit(False))
        if top is not None:
            order = Window.partitionBy("qid").orderBy(F.desc("plain"))
            ranked = ranked.withColumn("plain", score).withColumn("least", F.nth_value("plain", top).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            ranked = ranked.where(F.col("least").isNull() | (F.col("plain") * EXACT_BOOST >= F.col("least"))).drop("plain", "least")
        ranked = ranked.join(docs.select("id", *[f for f in wanted if f in docs.columns]), "id")
        score = score * F.when((F.col("n_tokens") > 1) & ~F.col("wild") & exact, EXACT_BOOST).otherwise(1.0)
    return ranked.select("qid", "id", score.alias("score"))


def page(hits: DataFrame, offset: int = 0, size: int = 10, search_after: Any = None, by: str = "score") -> DataFrame:
    """The page of one request's hits (id, score): score down, id up; search_after drops all up to and with that id."""
    key = F.collate(F.col("id"), "UNICODE") if dict(hits.dtypes)["id"].startswith("string") else F.col("id")
    if search_after is None:
        return hits.orderBy(F.desc(by), key).offset(offset).limit(size)
    at = hits.where(F.col("id") == F.lit(search_after)).select(F.col(by).alias("_s"), F.col("id").alias("_i")).limit(1)
    row = at.first()
    if row is None:
        return hits.orderBy(F.desc(by), key).limit(size)
    after = (F.col(by) < row["_s"]) | ((F.col(by) == row["_s"]) & (key > (F.collate(F.lit(row["_i"]), "UNICODE") if isinstance(row["_i"], str) else F.lit(row["_i"]))))
    return hits.where(after).orderBy(F.desc(by), key).limit(size)


def pages(hits: DataFrame, size: int = 10) -> DataFrame:
    """The first size hits of every request, with rank."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def suggest(index: InvertedIndex, prefix: str, fields: list[str] | None = None, size: int = 10) -> DataFrame:
    """Dictionary terms with the prefix, in order of field and first use, each once."""
    prefix = prefix.strip().lower()
    if not prefix:
        raise EngineError("ERR_VALIDATION", "empty prefix")
    names = fields or sorted(index.average)
    rank = F.array_position(F.array(*[F.lit(f) for f in names]), F.col("field"))
    rows = index.terms.where(F.col("field").isin(names) & F.startswith(F.col("term"), F.lit(prefix)))
    least = rows.groupBy("term").agg(F.min(F.struct(rank.alias("field_ord"), "first_seq", "first_pos")).alias("o"))
    return least.orderBy("o.field_ord", "o.first_seq", "o.first_pos", "term").limit(size).select("term")
