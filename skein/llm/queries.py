"""Queries of the text and vector operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.runtime import table


def _model(spark: SparkSession, d: str):
    from skein.llm.language import train

    return train(table(spark, d, "lang_samples"), table(spark, d, "crawled_pages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.language import unnamed_languages

    return unnamed_languages(table(spark, d, "crawled_pages"), _model(spark, d))


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.language import page_languages

    return page_languages(table(spark, d, "crawled_pages"), _model(spark, d))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.language import segments

    return segments(table(spark, d, "crawled_pages"), _model(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.spam import redundancy

    return redundancy(table(spark, d, "crawled_pages")).where("found").select("page_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.spam import redundancy

    return redundancy(table(spark, d, "crawled_pages"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    cols = ["page_id", "title", "text"]
    return table(spark, d, "crawled_pages").select(*cols).unionByName(table(spark, d, "extracted_pages").select(*cols))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.body import furniture_lines

    return furniture_lines(_pages(spark, d))


def p4_body(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.body import body_text

    return body_text(_pages(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.sitelines import repeated_lines

    return repeated_lines(table(spark, d, "crawled_pages"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.sitelines import without_repeated_lines

    return without_repeated_lines(table(spark, d, "crawled_pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.knn import similar_pairs

    return similar_pairs(table(spark, d, "vectors"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.knn import neighbours

    return neighbours(table(spark, d, "vectors"))


def _hundredth() -> Column:
    return F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long") % 100 == 0


def p6_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest of every id divisible by 100, by comparison with all."""
    from skein.llm.knn import exact_neighbours

    return exact_neighbours(table(spark, d, "vectors"), _hundredth()).select("id", "other", F.round("cosine", 4).alias("cosine"), "rank")


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the answers of p6_exact the index finds."""
    from skein.llm.knn import exact_neighbours, neighbours

    exact = exact_neighbours(table(spark, d, "vectors"), _hundredth()).select("id", "other")
    found = neighbours(table(spark, d, "vectors")).where(_hundredth()).select("id", "other", F.lit(1).alias("hit"))
    return exact.join(found, ["id", "other"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("found"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.neardup import NearDuplicates

    return NearDuplicates(table(spark, d, "crawled_pages")).pairs()


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.neardup import NearDuplicates

    return NearDuplicates(table(spark, d, "crawled_pages")).groups().select("page_id", "group_id")


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.neardup import NearDuplicates

    return NearDuplicates(table(spark, d, "crawled_pages")).classes()


def _packing(spark: SparkSession, d: str):
    from skein.llm.packing import Packing

    return Packing(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).oversized()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).containers()


def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).summary()


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the placed pieces: all tokens placed, none above capacity, containers near the fewest possible."""
    s = _packing(spark, d).summary()
    return s.select("spec_id", "capacity", "least_containers", "tokens", "n_pieces", (F.col("fullest") <= F.col("capacity")).alias("fits"), (F.col("n_containers") <= F.col("least_containers") + F.ceil(F.col("least_containers") / 400)).alias("close"))


def _mixture(spark: SparkSession, d: str):
    from skein.llm.mixture import Mixture

    return Mixture(table(spark, d, "documents"), table(spark, d, "mixture_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report().where("short").select("mix_id", "source").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).report()


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Tokens drawn by the selection itself, in whole documents, beside what each source could give at most."""
    mix = _mixture(spark, d)
    drawn = mix.selection().groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn"), F.max("copies").alias("copies"))
    caps = table(spark, d, "mixture_targets").select("mix_id", "source", "max_repeats")
    r = mix.report().join(drawn, ["mix_id", "source"], "left").join(caps, ["mix_id", "source"]).withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "most_tokens": F.col("max_repeats") * F.col("source_tokens")})
    return r.select("mix_id", "source", "source_tokens", F.floor("target_tokens").alias("target"), (F.col("drawn") == F.col("reached_tokens")).alias("as_reported"), F.least(F.floor("target_tokens"), F.col("most_tokens")).alias("best"), (F.col("drawn") * 1.01 >= F.least(F.floor("target_tokens"), F.col("most_tokens"))).alias("near"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).selection()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.spans import SharedSpans

    return SharedSpans(table(spark, d, "documents")).spans()


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    from skein.llm.spans import SharedSpans

    s = SharedSpans(table(spark, d, "documents"))
    return s.report().join(s.longest(), "doc_id", "left").withColumn("window_words", F.coalesce("window_words", F.lit(0)))


def queries() -> dict:
    names = [n for n in globals() if n[0] == "p" and n[1].isdigit()]
    return {n: globals()[n] for n in names}


_SITE = r"""regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(CASE WHEN trim(coalesce(final_url, '')) <> '' THEN trim(final_url) ELSE trim(url) END,
  '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\.', '')"""

_SITE_LINES = rf"""
pages AS (SELECT DISTINCT page_id, coalesce({_SITE}, '') AS site, text FROM crawled_pages WHERE text IS NOT NULL),
raw AS (SELECT page_id, site, string_split(text, chr(10)) AS l FROM pages),
nums AS (SELECT page_id, site, unnest(l) AS line, unnest(range(len(l)))::INT AS line_no FROM raw),
norm AS (SELECT page_id, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '[\s\p{{Z}}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line FROM nums),
often AS (SELECT site, line FROM norm WHERE line <> '' GROUP BY site, line HAVING count(DISTINCT page_id) >= 12)
"""

_SPANS = """
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda x: x <> '') AS ws FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(ws) - 28)) AS i, ws FROM w WHERE len(ws) >= 30),
hashed AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 29], ' ')) AS h FROM runs),
twice AS (SELECT h FROM hashed GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i FROM hashed WHERE h IN (SELECT h FROM twice)),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 30 THEN 0 ELSE 1 END AS fresh FROM hit),
runs2 AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
"""


_NEAR = """pages AS (SELECT DISTINCT page_id, lower(coalesce(title, '')) AS t, lower(text) AS x FROM crawled_pages WHERE text IS NOT NULL),
 words AS (SELECT page_id, regexp_extract_all(t || chr(10) || x, '[\\p{L}\\p{N}]+') AS w FROM pages WHERE len(regexp_extract_all(x, '[\\p{L}\\p{N}]+')) >= 50),
 spots AS (SELECT page_id, w, unnest(range(1, len(w) - 1)) AS i FROM words),
 grams AS (SELECT DISTINCT page_id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM spots),
 sizes AS (SELECT page_id, count(*) AS n FROM grams GROUP BY page_id),
 met AS (SELECT a.page_id AS p, b.page_id AS q, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.page_id < b.page_id GROUP BY 1, 2),
 near AS (SELECT p, q FROM met JOIN sizes s ON s.page_id = p JOIN sizes t ON t.page_id = q WHERE k >= 0.6 * (s.n + t.n - k))"""


_TOKENS = r"""tokens AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]+')) AS n FROM documents)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": f"""WITH {_NEAR}
 SELECT p AS page_id_a, q AS page_id_b FROM near""",
        "p7_classes": r"""WITH pages AS (SELECT DISTINCT page_id, lower(coalesce(title, '')) AS t, lower(text) AS x FROM crawled_pages WHERE text IS NOT NULL),
 words AS (SELECT page_id, array_to_string(regexp_extract_all(t || chr(10) || x, '[\p{L}\p{N}]+'), ' ') AS w FROM pages WHERE len(regexp_extract_all(x, '[\p{L}\p{N}]+')) >= 50),
 own AS (SELECT page_id, min(page_id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS n FROM words)
 SELECT page_id, class_id FROM own WHERE n > 1""",
        "p7_groups": f"""WITH RECURSIVE {_NEAR},
 edges AS (SELECT p AS a, q AS b FROM near UNION SELECT q, p FROM near),
 walk AS (SELECT a AS page_id, b AS other FROM edges UNION SELECT w.page_id, e.b FROM walk w JOIN edges e ON w.other = e.a)
 SELECT page_id, least(page_id, min(other)) AS group_id FROM walk GROUP BY page_id""",
        "p8_found": f"WITH {_TOKENS} SELECT spec_id, doc_id FROM tokens, container_specs WHERE n > capacity_tokens",
        "p6_exact": """WITH last AS (SELECT id, max_by(vector, seq) AS v FROM vectors WHERE id IS NOT NULL GROUP BY id),
 ok AS (SELECT id, v FROM last WHERE v IS NOT NULL AND len(v) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 met AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM ok a JOIN ok b ON a.id <> b.id WHERE try_cast(regexp_extract(a.id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0),
 best AS (SELECT id, other, c, row_number() OVER (PARTITION BY id ORDER BY round(c, 7) DESC, other)::INT AS rank FROM met)
 SELECT id, other, round(c, 4) AS cosine, rank FROM best WHERE rank <= 5""",
        "p8_check": f"""WITH {_TOKENS}, cut AS (SELECT spec_id, capacity_tokens AS cap, n FROM tokens, container_specs WHERE n > 0)
 SELECT spec_id, max(cap)::BIGINT AS capacity, ceil(sum(n) / max(cap))::BIGINT AS least_containers, sum(n)::BIGINT AS tokens, sum(ceil(n / cap))::BIGINT AS n_pieces, true AS fits, true AS close FROM cut GROUP BY 1""",
        "p9_check": f"""WITH {_TOKENS}, total AS (SELECT sum(n) AS n FROM tokens), own AS (SELECT lower(trim(source)) AS k, sum(n) AS n FROM tokens GROUP BY 1),
 weights AS (SELECT mix_id, sum(target_weight) AS w FROM mixture_targets GROUP BY 1),
 t AS (SELECT m.mix_id, m.source, max_repeats, coalesce(own.n, 0)::BIGINT AS source_tokens, floor(m.target_weight / weights.w * m.size_ratio * total.n)::BIGINT AS target
  FROM mixture_targets m JOIN weights USING (mix_id) CROSS JOIN total LEFT JOIN own ON k = lower(trim(m.source)) WHERE m.target_weight > 0)
 SELECT mix_id, source, source_tokens, target, true AS as_reported, least(target, max_repeats * source_tokens)::BIGINT AS best, true AS near FROM t""",
        "p9_found": f"""WITH {_TOKENS}, total AS (SELECT sum(n) AS n FROM tokens),
 own AS (SELECT lower(trim(source)) AS k, sum(n) AS n FROM tokens GROUP BY 1),
 weights AS (SELECT mix_id, sum(target_weight) AS w FROM mixture_targets GROUP BY 1)
 SELECT DISTINCT m.mix_id, m.source FROM mixture_targets m JOIN weights USING (mix_id) CROSS JOIN total LEFT JOIN own ON k = lower(trim(m.source))
 WHERE m.target_weight > 0 AND m.target_weight / weights.w * m.size_ratio * total.n > m.max_repeats * coalesce(own.n, 0)""",
        "p5_found": f"WITH {_SITE_LINES} SELECT DISTINCT page_id, line_no FROM norm JOIN often USING (site, line)",
        "p5_clean": f"""WITH {_SITE_LINES},
 gone AS (SELECT DISTINCT page_id, line_no FROM norm JOIN often USING (site, line)),
 kept AS (SELECT n.page_id, n.line_no, n.line, g.page_id IS NULL AS stays FROM nums n LEFT JOIN gone g ON n.page_id = g.page_id AND n.line_no = g.line_no)
 SELECT p.page_id, (SELECT coalesce(string_agg(k.line, chr(10) ORDER BY k.line_no) FILTER (WHERE k.stays), '') FROM kept k WHERE k.page_id = p.page_id) AS body_text,
  (SELECT count(*) FILTER (WHERE NOT k.stays) FROM kept k WHERE k.page_id = p.page_id)::INT AS n_removed
 FROM pages p UNION ALL SELECT DISTINCT page_id, NULL, 0 FROM crawled_pages WHERE text IS NULL""",
        "p10_found": f"WITH {_SPANS} SELECT doc_id, (min(i) - 1)::INT AS first_word, (max(i) + 28)::INT AS last_word FROM runs2 GROUP BY doc_id, run",
    }
