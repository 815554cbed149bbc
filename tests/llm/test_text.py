import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import body, coded, fit, language, langlabels, sitelines, spam, spans

PAGES = "page_id long, url string, final_url string, title string, text string, lang string"


def test_labels():
    cases = {"en": "en", "EN_gb": "en", "German": "de", "français": "fr", " pt-BR ": "pt", "rus": "ru", "x-default": None, "und": None, "": None, None: None, "Nederlands": "nl", "zh (simplified)": "zh"}
    assert {k: langlabels.language_of(k) for k in cases} == cases


def test_best_regions_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.normal(0, 2, rng.integers(0, 9)).tolist()
        keep = body.best_regions(s, 1.0)
        value = lambda k: sum(x for x, b in zip(s, k, strict=True) if b) - sum(1 for i, b in enumerate(k) if b and (i == 0 or not k[i - 1]))
        best = max((value([bool(m >> i & 1) for i in range(len(s))]) for m in range(1 << len(s))), default=0)
        assert value(keep) == pytest.approx(best)


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    for i in range(30):
        w = [f"{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + i // 26)}o" for k in range(12)]
        story = f"The {w[0]} office {w[1]} keeps every {w[2]} of the {w[3]} {w[4]} that {w[5]} during the long {w[6]}, and nobody {w[7]} the {w[8]}. It {w[9]} at {w[10]}."
        rows.append((i, f"https://www.a.com/{i}", None if i % 2 else "", f"Story of {w[11]}", f"Home | About us | Contact\n\nStory of {w[11]}\n{story}\r\nShare this page with a friend\n© {2000 + i} Some Press. All rights reserved.", "en"))
    rows += [rows[3], (100, "https://b.com/", "https://b.com/", None, None, None), (101, "https://b.com/1", "http://B.com:80/1", "", "", "fr"), (102, None, None, "t", "Home | About us | Contact", None), (None, "https://a.com/9", None, "t", "Home | About us | Contact", None)]
    return spark.createDataFrame(rows, PAGES).withColumn("line", F.lit("clash")).withColumn("k1", F.lit(1)).cache()


def test_repeated_lines(site, spark):
    got = {tuple(r) for r in sitelines.repeated_lines(site).collect()}
    assert got == {(i, n) for i in range(30) for n in (0, 4, 5)}
    clean = {r.page_id: r for r in sitelines.without_repeated_lines(site).collect()}
    assert clean[5].n_removed == 3 and "Story of" in clean[5].body_text and "Share" not in clean[5].body_text and clean[100].body_text is None
    assert sitelines.repeated_lines(site.limit(0)).count() == 0


def test_parts_are_the_features_summed():
    pages = [("Story", f"Home | About us | Contact\nStory\nThe office number {i} of the old town keeps a long register of every boat that calls.\n© 20{i:02d} Some Press") for i in range(30)]
    weights = body.train(pages)
    known, tokens = body.Scores(weights), body.Tokens()
    for line in pages[3][1].split("\n"):
        own, seen, shape = body.features_of(line, line, tokens)
        got = known.parts(line, line)
        assert got[0] == pytest.approx(sum(weights.get(f, 0) for f in own)) and got[1] == pytest.approx(sum(weights.get(f, 0) for f in seen)) and got[3] == shape
    assert body.train([]) == {} and body.classify(None, "\n \n", body.Scores({})) == ([], [], [])


def test_furniture(site):
    got = {tuple(r) for r in body.furniture_lines(site).where("page_id < 30").collect()}
    assert got == {(i, n) for i in range(30) for n in (0, 4, 5)}
    texts = {r.page_id: r.body for r in body.body_text(site).collect()}
    assert texts[7].startswith("Story of hlao\nThe haao") and texts[100] is None and body.furniture_lines(site.limit(0)).count() == 0


def test_spam(site, spark):
    words = "cheap shoes buy shoes online shoes best shoes sale shoes "
    links = "\n".join(f"shoes best price https://x{i}.example/{i * 77}" for i in range(40))
    prose = "\n".join(f"- Shoes number {i}: they are made by hand in the old town and last for a very long time." for i in range(20))
    rows = [(1000, "u", "u", "t", words * 30, "en"), (1001, "u", "u", "t", links, "en"), (1002, "u", "u", "t", prose, "en"), (1003, "u", "u", "t", "short list", None)]
    both = site.select("page_id", "url", "final_url", "title", "text", "lang").unionByName(spark.createDataFrame(rows, PAGES))
    found = {r.page_id for r in spam.redundancy(both).where("found").collect()}
    assert found == {1000, 1001}


def _many(n, tongue=False):
    """n pages; with tongue each hundredth is in Dutch, of sentences that compress better than the English ones."""
    for i in range(n):
        w = [f"{chr(97 + i * k % 23)}{chr(97 + i * (k + 3) // 7 % 25)}{chr(97 + (i + k) % 11)}o" for k in range(12)]
        dutch = tongue and i % 100 == 0
        story = f"The {w[0]} office {w[1]} keeps every {w[2]} of the {w[3]} {w[4]} that {w[5]} during the long {w[6]}, and nobody {w[7]} the {w[8]}. It {w[9]} at {w[10]}." + f" In {w[3]} the {w[9]} of {w[4]} was not at all like the {w[1]} by the {w[8]}." * (i % 2)
        if dutch:
            story = " ".join(["de boot van de haven en de boot van de stad gaan samen langs de boot van de zee."] * (2 + i // 100 % 4))
        title = None if tongue else f"Story of {w[11]}"
        yield i, "u", "u", title, f"Home | About us | Contact\n{title + chr(10) if title else ''}{story}\nShare this page with a friend\n© {2000 + i % 30} Some Press. All rights reserved.", "nl" if dutch else "en"


def test_fit_is_that_of_all_pages(spark):
    rows = list(_many(4000))
    got = fit.train_on(spark.createDataFrame(rows, PAGES).repartition(5))
    whole, part = (body.train([r[3:5] for r in x]) for x in (rows, rows[:3000]))
    assert got == pytest.approx(whole, abs=1e-6) and part != pytest.approx(whole, abs=1e-3)
    assert fit.train_on(spark.createDataFrame([], PAGES)) == {} == fit.train_on(spark.createDataFrame([(1, "u", "u", "t", "a", None)], PAGES))


def test_lines_at_once_are_as_one_by_one():
    # keys, labels, features, scores and gradient of many lines on arrays are those of body, and shared tags are kept once
    odd = [("Final ΣΑΣ", "a  b\nΣΑΣ x\nfoo Final ΣΑΣ\nFINAL ΣΑΣ\n§2 abc © 2.3.2020\nX X T 12\nA/B C/D a/b b\nFinal ΣΑΣ"), (None, "one\ntwo · three\n" + "word " * 3000 + "\n(1) (2) x (3)"), ("", "\n"), (None, "a")]
    texts = [r[3:5] for r in _many(600)] + odd * 6
    split = [(h, lines, raws) for h, _, lines, raws in (body.lines_of(*t) for t in texts)]
    pages = [p for p in split if len(p[1]) > 2]
    often = collections.Counter(w for _, lines, _ in pages for w in {w for x in lines for w in body.words_of(x)})
    known, rare = body.Tokens(), body.often_words(often, len(pages))
    c = coded.Chunk(pages, coded.Lines(rare))
    c.titles()
    c.shapes()
    c.tags()
    facts, (block, names) = c.facts(), fit.block_of(c)
    patterns = body.Patterns(known, rare)
    keys = [patterns.of(x, h) for h, lines, _ in pages for x in lines]
    for mine, want in zip(facts.keys.tolist(), zip(*keys, strict=True), strict=True):
        assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want, strict=True)))
    on = collections.Counter(k for x, p in zip(facts.keys, [c.page] * 4, strict=True) for k, _ in set(zip(x.tolist(), p.tolist(), strict=True)))
    seen = collections.Counter(facts.keys.ravel().tolist())
    y = facts.labels(lambda x: np.array([on[k] if seen[k] <= 1.25 * on[k] else 0 for k in x.tolist()]), len(pages))
    labels = body.labels(pages, known)
    assert y.tolist() == [k for page in labels for k in page]

    lines = [x for p, mine in zip(pages, labels, strict=True) for x in body.Features(known).of(*p, mine)]
    count = collections.Counter(f for x, _, _ in lines for f in x)
    assert {f: n for f, n in zip(names, block.features(len(names), y >= 0).tolist(), strict=True) if n} == count
    assert len(block.parts) + len(block.words) < sum(count.values()) / 2
    ids = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 9))}
    rows = [[*(ids[f] for f in x if f in ids), *([len(ids)] if any(f not in ids for f in x) else [])] for x, _, _ in lines]
    w, label, weight = np.random.default_rng(0).normal(size=len(ids) + 1), np.array([y for _, y, _ in lines]), np.array([x for _, _, x in lines])
    want = body.gradient(w, np.concatenate(rows), np.array(list(map(len, rows))), label, weight)
    kept = block.kept(np.array([ids.get(f, -1) for f in names]), len(ids), y >= 0)
    assert kept.gradient(w, label, c.alike[y >= 0] ** -0.5) == pytest.approx(want)

    weights = {**{f: float(w[i]) for f, i in ids.items()}, "§rare": float(w[-1])}
    one, many = body.Scores(weights), coded.LineScores(weights)
    assert [s for part in coded.chunks(split) for page in many.of(part) for s in page] == pytest.approx([s for p in split for s in one.of(*p)])


def test_ordinary_text_is_that_of_all_pages(spark):
    # 60 Dutch pages of 6,000: enough for a fit of their own only if all are read
    rows = list(_many(6000, True))
    got = spam.redundancy(spark.createDataFrame(rows + rows[:2], PAGES))
    dutch = [r.least_ratio for r in got.where("page_id % 100 = 0").collect()]
    assert len(dutch) == 60 and np.mean(np.log(dutch)) == pytest.approx(0, abs=0.02)


def test_language(spark):
    seeds = {"en": "the house and the garden are near the river because we like water", "de": "das haus und der garten sind nahe am fluss weil wir das wasser lieben", "ru": "дом и сад находятся у реки потому что мы любим воду и лес"}
    rows = [(i, lang, " ".join(np.random.default_rng(i).permutation(text.split()).tolist() * 2)) for i, (lang, text) in enumerate((k, v) for k, v in seeds.items() for _ in range(12))]
    samples = spark.createDataFrame(rows, "sample_id int, lang string, text string")
    model = language.train(samples)
    line = {k: " ".join(v.split() * 2) for k, v in seeds.items()}
    pages = [(1, line["en"] + "\n" + line["de"], "English"), (2, line["ru"] + "\r\n", None), (3, "https://a.b/c " * 14, "en"), (4, "#tag " * 14, "en"), (5, None, "en"), (6, "", None), (7, "the house " * 3, "de"), (1, line["en"] + "\n" + line["de"], "English")]
    df = spark.createDataFrame(pages, "page_id long, text string, lang string")
    assert {tuple(r) for r in language.unnamed_languages(df, model).collect()} == {(1, "de"), (2, "ru")}
    assert {(r.page_id, r.first_line, r.lang) for r in language.segments(df, model).where("page_id < 3").collect()} == {(1, 0, "en"), (1, 1, "de"), (2, 0, "ru")}
    with pytest.raises(ValueError):
        language.train(samples.limit(0))


def test_language_held_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet").toPandas()
    order = np.random.default_rng(0).permutation(len(rows))
    fit, held = order[:240], order[240:]
    model = language.ByteCnn(sorted(rows.lang.unique())).fit(list(rows.text[fit]), list(rows.lang[fit]))
    found = language.classify_lines(list(rows.text[held]), model)
    assert np.mean([a == b for (a, _), b in zip(found, rows.lang[held], strict=True)]) >= 0.93


def _spans(docs, n):
    where = collections.defaultdict(set)
    words = {i: (t or "").split() for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    out = set()
    for i, w in words.items():
        cover = [any(len(where[tuple(w[k : k + n])]) > 1 for k in range(max(0, p - n + 1), min(p, len(w) - n) + 1)) for p in range(len(w))]
        start = None
        for p, c in enumerate([*cover, False]):
            if c and start is None:
                start = p
            elif not c and start is not None:
                out.add((i, start, p - 1))
                start = None
    return out


def test_spans_against_brute_force(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    shared = text(70)
    docs = [(1, text(50) + " " + shared + " " + text(20)), (2, shared.replace(" ", "\n\t", 30)), (3, text(10) + " " + " ".join(shared.split()[5:36])), (4, text(29)), (5, None), (6, ""), (7, text(90))]
    docs += [(8, docs[6][1]), (9, docs[6][1].replace(" ", "  ")), (10, "a " * 200), (11, "a " * 60), (12, text(300) + " " + shared)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, h string")
    s = spans.SharedSpans(df)
    assert {tuple(r) for r in s.spans().collect()} == _spans(docs, 30)
    r = {x.doc_id: x for x in s.report().collect()}
    assert r[8].shared_words == 90 and r[7].shared_share == 1.0 and r[4].shared_words == 0 and r[6].n_words == 0
    assert {x.doc_id: x.window_words for x in s.longest().collect()}[1] == 60
    assert spans.SharedSpans(df.limit(0)).spans().count() == 0


def test_longest_of_copies(spark):
    text = lambda a, n: " ".join(f"w{x}" for x in range(a, a + n))
    docs = [(1, text(0, 130)), (2, text(0, 130)), (3, text(0, 130).replace(" ", "\n")), (4, text(900, 29)), (5, text(900, 29)), (6, text(500, 60)), (7, text(500, 60)), (8, text(90, 40) + " " + text(2000, 200)), (9, text(5000, 99))]
    s = spans.SharedSpans(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.window_words for r in s.longest().collect()} == {1: 120, 2: 120, 3: 120, 6: 60, 7: 60, 8: 30}


def test_window_hash_depends_on_words_only():
    w = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    assert (spans.window_hashes(np.concatenate([w[:7], w]), 15)[7:] == spans.window_hashes(w, 15)).all()
    assert len(spans.window_hashes(w[:3], 15)) == 0


def test_normal_line_rule(spark):
    norm = spark.createDataFrame([("  A  B 12-345 ",)], "line string").select(sitelines._normal(F.col("line"))).first()[0]
    assert norm == re.sub("[0-9]+", "0", "a b 12-345")
