"""Very long texts: one page or document of several hundred thousand words through every text operator."""

import numpy as np
import pytest

from skein.llm import body, language, neardup, packing, sitelines, spam, spans


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(9)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 60)) + "." for _ in range(4000)]
    return "\n".join(lines)


def test_spans_and_duplicates(spark, long_text):
    other = long_text.replace("w7 ", "q7 ")
    df = spark.createDataFrame([(1, "t", long_text), (2, "t", other), (3, None, "x" * 500_000)], "page_id long, title string, text string")
    assert {tuple(r) for r in neardup.NearDuplicates(df).pairs().collect()} == {(1, 2)}
    docs = df.withColumnRenamed("page_id", "doc_id")
    got = spans.SharedSpans(docs).report().collect()
    assert {r.doc_id: r.shared_share > 0.9 for r in got} == {1: True, 2: True, 3: False}
    p = packing.Packing(docs, spark.createDataFrame([("s", 1000)], "spec_id string, capacity_tokens int"))
    assert {r.doc_id for r in p.oversized().collect()} == {1, 2}


def test_lines(spark, long_text):
    pages = spark.createDataFrame([(i, "http://a.b/", None, long_text if i < 13 else "short") for i in range(14)], "page_id long, url string, final_url string, text string")
    assert sitelines.repeated_lines(pages).count() == 13 * 4000


def test_scores_of_one_long_line():
    line = "word " * 300_000
    known = body.Scores({})
    assert body.classify(None, line, known)[0] == [0]
    assert spam.redundant_words([line.strip()], None, spam.Ordinary([]), spam.Masked())[:2] == (300_000, 300_000)
    x, of = language.windows([line.encode(), b"abc", b""])
    assert x.shape == (-(-len(line) // language.WINDOW) + 2, language.WINDOW) and of[-1] == 2
