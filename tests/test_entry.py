import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("skein.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skein.llm", None)
    importlib.reload(entry)
    assert "bm25_multi_term" in entry.queries() and "p5_found" not in entry.queries() and "p1_found" in entry.queries()


def test_upsert_orders_takes_the_whole_table(spark, tmp_path):
    spark.range(1, 61).selectExpr("id AS o_orderkey", "double(id) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.price for r in entry.queries()["upsert_orders"](spark, str(tmp_path)).collect()}
    assert got == {i: i * 2.0 if i % 3 == 0 else float(i) for i in range(1, 61)} | {-1 - i: float(i) for i in range(10, 61, 10)}


def test_embeddings_are_of_whole_documents(spark, tmp_path):
    from skein.functions.embed import local_embed, micro_embed

    rows = [(1, "Harbour", "old office " * 300 + "lantern"), (2, None, "a text without title"), (3, "Title alone", None)]
    spark.createDataFrame([(*r, "en", "web") for r in rows], "doc_id long, title string, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = {i: " ".join([t] * 3 * bool(t) + [x] * bool(x)) for i, t, x in rows}
    for name, embed in (("embed_local", local_embed), ("embed_micro", micro_embed)):
        got = {r.id: r.vec for r in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert all(len(got[i]) == 384 and max(abs(a - b) for a, b in zip(got[i], embed(whole[i]), strict=True)) < 1e-6 and any(got[i]) for i in whole)
