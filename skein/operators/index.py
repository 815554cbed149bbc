"""Inverted index tables: postings, term and field statistics.

Postings carry the length of their field in their document, so scoring needs no join for it. Positions are those among
the kept tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, spread
from skein.functions.text import STOPWORDS, TOKEN, normalize_text, stem
from skein.plans.model import FieldMapping


@dataclass
class InvertedIndex:
    """postings(field, term, id, seq, tf, positions, dl), terms(field, term, df, first_seq, first_pos), fields(field, n_docs, total_len)."""

    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    n_docs: int
    average: dict[str, float]


def field_text(df: DataFrame, name: str):
    """A field as text: scalars as strings, arrays joined by spaces."""
    kind = dict(df.dtypes)[name]
    return F.array_join(F.col(name).cast("array<string>"), " ") if kind.startswith("array") else F.col(name).cast("string")


def _analysed(names: list[str], whole: list[bool], stopwords: bool, stemming: bool, ascii_only: bool):
    """Postings of each batch of (id, seq, texts...): a document's terms are counted where it is read, not shuffled."""
    token = re.compile(TOKEN)

    def run(batches):
        stop = frozenset(STOPWORDS) if stopwords else frozenset()
        stems: dict[str, str] = {}
        for b in batches:
            row, field, term, tf, dl, at = [], [], [], [], [], []
            for k, name in enumerate(names):
                for i, text in enumerate(b.column(2 + k).to_pylist()):
                    if not text:
                        continue
                    text = text.lower() if ascii_only or text.isascii() else normalize_text(text)
                    if whole[k]:
                        words = [text.strip()] if text.strip() else []
                    else:
                        words = [t for t in token.findall(text) if len(t) > 1 and t not in stop]
                        if stemming:
                            words = [stems[t] if t in stems else stems.setdefault(t, stem(t)) for t in words]
                            if len(stems) > 500_000:
                                stems.clear()
                    places: dict[str, list[int]] = {}
                    for p, w in enumerate(words):
                        places.setdefault(w, []).append(p)
                    row += [i] * len(places)
                    field += [name] * len(places)
                    term += places
                    at += places.values()
                    dl += [len(words)] * len(places)
            tf = [len(x) for x in at]
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(field, pa.string()), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(dl, pa.int64())],
                names=["id", "seq", "field", "term", "tf", "positions", "dl"],
            )

    return run


def posting_rows(docs: DataFrame, mappings: dict[str, FieldMapping], stopwords: bool = True, stemming: bool = True, ascii_only: bool = False) -> DataFrame:
    """(id, seq, field, term, tf, positions, dl) of the indexed text and keyword fields of docs (id, seq, fields...), without a shuffle."""
    used = [(n, m) for n, m in mappings.items() if m.index and m.type in ("text", "keyword") and n in docs.columns]
    if not used:
        raise ValueError("no indexed field")
    kinds = dict(docs.dtypes)
    texts = spread(docs.select("id", F.col("seq").cast("bigint").alias("seq"), *[field_text(docs, n).alias(f"f{i}") for i, (n, _) in enumerate(used)]))
    run = _analysed([n for n, _ in used], [m.type == "keyword" or m.analyzer == "keyword" for _, m in used], stopwords, stemming, ascii_only)
    return texts.mapInArrow(run, f"id {kinds['id']}, seq bigint, field string, term string, tf bigint, positions array<int>, dl bigint")


def _written(df: DataFrame, at: str | None, name: str) -> DataFrame:
    if at is None:
        return scratch(df, name)
    df.write.mode("overwrite").parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def build(docs: DataFrame, mappings: dict[str, FieldMapping], stopwords: bool = True, stemming: bool = True, ascii_only: bool = False, at: str | None = None) -> InvertedIndex:
    """Index docs: postings are shuffled once, to their place by (field, term), and written sorted.

    The shuffle is a rebalance, so a partition that a frequent term makes large is split by the runtime. at: a folder
    that keeps the tables, from which load() reads them.
    """
    rows = posting_rows(docs, mappings, stopwords, stemming, ascii_only)
    postings = _written(rows.hint("rebalance", "field", "term").sortWithinPartitions("field", "term"), at, "postings")
    terms = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("seq", F.col("positions")[0].alias("pos"))).alias("f")).select(
        "field", "term", "df", F.col("f.seq").alias("first_seq"), F.col("f.pos").alias("first_pos")
    )
    # every document of a field has one term at its first position
    lens = postings.groupBy("field").agg(F.count(F.when(F.col("positions")[0] == 0, 1)).alias("n_docs"), F.sum("tf").alias("total_len"))
    terms, lens = _written(terms, at, "terms"), _written(lens, at, "fields")
    n_docs = docs.count()
    if at is not None:
        docs.sparkSession.createDataFrame([(n_docs,)], "n_docs long").coalesce(1).write.mode("overwrite").parquet(f"{at}/size")
    return InvertedIndex(postings, terms, lens, n_docs, _averages(lens))


def _averages(lens: DataFrame) -> dict[str, float]:
    return {r.field: r.total_len / r.n_docs if r.n_docs else 1.0 for r in lens.collect()}  # a row a field


def load(spark: SparkSession, at: str) -> InvertedIndex:
    """The index that build() left in a folder."""
    postings, terms, lens, size = (spark.read.parquet(f"{at}/{n}") for n in ("postings", "terms", "fields", "size"))
    return InvertedIndex(postings, terms, lens, size.first()[0], _averages(lens))


def latest(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The row of the highest order of each key."""
    names = [c for c in rows.columns if c not in (key, order)]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_x"))
    return last.select(*[F.col("_x").getField(c).alias(c) for c in rows.columns]) if names else rows.groupBy(key).agg(F.max(order).alias(order)).select(*rows.columns)


def upsert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """docs with new rows instead of those of the same id; within new the last seq counts."""
    new = latest(new)
    return docs.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id").distinct(), "id", "left_anti")
