"""Vector metrics, 8-bit quantisation, exact nearest neighbours, noise floor, and hybrid ranking."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import js_round
from skein.plans.model import EngineError

MIN_ABSOLUTE, RELATIVE = 0.15, 0.45


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either norm is 0."""
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(n == 0, 0.0).otherwise(_dot(a, b) / n)


def dot(a: Column, b: Column) -> Column:
    return _dot(a, b)


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.sqrt(d))


METRICS = {"cosine": cosine, "dot": dot, "euclidean": euclidean}


def metric(name: str):
    return METRICS.get(name or "cosine", cosine)


def quantize(v: Column) -> Column:
    """STRUCT<q ARRAY<TINYINT>, min, scale> of a vector: 255 steps over its range; a range of 0 counts as 1."""
    low = F.array_min(v).cast("double")
    span = F.array_max(v).cast("double") - low
    scale = F.lit(255.0) / F.when(span == 0, 1.0).otherwise(span)
    q = F.transform(v, lambda x: (F.floor((x.cast("double") - low) * scale + 0.5) - 128).cast("tinyint"))
    return F.struct(q.alias("q"), low.alias("min"), scale.alias("scale"))


def dequantize(q: Column) -> Column:
    return F.transform(q["q"], lambda x: (x.cast("double") + 128) / q["scale"] + q["min"])


def check_dims(vectors: DataFrame, dims: int, column: str = "vec") -> tuple[DataFrame, DataFrame]:
    """Rows of dims dimensions, and the others with the error ERR_VECTOR_DIM."""
    ok = F.coalesce(F.size(column) == dims, F.lit(False))
    return vectors.where(ok), vectors.where(~ok).withColumn("error", F.lit("ERR_VECTOR_DIM"))


def _scores(query: np.ndarray, name: str):
    q = query.astype(np.float64)

    def run(batches):
        for b in batches:
            ids, col = b.column(0), b.column(1)
            sizes = np.diff(col.offsets.to_numpy()) if len(col) else np.zeros(0, int)
            good = pa.array((sizes == len(q)) & np.asarray(col.is_valid()))
            col, ids = col.filter(good), ids.filter(good)
            m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            if name == "dot":
                s = m @ q
            elif name == "euclidean":
                s = 1 / (1 + np.sqrt(((m - q) ** 2).sum(axis=1)))
            else:
                n = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
                s = np.divide(m @ q, n, out=np.zeros(len(m)), where=n > 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s)], names=["id", "score"])

    return run


def knn(vectors: DataFrame, query: list[float], k: int = 10, name: str = "cosine", candidates: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """(id, score) of the k best of vectors (id, vec): one scan with batched products and a top-k, no shuffle of the vectors."""
    kind = dict(vectors.dtypes)["id"]
    if candidates is not None:
        vectors = vectors.join(candidates.select("id"), "id", "left_semi")
    out = vectors.select("id", "vec").mapInArrow(_scores(np.asarray(query), name), f"id {kind}, score double")
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return out.orderBy(F.desc("score"), "id").limit(k)


def knn_many(vectors: DataFrame, queries: dict[Any, list[float]], k: int = 10, name: str = "cosine", block: int = 1024) -> DataFrame:
    """(qid, id, score, rank): the k best for each of a stated set of query vectors. Each partition sends k rows a query."""
    kinds = dict(vectors.dtypes)
    qids = list(queries)
    q = np.asarray([queries[x] for x in qids], dtype=np.float64)
    if name == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches):
        best: list[tuple[np.ndarray, np.ndarray]] | None = None
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                col, ids = part.column(1), part.column(0)
                good = pa.array(np.asarray(col.is_valid()) & (np.diff(col.offsets.to_numpy()) == q.shape[1]))
                m = col.filter(good).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                names = ids.filter(good).to_numpy(zero_copy_only=False)
                if name == "cosine":
                    n = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                s = q @ m.T if name != "euclidean" else 1 / (1 + np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (m**2).sum(1)[None] - 2 * q @ m.T)))
                at = np.tile(np.arange(len(names)), (len(q), 1))
                pool, tags = (s, names[at]) if best is None else (np.hstack([best[0], s]), np.hstack([best[1], names[at]]))
                if pool.shape[1] > k:
                    top = np.argpartition(-pool, k - 1, axis=1)[:, :k]
                    pool, tags = np.take_along_axis(pool, top, 1), np.take_along_axis(tags, top, 1)
                best = (pool, tags)
        if best is not None and best[0].shape[1]:
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in qids for _ in range(n)]), pa.array(best[1].ravel()), pa.array(best[0].ravel())], names=["qid", "id", "score"])

    kind = "bigint" if all(isinstance(x, int) for x in qids) else "string"
    out = vectors.select("id", "vec").mapInArrow(run, f"qid {kind}, id {kinds['id']}, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def noise_floor(hits: DataFrame, top_k: int | None = None, absolute: float = MIN_ABSOLUTE, relative: float = RELATIVE) -> DataFrame:
    """Hits of at least max(absolute, relative * best)."""
    best = hits.agg(F.max("score").alias("_best"))
    out = hits.crossJoin(F.broadcast(best)).where(F.col("score") >= F.greatest(F.lit(absolute), F.col("_best") * relative)).drop("_best")
    return out.orderBy(F.desc("score"), "id").limit(top_k) if top_k else out


def min_max(hits: DataFrame, name: str) -> DataFrame:
    """(id, name): scores scaled to 0..1 over the list (at most a few hundred rows); no range gives 1, or 0 if all are 0."""
    ends = hits.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).when(F.col("_hi") == 0, 0.0).otherwise(1.0)
    return hits.crossJoin(F.broadcast(ends)).select("id", scaled.alias(name))


def linear(keyword: DataFrame, semantic: DataFrame, weight: float = 0.55) -> DataFrame:
    """(id, score): weight * keyword + (1 - weight) * semantic over both normalised lists."""
    w = min(1.0, max(0.0, weight))
    both = min_max(keyword, "k").join(min_max(semantic, "s"), "id", "full_outer")
    return both.select("id", (F.lit(w) * F.coalesce("k", F.lit(0.0)) + F.lit(1 - w) * F.coalesce("s", F.lit(0.0))).alias("score"))


def reciprocal_rank(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """(id, score): sum over the lists of weight / (k + rank), ranks from 1 by score down, id up."""
    out = None
    for hits, w in zip(lists, weights or [1.0] * len(lists), strict=True):
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id"))
        part = hits.select("id", (F.lit(float(w)) / (k + rank)).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.sum("part").alias("score"))


def hybrid(keyword: DataFrame, semantic: DataFrame, mode: str = "linear", weight: float = 0.55, k: int = 60, min_score: float | None = None) -> DataFrame:
    """The blended list, rounded to 3 places, without scores of at most 0.01 (or under min_score, where 0 means the default)."""
    out = reciprocal_rank([keyword, semantic], k) if mode == "rrf" else linear(keyword, semantic, weight)
    out = out.where(F.col("score") >= min_score) if min_score else out.where(F.col("score") > 0.01)
    return out.withColumn("score", js_round(F.col("score")))


def require_dims(query: list[float], dims: int) -> None:
    if len(query) != dims:
        raise EngineError("ERR_VECTOR_DIM", f"expected {dims} dimensions, got {len(query)}")
