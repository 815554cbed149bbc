"""The k most similar vectors of every vector, by a permutation index.

m pivots are drawn from the collection (m = PIVOTS_PER_ROOT * sqrt(n): the bounded sample the index is fitted on, some
ten MB at a hundred million vectors). Each vector is known by its LENGTH nearest pivots in order, and is posted to the
inverted file of each of them; every vector is indexed. A pair of vectors belongs to the file of the first pivot in the
one's order that the other has too, so it is looked at once. In a file a vector ranks the others that are its own there
by the footrule distance of the truncated orders; only the CANDIDATES_PER_ROOT * sqrt(n) nearest, with all that tie with
the last, are reranked by cosine. The best of all its files are its neighbours. Files hold n * LENGTH / m vectors on average; a file
of more than BLOCK vectors is cut into blocks, and pairs of blocks are tasks of their own, so a hot pivot is no hot task.

exact_neighbours answers a stated set of queries against all vectors, in blocks, without the index.

Equal vectors are one class: only its smallest id is searched for, and its first k + 1 ids stand for the class in
answers. Ties in cosine go to the smaller id.

Defined cases: null, all-zero, non-finite vectors, those holding a null and those of another number of dimensions are
left out; of several rows of an id the one of the highest seq counts (ties: the larger vector); null ids are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, spread

DIMS = 64
LENGTH = 12
PIVOTS_PER_ROOT = 2.0
BLOCK = 4096
#: Candidates reranked in a file, in multiples of sqrt(n): as many at every size would lose recall as n grows.
CANDIDATES_PER_ROOT, LEAST_CANDIDATES = 3.0, 32


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims)


def _unit(dims: int):
    def run(batches):
        for b in batches:
            ids, vecs, cls = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not v.is_valid or len(v.values) != dims or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                n = math.sqrt(float(x @ x))
                if 0 < n < math.inf:
                    u = (x / n).astype(np.float32).tobytes()
                    ids.append(i)
                    vecs.append(u)
                    cls.append(xxhash.xxh3_128_digest(u))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cls, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "cls", "vec"])

    return run


def _orders(pivots: np.ndarray, length: int, dims: int):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sim = _matrix(part.column(1), dims) @ pivots.T
                near = np.argpartition(-sim, length - 1, axis=1)[:, :length] if length < sim.shape[1] else np.tile(np.arange(sim.shape[1]), (len(sim), 1))
                order = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(order.tolist(), pa.list_(pa.int32()))], names=["id", "vec", "near"])

    return run


def _search(k: int, candidates: int, min_cos: float, dims: int, rows: int = 256):
    def best(q: np.ndarray, rank: int, query, base, same: bool):
        """Of the query rows q, whose order has the file's pivot at rank: (row, base row, cosine) of the k best of their nearest by footrule."""
        (qv, qo), (bv, weights) = query, base
        n = bv.shape[0]
        length = qo.shape[1]
        shared = np.zeros((len(q), n), np.uint8)
        for r in range(rank):
            shared |= weights[qo[q, r]]
        other = shared > 0  # pairs of an earlier file
        shared.fill(0)
        for r in range(rank, length):
            shared += np.minimum(weights[qo[q, r]], np.uint8(length - r))
        shared[other] = 0
        if same:
            shared[np.arange(len(q)), q] = 0
        # footrule = constant - 2 * shared, so the nearest are those of the largest overlap; all that tie with the last stay
        least = np.partition(shared, n - candidates, axis=1)[:, n - candidates, None] if n > candidates else np.zeros((len(q), 1), np.uint8)
        row, col = np.nonzero((shared >= least) & (shared > 0))
        if not len(row):
            return q[:0], col, np.empty(0)
        cos = np.einsum("ij,ij->i", qv[q[row]], bv[col])
        keep = cos >= min_cos - 1e-6
        row, col, cos = row[keep], col[keep], cos[keep]
        order = np.lexsort((-cos, row))
        row, col, cos = row[order], col[order], cos[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        # those that tie with the k-th stay
        last = np.full(len(q), -2.0)
        last[row[place == k - 1]] = cos[place == k - 1]
        keep = (place < k) | (cos >= last[row])
        return q[row[keep]], col[keep], cos[keep]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        vec = _matrix(table.column("vec"), dims)
        near = np.array(table.column("near").to_pylist(), dtype=np.int64)
        block = table.column("block").to_numpy()
        pivots, local = np.unique(near, return_inverse=True)
        local = local.reshape(near.shape)
        length = near.shape[1]

        def side(pick):
            w = np.zeros((len(pivots), len(pick)), np.uint8)
            for r in range(length):
                w[local[pick, r], np.arange(len(pick))] = length - r
            return pick, (vec[pick], local[pick]), (vec[pick], w)

        blocks = np.unique(block)
        both = table.column("u")[0].as_py() != table.column("v")[0].as_py()
        sides = [side(np.flatnonzero(block == x)) for x in blocks]
        plan = ([(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []) if both else [(s, s) for s in sides]
        out = [[], [], []]
        pivot = table.column("p")[0].as_py()
        for (qi, query, _), (bi, _, base) in plan:
            at = (near[qi] == pivot).argmax(axis=1)
            for rank, lo in ((r, x) for r in range(length) for x in range(0, int((at == r).sum()), rows)):
                a, c, v = best(np.flatnonzero(at == rank)[lo : lo + rows], rank, query, base, not both)
                out[0].append(ids[qi[a]])
                out[1].append(ids[bi[c]])
                out[2].append(v)
        cols = [np.concatenate(x) if x else [] for x in out]
        return pa.table({"id": pa.array(cols[0], pa.string()), "other": pa.array(cols[1], pa.string()), "cosine": pa.array(cols[2], pa.float64())})

    return run


def _classes(vectors: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Usable vectors (id, cls, vec) at unit length, and the classes of equal ones (cls, rep, vec, members)."""
    last = vectors.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("seq", "vector")).alias("x")).select("id", F.col("x.vector").alias("vector"))
    unit = scratch(spread(last).mapInArrow(_unit(dims), "id string, cls binary, vec binary"), "unit")
    return unit, scratch(unit.groupBy("cls").agg(F.min("id").alias("rep"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("members")), "reps")


def exact_neighbours(vectors: DataFrame, wanted: Column, k: int = 5, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """(id, other, cosine, rank): for every usable vector whose id meets the condition its k most similar others, by comparison with all.

    Queries are cut into blocks of about block vectors and all vectors into one part per core; each pair of them is a task
    that keeps k answers a query, so neither a task nor the driver holds more than a block of queries.
    """
    unit, _ = _classes(vectors, dims)
    spark = vectors.sparkSession
    queries = unit.where(wanted)
    n = queries.count()
    if n == 0:
        return spark.createDataFrame([], "id string, other string, cosine double, rank int")
    cuts, parts = -(-n // block), max(1, spark.sparkContext.defaultParallelism)
    h = F.xxhash64("id", F.lit(5))
    asked = queries.select(F.pmod(h, F.lit(cuts)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "id", "vec", F.lit(True).alias("asked"))
    given = unit.select(F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))).alias("b"), F.pmod(h, F.lit(parts)).cast("int").alias("p"), "id", "vec", F.lit(False).alias("asked"))

    def run(table: pa.Table) -> pa.Table:
        q, base = table.filter(pc.field("asked")).sort_by("id"), table.filter(~pc.field("asked")).sort_by("id")
        out = ([], [], [])
        if q.num_rows and base.num_rows:
            names, ids = np.array(q.column("id").to_pylist(), dtype=object), np.array(base.column("id").to_pylist(), dtype=object)
            qv, bv = (_matrix(t.column("vec").combine_chunks(), dims).astype(np.float64) for t in (q, base))
            for lo in range(0, len(names), 256):
                cos = qv[lo : lo + 256] @ bv.T
                cos[names[lo : lo + 256, None] == ids[None, :]] = -2
                order = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # sorted by id, so ties go to the smaller
                row = np.repeat(np.arange(len(order)), order.shape[1])
                got = np.take_along_axis(cos, order, 1).ravel()
                keep = got > -1.5
                for x, y in zip(out, (names[lo + row[keep]], ids[order.ravel()[keep]], got[keep]), strict=True):
                    x.append(y)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], t) for n, x, t in zip(("id", "other", "cosine"), out, (pa.string(), pa.string(), pa.float64()), strict=True)})

    met = asked.unionByName(given).groupBy("b", "p").applyInArrow(run, "id string, other string, cosine double")
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, k: int = 5, min_cos: float = -1.0, dims: int = DIMS, length: int = LENGTH, pivots_per_root: float = PIVOTS_PER_ROOT, candidates_per_root: float = CANDIDATES_PER_ROOT) -> DataFrame:
    """(id, other, cosine, rank): for every usable vector its k most similar others, of cosine min_cos or more."""
    unit, reps = _classes(vectors, dims)
    n = reps.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], "id string, other string, cosine double, rank int")
    m = min(n, max(32, int(pivots_per_root * math.sqrt(n))))
    length = min(length, m)
    candidates = max(LEAST_CANDIDATES, int(candidates_per_root * math.sqrt(n)))
    drawn = reps.select("vec", "rep", F.xxhash64("rep", F.lit(17)).alias("h")).orderBy("h", "rep").limit(m).collect()
    pivots = np.stack([np.frombuffer(r.vec, np.float32) for r in drawn])
    orders = scratch(spread(reps.select("rep", "vec")).mapInArrow(_orders(pivots, length, dims), "id string, vec binary, near array<int>"), "orders")
    # at most one count a pivot
    hot = {r.p: -(-r.n // BLOCK) for r in orders.select(F.explode("near").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).collect()}
    posted = orders.select("id", "vec", "near", F.explode("near").alias("p"))
    if hot:
        cuts = F.create_map(*[F.lit(x) for p, c in hot.items() for x in (p, c)])
        posted = posted.withColumn("cuts", F.coalesce(cuts[F.col("p").cast("int")], F.lit(1)))
    else:
        posted = posted.withColumn("cuts", F.lit(1))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    posted = posted.select("id", "vec", "near", "p", "block", F.least("block", "with").cast("int").alias("u"), F.greatest("block", "with").cast("int").alias("v"))
    met = posted.groupBy("p", "u", "v").applyInArrow(_search(k, candidates, min_cos, dims), "id string, other string, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    best = met.groupBy("id", "other").agg(F.max("cosine").alias("cosine")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("id", "other", "cosine")
    return _expanded(unit, reps, best, k)


def _expanded(unit: DataFrame, reps: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Answers between class representatives, given for every member; at most k + 1 ids of a class stand in answers."""
    many = reps.where("members > 1")
    members = unit.select("id", "cls").join(many.select("cls", "rep"), "cls").select("rep", "id")
    by_id = Window.partitionBy("rep").orderBy("id")
    head = members.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("head"))
    other = best.join(head.withColumnRenamed("rep", "other"), "other", "left").select(F.col("id").alias("rep"), F.coalesce("head", "other").alias("other"), "cosine")
    own = head.select("rep", F.col("head").alias("other"), F.lit(1.0).alias("cosine"))
    by_cos = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    answer = other.unionByName(own).withColumn("r", F.row_number().over(by_cos)).where(F.col("r") <= k + 1)
    given = answer.join(members, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "other", "cosine").where("id <> other")
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return given.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def similar_pairs(vectors: DataFrame, k: int = 5, min_cos: float = 0.85, length: int = 8, pivots_per_root: float = 4.0, candidates_per_root: float = 0.32) -> DataFrame:
    """(id_a, id_b), the smaller first: pairs of cosine min_cos or more, one among the k nearest of the other.

    Vectors this similar have nearly the same order of pivots, so shorter orders, smaller files and fewer candidates find them.
    """
    near = neighbours(vectors, k, min_cos, length=length, pivots_per_root=pivots_per_root, candidates_per_root=candidates_per_root).where(F.col("cosine") >= min_cos)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
