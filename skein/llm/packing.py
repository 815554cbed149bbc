"""Documents combined into containers of fixed capacity, by bin completion with branch and bound.

Documents of equal size are interchangeable, so the search runs over the counts of each size: at most as many numbers as
the capacity, whatever the number of documents. Around the largest size left, a filling of the remaining room is chosen:
the best-fit one is the incumbent; if it wastes room, a table of the sums that the remaining sizes can still reach is the
waste bound, and the depth-first search, larger sizes first, enters no branch that can't end in the least waste. Of
fillings of one sum the one of larger documents comes first and dominates. It needs no limit of steps. A filling is used
as often as the counts allow.

The whole packing is branched too. The incumbents are the best-fit-decreasing packing and the one of dominating
fillings. As long as more containers are used than the tokens need at least, other branches are run in which one class
of sizes (those of which m fit a container) is put first, for a share of its tokens: middling sizes left to the end pack
badly among themselves. The first branch that meets the bound is optimal and ends the search; else the best one stands.

Which document goes where is then worked out in parallel: documents are ranked within their size and the plan says which
ranks go to which container.

A document of more tokens than the capacity is cut: as many full containers as it fills, and the rest as one item.
Defined cases: null or empty texts have size 0 and go to container 0; an empty table gives no rows; capacities that are
null or below 1 are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import scratch
from skein.llm.tokens import ranked, token_counts

#: Branches of the whole packing: classes of sizes by how many fit a container, and the shares of them put first.
CLASSES, SHARES = range(2, 13), (1.0, 0.5, 0.25)

Filling = tuple[tuple[int, int], ...]


def best_fit(room: int, sizes: list[int], left: dict[int, int]) -> Filling:
    """Fill room with the largest sizes that fit."""
    out = []
    for s in sizes:
        if s <= room and left[s]:
            n = min(left[s], room // s)
            out.append((s, n))
            room -= n * s
        if not room:
            break
    return tuple(out)


def completion(room: int, sizes: list[int], left: dict[int, int]) -> Filling:
    """The filling of room of the least waste; of several, the one that takes most of the sizes that come first."""
    best = best_fit(room, sizes, left)
    if sum(s * n for s, n in best) == room:
        return best
    usable = [s for s in sizes if s <= room and left[s]]
    full = (1 << (room + 1)) - 1
    reach = [1]  # bit sets of the sums that the sizes from the last to this one can reach
    for s in reversed(usable):
        sums, n, k = reach[-1], min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            sums |= (sums << (s * k)) & full
            n -= k
            k *= 2
        reach.append(sums)
    reach.reverse()
    rest, out = reach[0].bit_length() - 1, []
    for s, then in zip(usable, reach[1:], strict=True):
        if not rest:
            break
        n = next(n for n in range(min(left[s], rest // s), -1, -1) if then >> (rest - n * s) & 1)
        if n:
            out.append((s, n))
            rest -= n * s
    return tuple(out)


def plan(counts: dict[int, int], capacity: int, fill=completion, first: int = 0, share: float = 1.0) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used, over all documents of sizes 1 to capacity.

    first: sizes of which so many fit a container are put before the larger ones, for a share of their tokens.
    """
    left = {s: n for s, n in counts.items() if s > 0 and n > 0}
    sizes = sorted(left, reverse=True)
    chosen = {s for s in sizes if first and capacity // s == first}
    quota = share * sum(s * left[s] for s in chosen)
    out = []
    while sizes:
        s = sizes[0]
        left[s] -= 1
        order = sorted(sizes, key=lambda x: x not in chosen) if quota > 0 else sizes
        rest = fill(capacity - s, order, left)
        left[s] += 1
        need: dict[int, int] = {s: 1}
        for x, n in rest:
            need[x] = need.get(x, 0) + n
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= times * n
            quota -= times * n * x if x in chosen else 0
        out.append((tuple(sorted(need.items(), reverse=True)), times))
        sizes = [x for x in sizes if left[x]]
    return out


def best_plan(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The packing of the fewest containers over all branches; the search ends at one that meets the bound."""
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    used = lambda p: sum(t for _, t in p)
    best = min(plan(counts, capacity), plan(counts, capacity, best_fit), key=used)
    for share in SHARES:
        for first in CLASSES:
            if used(best) <= bound:
                return best
            if any(s and capacity // s == first for s in counts):
                best = min(best, plan(counts, capacity, first=first, share=share), key=used)
    return best


def _slots(fillings: list[tuple[Filling, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first ranks, first containers and documents per container of the plan's lines."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for filling, times in fillings:
        for s, n in filling:
            out.setdefault(s, []).append((used.get(s, 0), base, n))
            used[s] = used.get(s, 0) + n * times
        base += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for s, rows in out.items()}


def _place(plans: dict[str, dict]):
    def run(batches):
        for b in batches:
            spec = b.column(0).to_pylist()
            size, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            out = np.zeros(b.num_rows, np.int64)
            for i, (p, s, r) in enumerate(zip(spec, size.tolist(), rank.tolist(), strict=True)):
                if s:
                    first, base, per = plans[p][s]
                    k = int(np.searchsorted(first, r, side="right")) - 1
                    out[i] = base[k] + (r - first[k]) // per[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=["spec_id", "doc_id", "piece_no", "tokens", "container_id"])

    return run


class Packing:
    """The packing of one documents table into every container size of specs (a small table, which is collected)."""

    def __init__(self, documents: DataFrame, specs: DataFrame):
        self.spark = documents.sparkSession
        self.caps = {r.spec_id: int(r.capacity_tokens) for r in specs.where("capacity_tokens >= 1 AND spec_id IS NOT NULL").select("spec_id", "capacity_tokens").collect()}
        sizes = scratch(token_counts(documents), "tokens")
        cases = F.array(*[F.struct(F.lit(k).alias("spec_id"), F.lit(v).cast("long").alias("cap")) for k, v in self.caps.items()])
        cut = sizes.select("doc_id", "n_tokens", F.explode(cases).alias("c")).select("c.spec_id", "c.cap", "doc_id", "n_tokens")
        last = F.greatest(F.ceil(F.col("n_tokens") / F.col("cap")).cast("long") - 1, F.lit(0).cast("long"))
        self.pieces = cut.select("spec_id", "cap", "doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("i", "piece_no")).select(
            "spec_id", "doc_id", "piece_no", F.least("cap", F.col("n_tokens") - F.col("piece_no") * F.col("cap")).alias("tokens")
        )
        self.counts: dict[str, dict[int, int]] = {k: {} for k in self.caps}
        for r in self.pieces.groupBy("spec_id", "tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # at most capacity + 1 rows a spec
            self.counts[r.spec_id][r.tokens] = r.n
        self.plans = {k: best_plan(self.counts[k], c) for k, c in self.caps.items()}

    def containers(self) -> DataFrame:
        """(spec_id, doc_id, piece_no, tokens, container_id) of every piece of every document."""
        rows = ranked(self.pieces.withColumn("h", F.xxhash64("doc_id", "piece_no")), ["spec_id", "tokens"], "h")
        slots = {k: _slots(p) for k, p in self.plans.items()}
        return rows.select("spec_id", "doc_id", "piece_no", "tokens", "rank").mapInArrow(_place(slots), "spec_id string, doc_id long, piece_no long, tokens long, container_id long")

    def oversized(self) -> DataFrame:
        """(spec_id, doc_id) of the documents that had to be cut."""
        return self.containers().where("piece_no > 0").select("spec_id", "doc_id").distinct()

    def summary(self) -> DataFrame:
        """Per spec: containers, the fewest its tokens could need, tokens, and the share of room filled, measured on the placed pieces."""
        from pyspark.sql import types as T

        schema = T.StructType([T.StructField("spec_id", T.StringType()), T.StructField("capacity", T.LongType())])
        caps = self.spark.createDataFrame(list(self.caps.items()), schema)
        filled = self.containers().where("tokens > 0").groupBy("spec_id", "container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("p"))
        per = filled.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("p").alias("n_pieces"))
        return per.join(caps, "spec_id").select(
            "spec_id", "capacity", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).cast("long").alias("least_containers"), "tokens", "fullest", "n_pieces",
            (F.col("tokens") / (F.col("n_containers") * F.col("capacity"))).alias("filled_share"),
        )
