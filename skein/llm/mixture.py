"""Mixtures of sources at target weights, by subset-sum budget fitting.

For each mix the token budget is size_ratio times the tokens of all documents; a source's target is its weight's share of
it. A source is repeated whole as often as the target and its cap allow; of what is then missing, each size of document
gives its proportional number, and the remaining budget is fitted exactly by a bounded-knapsack programme over the
sizes' counts, which finds the largest sum that doesn't exceed it. Which documents of a size are taken is decided by a
seeded hash. Only counts by source and exact size come to the driver: for the sources named in the targets, at most as
many numbers each as there are different sizes.

Sources are compared trimmed and lower-cased. Defined cases: null and zero weights are no targets; a source that is in no
document reaches nothing; documents without source count in the total only; several rows of one source in a mix are
fitted one by one.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import scratch
from skein.llm.tokens import ranked, token_counts

#: Largest sizes a remaining budget is first filled down to, in multiples of the largest one; the programme fits what is left.
WINDOW = 8


def subset_sum(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each size to take for the largest sum up to budget: bounded knapsack over bit sets.

    Of every sum only the first item that reaches it is remembered, so memory grows with the budget alone.
    """
    items: list[tuple[int, int]] = []
    for s, n in sorted(counts.items(), reverse=True):
        n, k = min(n, budget // s) if s else 0, 1
        while n > 0:
            k = min(k, n)
            items.append((s, k))
            n -= k
            k *= 2
    full = (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int32)
    reach = 1
    for i, (s, k) in enumerate(items):
        new = (reach << (s * k)) & full & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
            first[np.flatnonzero(bits)] = i
            reach |= new
            if reach >> budget & 1:
                break
    total = reach.bit_length() - 1
    out: dict[int, int] = defaultdict(int)
    while total:
        s, k = items[first[total]]
        out[s] += k
        total -= s * k
    return dict(out)


def fill(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each size to take for the largest sum up to budget.

    The largest sizes are taken until WINDOW times the largest is left, which the programme then fits. A budget that is
    met is met best; where it isn't, the programme runs over the whole budget, so the result is the best one always.
    """
    left, take, rest = dict(counts), defaultdict(int), budget
    keep = WINDOW * max(counts, default=0)
    for s in sorted(counts, reverse=True):
        n = min(left[s], max(0, rest - keep) // s) if s else 0
        take[s] += n
        left[s] -= n
        rest -= n * s
    for s, n in subset_sum(left, rest).items():
        take[s] += n
        rest -= n * s
    best = {s: n for s, n in take.items() if n}
    if rest > 0 and sum(best.values()) < sum(n for s, n in counts.items() if s):
        best = subset_sum(counts, budget)
    return best


def fit(counts: dict[int, int], target: int, max_repeats: int) -> tuple[int, dict[int, int]]:
    """Whole repeats of a source, and how many documents of each size come once more."""
    tokens = sum(s * n for s, n in counts.items())
    if tokens <= 0 or target <= 0 or max_repeats <= 0:
        return 0, {}
    repeats = min(max_repeats, target // tokens)
    rest = target - repeats * tokens
    if repeats == max_repeats or rest <= 0:
        return repeats, {}
    take = {s: n * rest // tokens for s, n in counts.items() if s > 0}
    rest -= sum(s * n for s, n in take.items())
    left = {s: counts[s] - n for s, n in take.items() if counts[s] > n}
    for s, n in fill(left, rest).items():
        take[s] += n
    return repeats, {s: n for s, n in take.items() if n}


class Mixture:
    """Mixtures of one documents table. targets: a small table, which is collected."""

    def __init__(self, documents: DataFrame, targets: DataFrame, seed: int = 42):
        self.spark, self.seed = documents.sparkSession, seed
        clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
        self.docs = scratch(token_counts(documents, "source").withColumn("source", clean(F.col("source"))), "sizes")
        rows = targets.select("mix_id", "source", "target_weight", "max_repeats", "size_ratio", clean(F.col("source")).alias("key")).collect()
        self.rows = [r for r in rows if r.target_weight and r.target_weight > 0]
        total = self.docs.agg(F.sum("n_tokens")).first()[0] or 0
        named = sorted({r.key for r in self.rows if r.key is not None})
        counts: dict[str, dict[int, int]] = defaultdict(dict)
        for r in self.docs.where(F.col("source").isin(named)).groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r.source][r.n_tokens] = r.n
        weights: dict[str, float] = defaultdict(float)
        for r in self.rows:
            weights[r.mix_id] += r.target_weight
        self.fits = []
        for i, r in enumerate(self.rows):
            target = r.target_weight / weights[r.mix_id] * (r.size_ratio or 0.0) * total
            own = counts.get(r.key, {})
            tokens = sum(s * n for s, n in own.items())
            repeats, once = fit(own, int(target), r.max_repeats or 0)
            reached = repeats * tokens + sum(s * n for s, n in once.items())
            self.fits.append((i, r, target, tokens, repeats, once, reached, r.target_weight / weights[r.mix_id]))

    def report(self) -> DataFrame:
        """Per mix and source: target and reached tokens and shares, and whether its cap keeps it below its target."""
        reached_all: dict[str, int] = defaultdict(int)
        for _, r, *_, reached, _ in self.fits:
            reached_all[r.mix_id] += reached
        rows = [
            (r.mix_id, r.source, float(target), int(tokens), int(reached), float(share), reached / reached_all[r.mix_id] if reached_all[r.mix_id] else 0.0, int(repeats) + bool(once), target > (r.max_repeats or 0) * tokens)
            for _, r, target, tokens, repeats, once, reached, share in self.fits
        ]
        schema = "mix_id string, source string, target_tokens double, source_tokens long, reached_tokens long, target_share double, reached_share double, most_repeats int, short boolean"
        return self.spark.createDataFrame(rows, schema)

    def selection(self) -> DataFrame:
        """(mix_id, source, doc_id, n_tokens, copies) of every document drawn, and how often."""
        by_source: dict[str, list] = defaultdict(list)
        for i, r, _, _, repeats, once, *_ in self.fits:
            if repeats or once:
                by_source[r.key].append((i, r.mix_id, r.source, repeats, once))
        used = self.docs.where(F.col("source").isin(sorted(by_source)))
        order = F.xxhash64("doc_id", F.lit(self.seed))
        rows = ranked(used.withColumn("h", order), ["source", "n_tokens"], "h").select("source", "doc_id", "n_tokens", "rank")

        def run(batches):
            for b in batches:
                source, ids, size, rank = (c.to_pylist() for c in b.columns)
                out = []
                for k, i, s, r in zip(source, ids, size, rank, strict=True):
                    for _, mix, name, repeats, once in by_source[k]:
                        copies = repeats + (r < once.get(s, 0))
                        if copies:
                            out.append((mix, name, i, s, copies))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["mix_id", "source", "doc_id", "n_tokens", "copies"])

        return rows.mapInArrow(run, "mix_id string, source string, doc_id long, n_tokens long, copies int")


