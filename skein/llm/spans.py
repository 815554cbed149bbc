"""Long exact spans shared between records, by level-wise doubling of window length.

Level 15: of each document's 15-word windows only the leftmost minimum of every 16 consecutive ones is kept, so two
equal 30-word runs always keep the same window; those found in one text alone are dropped, the rest are extended. Level
30 takes the 30-word windows that cover a surviving one, and keeps those found in two different texts. Each further
level joins two adjacent windows of the level before, until none survives. Whole-text copies are one class from the
start: a class of two or more is shared from end to end and only its smallest doc_id takes part in the search.

A window is known by a 128-bit hash from level 30 on. Repetition is decided by min <> max of the text class, which
combines map-side, so a passage in a third of all records is no hot group; the joins back are left to AQE's skew split.

Defined cases: null doc_id or text takes no part; fewer than 30 words have no spans; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, spread

SPAN = 30
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = _ONE
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = _B1) -> np.ndarray:
    """A 64-bit hash of each run of width words, from the words' hashes; depends on the run's words alone."""
    n = len(words)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, n), dtype=np.uint64)])
    return _mix((sums[width:] - sums[:-width]) * _powers(_inverse(base), n - width + 1))


class WordHash(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def leftmost_minima(h: np.ndarray, run: int) -> np.ndarray:
    """Positions of the leftmost minimum of every run consecutive values (winnowing)."""
    if len(h) < run:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, run)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _anchors(half: int, span: int):
    def run(batches):
        known = WordHash()
        for b in batches:
            ids, whole, sizes, at, key = [], [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()
                wh = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                h = window_hashes(known.of(words), half)
                p = leftmost_minima(h, span - half + 1)
                ids.append(i)
                whole.append(wh)
                sizes.append(len(words))
                at.append(p.astype(np.int32))
                key.append(h[p].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole, pa.binary()), pa.array(sizes, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(key, pa.list_(pa.int64()))], names=["doc_id", "whole", "n_words", "at", "h"])

    return run


def _around(half: int, span: int):
    def run(batches):
        known = WordHash()
        for b in batches:
            ids, pos, h1, h2 = [], [], [], []
            for i, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = known.of(text.split())
                a, c = window_hashes(words, span, _B1), window_hashes(words, span, _B2)
                p = (np.asarray(at.values)[:, None].astype(np.int64) - np.arange(span - half + 1)[None, :]).ravel()
                p = np.unique(p[(p >= 0) & (p < len(a))])
                ids.append(np.full(len(p), i, np.int64))
                pos.append(p.astype(np.int32))
                h1.append(a[p].view(np.int64))
                h2.append(c[p].view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, pos, h1, h2)], names=["doc_id", "pos", "h1", "h2"])

    return run


def _repeated(level: DataFrame) -> DataFrame:
    """The windows found in two or more text classes."""
    twice = level.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h1", "h2")
    return level.join(twice, ["h1", "h2"], "left_semi")


class SharedSpans:
    """The search over one documents table; text classes and each level are kept as scratch tables."""

    def __init__(self, documents: DataFrame, span: int = SPAN):
        half = span // 2
        docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
        self.span = span
        self.base = scratch(
            spread(docs).mapInArrow(_anchors(half, span), "doc_id long, whole binary, n_words int, at array<int>, h array<long>"), "anchors"
        )
        classes = self.base.groupBy("whole").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("copies"))
        self.classes = scratch(classes, "classes")
        one = self.base.join(self.classes.select("whole", "doc_id"), ["whole", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
        flat = one.select("doc_id", F.explode(F.arrays_zip("at", "h")).alias("x")).select("doc_id", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
        twice = flat.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
        kept = scratch(flat.join(twice, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("at")), "kept")
        texts = docs.join(kept, "doc_id").select("doc_id", "text", "at")
        self.level = scratch(_repeated(texts.mapInArrow(_around(half, span), "doc_id long, pos int, h1 long, h2 long").distinct()), "level")

    def spans(self) -> DataFrame:
        """doc_id, first_word, last_word of each maximal stretch covered by shared runs of span words."""
        order = Window.partitionBy("doc_id").orderBy("pos")
        runs = (
            self.level.select("doc_id", "pos")
            .withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(1 << 30)) > self.span).cast("int"))
            .withColumn("run", F.sum("new").over(order))
            .groupBy("doc_id", "run")
            .agg(F.min("pos").cast("int").alias("first_word"), (F.max("pos") + self.span - 1).cast("int").alias("last_word"))
            .drop("run")
        )
        copied = self.classes.where("copies > 1")
        whole = self.base.where(F.col("n_words") >= self.span).join(copied.select("whole"), "whole", "left_semi").select("doc_id", F.lit(0).alias("first_word"), (F.col("n_words") - 1).alias("last_word")).distinct()
        return runs.join(copied.select("doc_id"), "doc_id", "left_anti").select("doc_id", "first_word", "last_word").unionByName(whole)

    def longest(self, max_levels: int = 24) -> DataFrame:
        """doc_id, window_words: the longest level (span, 2 span, 4 span, ...) at which a window of the document is shared.

        The loop ends when no window survives; max_levels only bounds it at documents of span * 2^24 words. It runs over one
        text of each class; a text with copies is shared as a whole, so all its copies have the largest level it can hold.
        """
        level, width, found = self.level, self.span, []
        for _ in range(max_levels):
            found.append(level.select("doc_id", F.lit(width).alias("window_words")).distinct())
            right = level.select("doc_id", (F.col("pos") - width).alias("pos"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            level = level.join(right, ["doc_id", "pos"]).select("doc_id", "pos", F.xxhash64("h1", "r1", "h2").alias("h1"), F.xxhash64("r2", "h2", "r1").alias("h2"))
            level = scratch(_repeated(level), "level")
            width *= 2
            if level.isEmpty():
                break
        doublings = f"shiftleft(1, least(length(bin(n_words div {self.span})), {max_levels}) - 1)"
        copied = self.base.where(F.col("n_words") >= self.span).join(self.classes.where("copies > 1").select("whole"), "whole", "left_semi")
        out = copied.select("doc_id", F.expr(f"{self.span} * {doublings}").alias("window_words"))
        for x in found:
            out = out.unionByName(x)
        return out.groupBy("doc_id").agg(F.max("window_words").alias("window_words"))

    def report(self) -> DataFrame:
        """One row per document: its words, how many lie in spans shared with other documents, and that share."""
        covered = self.spans().groupBy("doc_id").agg(F.sum(F.col("last_word") - F.col("first_word") + 1).alias("shared_words"), F.count(F.lit(1)).alias("n_spans"))
        sizes = self.base.groupBy("doc_id").agg(F.max("n_words").cast("long").alias("n_words"))
        return sizes.join(covered, "doc_id", "left").select(
            "doc_id", "n_words", F.coalesce("shared_words", F.lit(0)).alias("shared_words"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
            F.when(F.col("n_words") > 0, F.coalesce("shared_words", F.lit(0)) / F.col("n_words")).otherwise(0.0).alias("shared_share"),
        )
