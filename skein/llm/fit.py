"""Weights of words and tags, as body.train fits them, from all pages of a table instead of a list in memory.

Two passes over the pages: on how many pages each word stands; keys and features of the lines, coded in blocks. Then over
the blocks: on how many pages and lines each key stands; labels, and how often each feature stands on labelled lines; the
labelled lines by the features kept. Counts are exact and summed by Spark. What must be sent to all executors is what
stands on a share of the pages (least_pages, least_lines), so its size depends on the length of pages, not on their number.
Every step of the descent takes the gradient over all blocks, in parts that are summed on the driver in the order of the
parts.

Lines are worked out many at once (skein.llm.coded). In a block, the tags of a shape, those it shows to the next line and
the other tags of a line are parts that are kept once and shared by all lines that have them; only words are kept line by
line. A step so sums each part once, which gives the same gradient from a fraction of the features.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, shared_folder, spread
from skein.llm.body import descend, least_lines, least_pages, lines_of, often_words
from skein.llm.coded import Chunk, Lines, Page, chunks, distinct, sums

#: Bytes of a row group of blocks: what a task holds at once.
ROW_GROUP = 16 << 20
#: Sums of weights are added as whole numbers of this part of 1, so that their order doesn't matter.
WEIGHT = 1 << 24


def _pages(batches) -> Iterator[Page]:
    """The pages of more than two lines: heading, lines, raw lines."""
    for b in batches:
        for t, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            heading, _, lines, raws = lines_of(t, x)
            if len(lines) > 2:
                yield heading, lines, raws


def _chunks(batches, rare=None) -> Iterator[Chunk]:
    known = Lines(rare)
    for pages in chunks(_pages(batches)):
        if known.full():
            known = Lines(rare)
        yield Chunk(pages, known)


def _words(batches):
    for c in _chunks(batches):
        at = distinct(np.repeat(c.page << 32, c.sizes) | c.tokens)
        words, sizes = c.known.words[at & 0xFFFFFFFF]
        n = np.bincount(distinct(np.repeat(at >> 32, sizes) << 32 | words) & 0xFFFFFFFF)
        used = np.flatnonzero(n)
        names = [c.known.features.names[i] for i in used.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([*names, ""], pa.string()), pa.array([*n[used].tolist(), len(c.of_page)], pa.int64())], names=["word", "n"])


class Block(NamedTuple):
    """Lines as numbers of their parts (tags of the shape, what the line before shows of its own, other tags) and of their words."""

    parts: np.ndarray
    part_sizes: np.ndarray
    at: np.ndarray
    words: np.ndarray
    word_sizes: np.ndarray

    def features(self, dims: int, lines: np.ndarray) -> np.ndarray:
        """How often each feature stands on some of the lines."""
        often = np.bincount(self.at[:, lines].ravel(), minlength=len(self.part_sizes))
        return np.bincount(self.words[np.repeat(lines, self.word_sizes)], minlength=dims) + np.bincount(self.parts, np.repeat(often, self.part_sizes), dims).astype(np.int64)

    def kept(self, number: np.ndarray, rare: int, lines: np.ndarray) -> Block:
        """Some of the lines, with the features that have a number (others: -1); rare stands for all others of a line, among its words."""
        parts, words, sizes, at = number[self.parts], number[self.words[np.repeat(lines, self.word_sizes)]], self.word_sizes[lines], self.at[:, lines]
        part_sizes, mine = (sums((x >= 0).astype(np.int32), n) for x, n in ((parts, self.part_sizes), (words, sizes)))
        others = (mine < sizes) | (part_sizes < self.part_sizes)[at].any(0)
        return Block(parts[parts >= 0], part_sizes, at, np.insert(words[words >= 0], np.cumsum(mine)[others], rare), mine + others)

    def gradient(self, w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """body.gradient of the lines."""
        of_part = sums(w[self.parts], self.part_sizes)
        p = 1 / (1 + np.exp(-np.clip(sums(w[self.words], self.word_sizes) + of_part[self.at].sum(0), -30, 30)))
        r = (p - y) * weight
        back = np.bincount(self.at.ravel(), np.tile(r, len(self.at)), len(of_part))
        return np.bincount(self.words, np.repeat(r, self.word_sizes), len(w)) + np.bincount(self.parts, np.repeat(back, self.part_sizes), len(w))


def block_of(c: Chunk) -> tuple[Block, list[str]]:
    """The lines of a chunk, and the names of the features they have."""
    known = c.known
    line, token = c.once()
    seen = c.sizes <= 4
    seen[:-1] &= ~c.first[1:]
    seen[-1] = False
    shown = seen[line]
    (own, own_sizes), (also, also_sizes) = known.words[token], known.words_before[token[shown]]
    of = np.concatenate((np.repeat(line, own_sizes), np.repeat(line[shown] + 1, also_sizes)))
    words, word_sizes = np.concatenate((own, also))[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(c.lines))
    last = np.where(c.first, -1, np.concatenate((c.shape[:1], c.shape[:-1])))
    (shapes, at_shape), (lasts, at_last), (tags, at_tag) = (np.unique(x, return_inverse=True) for x in (c.shape, last, c.tag))
    of_parts = known.shape_own[shapes], (np.zeros(0, np.int64), np.zeros(1, np.int64)), known.shape_seen[lasts[1:]], known.tags[tags]
    parts, part_sizes = (np.concatenate([x[i] for x in of_parts]) for i in (0, 1))
    at = np.stack((at_shape, at_last + len(shapes), at_tag + len(shapes) + len(lasts)))
    used = np.flatnonzero(np.bincount(words, minlength=len(known.features)) + np.bincount(parts, minlength=len(known.features)))
    number = np.empty(len(known.features), np.int64)
    number[used] = np.arange(len(used))
    return Block(number[parts], part_sizes, at, number[words], word_sizes), [known.features.names[i] for i in used.tolist()]


def train_on(pages: DataFrame) -> dict[str, float]:
    """body.train of all pages with text. pages: title, text."""
    pages = spread(pages.where("text IS NOT NULL").select("title", "text"))
    words = scratch(pages.mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n = (words.where("word = ''").first() or (None, 0))[1]
    if not n:
        return {}
    few = least_pages(n)
    often = Counter(dict(map(tuple, words.where((F.col("n") >= min(few, max(1, n // 100))) & (F.col("word") != "")).collect())))

    def coded(batches):
        for c in _chunks(batches, often_words(often, n)):
            c.titles()
            c.shapes()
            c.tags()
            facts = c.facts()
            key, which, seen = np.unique(facts.keys.ravel(), return_inverse=True, return_counts=True)
            on = np.bincount(distinct(np.tile(c.page << 32, len(facts.keys)) | which) & 0xFFFFFFFF, minlength=len(key))
            block, names = block_of(c)
            lines = pickle.dumps((facts._replace(keys=which.reshape(facts.keys.shape).astype(np.int32)), Block(*(x.astype(np.int32) for x in block)), c.alike.astype(np.int32)), 5)
            values = (key, seen, on), (names,), (lines,)
            kinds = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([v for x in values for v in x], kinds, strict=True)], names=["key", "seen", "on", "features", "lines"])

    path = shared_folder(pages.sparkSession, "lines")
    schema = "key array<long>, seen array<long>, on array<long>, features array<string>, lines binary"
    pages.mapInArrow(coded, schema).write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 4).parquet(path)
    blocks = pages.sparkSession.read.schema(schema).parquet(path)
    added = blocks.select(F.explode(F.arrays_zip("key", "seen", "on")).alias("x")).groupBy("x.key").agg(F.sum("x.seen").alias("seen"), F.sum("x.on").alias("on"))
    repeated = added.where((F.col("on") >= few) & (F.col("seen") <= 1.25 * F.col("on"))).select("key", "on").collect()
    key, on = (np.array([r[i] for r in sorted(repeated)], np.int64) for i in (0, 1))

    def labelled(batches):
        """Of each block: its lines, which have a label, labels, weights and names of features."""
        for b in batches:
            for i in range(b.num_rows):
                facts, block, alike = pickle.loads(b.column("lines")[i].as_buffer())
                mine = b.column("key")[i].values.to_numpy()
                pages = np.zeros(len(mine), np.int64)
                at = np.searchsorted(mine, key)
                at[at == len(mine)] = 0
                hit = mine[at] == key
                pages[at[hit]] = on[hit]
                y = facts.labels(pages.__getitem__, n)
                lines = y >= 0
                yield block, lines, y[lines].astype(np.int8), alike[lines] ** -0.5, b.column("features")[i].as_py()

    def counted(batches):
        for block, lines, y, weight, names in labelled(batches):
            count = block.features(len(names), lines)
            used = np.flatnonzero(count)
            totals = (round(math.fsum(x) * WEIGHT) for x in (weight, weight * y))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in used.tolist()] + ["total", "body"], pa.string()), pa.array([*count[used].tolist(), *totals], pa.int64()), pa.array([True] * len(used) + [False] * 2)], names=["name", "n", "feature"])

    count = blocks.mapInArrow(counted, "name string, n long, feature boolean").groupBy("name", "feature").agg(F.sum("n").alias("n"))
    tag = F.substring("name", 1, 1).isin("§", "<")
    rows = count.where(~F.col("feature") | (F.col("n") >= F.when(tag, least_lines("§", n)).otherwise(least_lines("w", n)))).collect()
    totals = {r["name"]: r["n"] / WEIGHT for r in rows if not r["feature"]}
    total, body = totals.get("total", 0.0), totals.get("body", 0.0)
    if not 0 < body < total:
        return {}
    ids = {f: i for i, f in enumerate(sorted(r["name"] for r in rows if r["feature"]))}
    dims = len(ids) + 1

    def kept(batches):
        for block, lines, y, weight, names in labelled(batches):
            block = block.kept(np.array([ids.get(f, -1) for f in names], np.int64), dims - 1, lines)
            small = Block(*(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in block))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((small, y, weight), 5)], pa.binary())], names=["block"])

    # every step reads this: kept as bytes by the executors, and worked out again from the blocks where one is lost
    lines = blocks.select("key", "features", "lines").mapInArrow(kept, "block binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.DISK_ONLY)

    def whole(w: np.ndarray) -> np.ndarray:
        def part(blocks):
            g = np.zeros(dims)
            for x in blocks:
                block, y, weight = pickle.loads(x)
                g += block.gradient(w, y, weight)
            yield g.tobytes()

        return sum(map(np.frombuffer, lines.mapPartitions(part).collect()), np.zeros(dims)) / total

    try:
        w = descend(whole, dims)
    finally:
        lines.unpersist()
    return {**{f: float(w[i]) for f, i in ids.items()}, "§rare": float(w[-1])}
