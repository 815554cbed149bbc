"""Near-duplicate pages by Golay-code fuzzy hashing.

Sketch: SLOTS minwise hashes of a page's SHINGLE-word sequences, 16 bits each. A fingerprint of 23-bit segments takes one
bit of 23 slots per segment. Each segment is decoded with the perfect binary Golay code [23, 12, 7]: the codewords
nearest to it and to its 23 one-bit neighbours give 1 or 6 indices, so two segments that differ in at most two bits always
share one, and those that differ in a few more often do. By the pigeonhole principle some of SEGMENTS segments of two
similar pages have few errors. A key is a segment's number, one whole slot and a codeword index; pages that share a key
and whose 64-bit check differs in at most CHECK_BITS places are candidates. Candidates are compared by the sketch, then
exactly by their sets of word sequences.

The whole slot in the key keeps buckets small whatever the size of the collection: an unrelated pair shares it with
probability of its Jaccard similarity. At similarity 0.6 one segment finds a pair with probability of about 0.17, the 24
together with about 0.99; from 0.7 on it is above 0.999. A key of more than HOT_KEY pages (a site whose pages share much
of their furniture) is split: its pages get RETRIES keys each instead, of the key and two more whole slots, one pair of
slots each; at similarity 0.6 all of them miss a pair with probability of 0.005. Pages of the same words are one class
from the start, of which only the smallest page_id is compared.

Classes of up to MAX_EXPANDED equal pages are written out pair by pair, larger ones as links from their smallest page_id;
classes() gives the membership of all of them, so every pair follows from the two.

Defined cases: null title is empty; pages with null text or fewer than min_words words in text take no part; a row
delivered twice counts once; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import maybe_broadcast, scratch, spread
from skein.llm.spans import WordHash, _mix

SHINGLE = 3
MIN_WORDS = 50
THRESHOLD = 0.6
SLOTS = 128
SEGMENTS = 24
CHECK_BITS = 23
#: Classes of equal pages of up to so many members are written out pair by pair; larger ones as links to their smallest page_id.
MAX_EXPANDED = 64
#: Pages of one key from which it is split, and the keys each of them gets instead.
HOT_KEY, RETRIES = 1000, 12

_GENERATOR = 0b110001110101
_WORDS = re.compile(r"[^\W_]+")


def _remainders(bits: int) -> np.ndarray:
    """Remainder of every word of so many bits, divided by the code's generator polynomial."""
    w = np.arange(1 << bits, dtype=np.int64)
    for i in range(bits - 1, 10, -1):
        w = np.where(w >> i & 1, w ^ (_GENERATOR << (i - 11)), w)
    return w


class Golay:
    """Decoder of 23-bit words to 12-bit codeword indices."""

    def __init__(self):
        self.low = _remainders(12)
        self.high = np.array([self._rest(h << 12) for h in range(1 << 11)], dtype=np.int64)
        self.error = np.zeros(1 << 11, dtype=np.int64)
        ones = [1 << i for i in range(23)]
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = ones[i] | ones[j] | ones[k]
                    self.error[self.low[e & 4095] ^ self.high[e >> 12]] = e
        self.flips = np.array([0, *ones], dtype=np.int64)

    @staticmethod
    def _rest(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= _GENERATOR << (i - 11)
        return w

    def decode(self, w: np.ndarray) -> np.ndarray:
        """Index of the one codeword within three bits of each word."""
        return (w ^ self.error[self.low[w & 4095] ^ self.high[w >> 12]]) >> 11

    def keys(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices (n, 24) of the codewords nearest to each word and to its one-bit neighbours, sorted, and which are new in their row."""
        k = np.sort(self.decode(w[:, None] ^ self.flips[None, :]), axis=1)
        new = np.ones(k.shape, dtype=bool)
        new[:, 1:] = k[:, 1:] != k[:, :-1]
        return k, new


def _layout(seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment: its whole slot, its 23 slots, and the bit of a slot it uses."""
    rng = np.random.default_rng(seed)
    whole = rng.permutation(SLOTS)[:SEGMENTS]
    slots = np.stack([rng.choice(np.setdiff1d(np.arange(SLOTS), [w]), 23, replace=False) for w in whole])
    return whole, slots, np.arange(SEGMENTS) % 15


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """32-bit hashes of the SHINGLE-word sequences, from the words' 64-bit hashes."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = _mix(h + words[i : i + n])
    return (h >> np.uint64(32)).astype(np.uint32)


def page_words(title: str | None, text: str) -> tuple[list[str], int]:
    """Words of title and text, and how many are the text's."""
    body = _WORDS.findall(text.lower())
    return (_WORDS.findall(title.lower()) + body if title else body), len(body)


def sketches(shingles: list[np.ndarray]) -> np.ndarray:
    """Minwise sketches (n, SLOTS) of non-empty sets, 16 bits a slot."""
    rng = np.random.default_rng(1)
    factor = rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    blind = rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32)
    starts = np.cumsum([0, *map(len, shingles[:-1])])
    flat = np.concatenate(shingles)
    out = np.empty((len(shingles), SLOTS), np.uint32)
    buf = np.empty_like(flat)
    for i in range(SLOTS):
        np.bitwise_xor(flat, blind[i], out=buf)
        np.multiply(buf, factor[i], out=buf)
        np.minimum.reduceat(buf, starts, out=out[:, i])
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _sketch_batches(min_words: int, most: int = 400_000):
    """Sketches of pages, worked out for about most word sequences at a time."""

    def flushed(ids, classes, sets):
        sig = [x.tobytes() for x in sketches(sets)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.binary()), pa.array(sig, pa.binary())], names=["page_id", "cls", "sig"])

    def run(batches):
        known = WordHash()
        for b in batches:
            held: tuple[list, list, list] = ([], [], [])
            size = 0
            for row in range(b.num_rows):
                i, title, text = (b.column(c)[row].as_py() for c in range(3))
                words, n = page_words(title, text)
                if n < min_words:
                    continue
                held[0].append(i)
                held[1].append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
                held[2].append(shingle_hashes(known.of(words)))
                size += len(words)
                if size >= most:
                    yield flushed(*held)
                    held, size = ([], [], []), 0
            if held[0]:
                yield flushed(*held)

    return run


def _key_batches(batches, piece: int = 2000):
    golay = Golay()
    whole, slots, bit = _layout()
    weight = (1 << np.arange(23)).astype(np.int64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for b in batches:
        for lo in range(0, b.num_rows, piece):
            part = b.slice(lo, piece)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SLOTS)
            check = ((sig[:, :64] >> np.uint16(15)).astype(np.uint64) * powers).sum(axis=1, dtype=np.uint64).view(np.int64)
            out_k, out_i = [], []
            for t in range(SEGMENTS):
                segment = ((sig[:, slots[t]] >> np.uint16(bit[t])) & np.uint16(1)).astype(np.int64) @ weight
                keys, new = golay.keys(segment)
                row, _ = np.nonzero(new)
                out_k.append(np.int64(t) << 28 | sig[row, whole[t]].astype(np.int64) << 12 | keys[new])
                out_i.append(row)
            row = np.concatenate(out_i)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(ids[row]), pa.array(check[row])], names=["key", "id", "bits"])


def _slot_rows(batches):
    """(t, slot) of each page and segment: how many pages a key can have at most."""
    whole, _, _ = _layout()
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint16).reshape(-1, SLOTS)[:, whole].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((sig + (np.arange(SEGMENTS) << 16)[None, :]).ravel())], names=["slot"])


def _split_batches(batches):
    """Of (key, id, bits, sig): RETRIES rows (key, id, bits) each, of the key and two more slots."""
    pairs = np.random.default_rng(9).permutation(SLOTS)[: 2 * RETRIES].reshape(-1, 2)
    for b in batches:
        key = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        sig = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(-1, SLOTS).astype(np.uint64)
        new = np.stack([_mix(_mix(key + np.uint64(r + 1)) + (sig[:, x] << np.uint64(16) | sig[:, y])) for r, (x, y) in enumerate(pairs)], axis=1) if len(key) else np.empty((0, RETRIES), np.uint64)
        # below zero, where no other key is
        new = (new | np.uint64(1 << 63)).view(np.int64).ravel()
        at = pa.array(np.repeat(np.arange(len(key)), RETRIES))
        yield pa.RecordBatch.from_arrays([pa.array(new), b.column(1).take(at), b.column(2).take(at)], names=["key", "id", "bits"])


def split_hot(rows: DataFrame, reps: DataFrame, most: int = HOT_KEY) -> DataFrame:
    """rows (key, id, bits) with the keys of more than most pages split by further slots of reps (rep, sig)."""
    slots = reps.select("sig").mapInArrow(_slot_rows, "slot long").groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("slot")
    slots = scratch(slots, "slots")
    if slots.isEmpty():
        return rows
    # key = t << 28 | slot << 12 | index
    counted = rows.withColumn("slot", F.shiftright("key", 12)).join(maybe_broadcast(slots), "slot", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = scratch(counted.where(F.col("n") > most).select("key"), "hot")
    if hot.isEmpty():
        return rows
    hot = maybe_broadcast(hot)
    dense = rows.join(hot, "key", "left_semi").join(reps.select(F.col("rep").alias("id"), "sig"), "id").select("key", "id", "bits", "sig")
    return rows.join(hot, "key", "left_anti").unionByName(dense.mapInArrow(_split_batches, "key long, id long, bits long"))


def _alike(least: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return run


def _sets(batches):
    known = WordHash()
    for b in batches:
        ids, sets = [], []
        for i, title, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            ids.append(i)
            sets.append(np.unique(shingle_hashes(known.of(page_words(title, text)[0]))).view(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int32()))], names=["page_id", "s"])


class NearDuplicates:
    """Links between pages of one table: classes of equal pages, and similar pairs of class representatives."""

    def __init__(self, pages: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS):
        pages = pages.where("text IS NOT NULL AND page_id IS NOT NULL").select("page_id", "title", "text")
        base = scratch(spread(pages).mapInArrow(_sketch_batches(min_words), "page_id long, cls binary, sig binary"), "sketch")
        reps = scratch(base.groupBy("cls").agg(F.min("page_id").alias("rep"), F.first("sig").alias("sig"), F.countDistinct("page_id").alias("members")), "reps")
        self.members = base.select("page_id", "cls").distinct().join(reps.where("members > 1").select("cls", "rep", "members"), "cls").select("rep", "page_id", "members")
        rows = spread(reps.select("rep", "sig")).mapInArrow(_key_batches, "key long, id long, bits long")
        rows = split_hot(rows, reps)
        x, y = rows.alias("x"), rows.alias("y")
        near = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= CHECK_BITS
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        sig = reps.select("rep", "sig")
        both = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
        least = int(threshold * SLOTS - 3.4 * (threshold * (1 - threshold) * SLOTS) ** 0.5)
        pairs = scratch(both.mapInArrow(_alike(least), "a long, b long"), "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("page_id")).distinct()
        sets = pages.join(ids, "page_id", "left_semi").mapInArrow(_sets, "page_id long, s array<int>").dropDuplicates(["page_id"])
        shared = F.size(F.array_intersect("s", "t"))
        jaccard = shared / (F.size("s") + F.size("t") - shared)
        self.links = scratch(
            pairs.join(sets.withColumnRenamed("page_id", "a"), "a").join(sets.select(F.col("page_id").alias("b"), F.col("s").alias("t")), "b")
            .select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-12),
            "links",
        )

    def pairs(self) -> DataFrame:
        """(page_id_a, page_id_b), the smaller first, of all similar pages.

        Classes of more than MAX_EXPANDED equal pages stand as links from their smallest page_id to each other member; a
        page similar to such a class is linked to its smallest page_id.
        """
        small = self.members.where(F.col("members") <= MAX_EXPANDED).select("rep", "page_id")
        one, two = small.alias("m"), small.alias("n")
        inside = one.join(two, F.col("m.rep") == F.col("n.rep")).where(F.col("m.page_id") < F.col("n.page_id")).select(F.col("m.page_id").alias("p"), F.col("n.page_id").alias("q"))
        star = self.members.where((F.col("members") > MAX_EXPANDED) & (F.col("page_id") != F.col("rep"))).select(F.col("rep").alias("p"), F.col("page_id").alias("q"))
        left = self.links.join(small.select(F.col("rep").alias("a"), F.col("page_id").alias("p")), "a", "left").withColumn("p", F.coalesce("p", "a"))
        across = left.join(small.select(F.col("rep").alias("b"), F.col("page_id").alias("q")), "b", "left").select("p", F.coalesce("q", "b").alias("q"))
        return across.unionByName(inside).unionByName(star).select(F.least("p", "q").alias("page_id_a"), F.greatest("p", "q").alias("page_id_b")).distinct()

    def classes(self) -> DataFrame:
        """(page_id, class_id): the members of each class of two or more equal pages, and the smallest of them."""
        return self.members.select("page_id", F.col("rep").alias("class_id"))

    def groups(self) -> DataFrame:
        """One row per page that has a near duplicate: page_id, group_id (the group's smallest page_id), n_links of its class."""
        from skein.llm.components import components

        edges = self.links.select("a", "b").unionByName(self.members.where("page_id <> rep").select(F.col("rep").alias("a"), F.col("page_id").alias("b")))
        degree = edges.select(F.explode(F.array("a", "b")).alias("page_id")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))
        return components(edges).join(degree, "page_id")
