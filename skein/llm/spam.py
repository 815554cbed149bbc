"""Keyword-stuffed and link-list pages.

A page's own text (the body that skein.llm.body finds) is cut into blocks: a line of LONG_LINE bytes or more is one, the
shorter lines of a page together are another. Names, addresses and words with digits, which never compress, are masked
first. Every block is compressed, in equal pieces of at most BLOCK_BYTES, and its ratio is divided by the one that
ordinary text of that length in the page's language reaches; that is exp(a + b ln bytes), fitted per language on the
blocks with sentences of all pages, as are the weights that find the body (skein.llm.fit). A block is redundant when the normalised ratio is at most MAX_RATIO times what
its density of sentences leaves: all of it without sentences, nothing at the density of ordinary text, in proportion
between. So what is a little more redundant than ordinary text must have no sentences, and text as full of sentences as
any is never found. A run of fewer than SENTENCE_WORDS words is no sentence, whatever sign ends it. A page is found when
more than half of the words of its body are in redundant blocks.

Defined cases: null or empty text is never found; pages of fewer than MIN_WORDS words are never found, the report has
their figures all the same; a line in capitals is read in small letters; a row delivered twice counts once.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, spread
from skein.llm.body import in_body, lines_of
from skein.llm.coded import LineScores, chunks
from skein.llm.fit import train_on
from skein.llm.langlabels import language_of

MAX_RATIO = 0.97
LONG_LINE = 100
BLOCK_BYTES = 1500
SENTENCE_WORDS = 7
MIN_WORDS = 20
#: A language has a fit of its own from this many pieces of text on.
MIN_POINTS = 50

_END = re.compile(r"[.!?…。]+[\"”»)]*(?=\s|$)")
_STOPS = frozenset(".!?…。")


class Masked(dict):
    """Words as they are compressed, remembered up to a bound: "0" for addresses and those with digits or capitals."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        opaque = "://" in word or any(c.isdigit() or c.isupper() for c in word)
        out = self[word] = "0" if opaque else word
        return out


def sentences(line: str) -> int:
    """How many runs of SENTENCE_WORDS words or more end in a full stop or the like."""
    if _STOPS.isdisjoint(line):
        return 0
    found = at = 0
    for m in _END.finditer(line):
        found += line.count(" ", at, m.start()) + (at == 0) >= SENTENCE_WORDS
        at = m.end()
    return found


def blocks(lines: list[str], known: Masked) -> list[tuple[bytes, int, int]]:
    """(masked text, words, sentences) of each block of a page."""
    out, short, words, ends = [], [], 0, 0
    for line in lines:
        n, e = line.count(" ") + 1, sentences(line)
        data = " ".join(map(known.__getitem__, (line.lower() if line.isupper() else line).split(" "))).encode("utf-8", "surrogatepass")
        if len(data) >= LONG_LINE:
            out.append((data, n, e))
        else:
            short.append(data)
            words += n
            ends += e
    if short:
        out.append((b"\n".join(short), words, ends))
    return out


def pieces(data: bytes) -> list[bytes]:
    """Equal pieces of at most BLOCK_BYTES."""
    n = -(-len(data) // BLOCK_BYTES)
    return [data[i * len(data) // n : (i + 1) * len(data) // n] for i in range(n)]


def packed(data: bytes) -> int:
    """Compressed size, without a frame; a small window is enough for a piece."""
    c = zlib.compressobj(6, zlib.DEFLATED, -12, 5)
    return len(c.compress(data)) + len(c.flush())


class Block(NamedTuple):
    """Words, sentences and bytes of a block, and the compressed sizes of its pieces."""

    words: int
    ends: int
    size: int
    packed: list[int]

    def points(self) -> list[tuple[int, int]]:
        """Bytes of each piece, before and after compression."""
        n = len(self.packed)
        return [((i + 1) * self.size // n - i * self.size // n, p) for i, p in enumerate(self.packed)]


def measured(lines: list[str], known: Masked) -> list[Block]:
    return [Block(n, e, len(data), list(map(packed, pieces(data)))) for data, n, e in blocks(lines, known)]


def sums(page: list[Block]) -> tuple[int, int, int, float, float, float, float]:
    """Of a page's blocks with sentences: words, sentences, pieces, and sums for the line through the logarithms of bytes and ratio."""
    mine = [b for b in page if b.ends and b.size >= 60]
    xy = [(math.log(n), math.log(p / n)) for b in mine for n, p in b.points()]
    return (
        sum(b.words for b in mine), sum(b.ends for b in mine), len(xy),
        math.fsum(x for x, _ in xy), math.fsum(y for _, y in xy), math.fsum(x * x for x, _ in xy), math.fsum(x * y for x, y in xy),
    )


class Ordinary:
    """What ordinary text is like: a, b of the ratio exp(a + b ln bytes) by language ("" for all), and sentences per word."""

    def __init__(self, rows: list[tuple]):
        """rows: (language, then as of sums, added up over its pages), None for pages without one."""
        rows = sorted(rows, key=lambda r: r[0] or "")
        everything = [sum(x) for x in list(zip(*rows, strict=True))[1:]] or [0] * 7
        self.density = everything[1] / everything[0] if everything[1] else 0.05
        self.fits = {"": (1.1, -0.28)}
        for lang, *row in [("", *everything), *(r for r in rows if r[0])]:
            _, _, n, x, y, xx, xy = row
            if n >= MIN_POINTS:
                spread_x = xx - x * x / n
                b = (xy - x * y / n) / spread_x if spread_x > 1e-9 * xx else self.fits[""][1]
                self.fits[lang] = ((y - b * x) / n, b)

    def normalised(self, block: Block, lang: str | None) -> float:
        """The mean, by bytes, of the ratios of a block's pieces as shares of ordinary ones."""
        a, b = self.fits.get(lang or "", self.fits[""])
        return sum(p / math.exp(a + b * math.log(n)) for n, p in block.points()) / block.size


def redundant(page: list[Block], lang: str | None, ordinary: Ordinary) -> tuple[int, int, float]:
    """Words in redundant blocks, words in all, and the least normalised ratio of a block (1.0 where there is none)."""
    found, total, least = 0, 0, 1.0
    for block in page:
        total += block.words
        r = ordinary.normalised(block, lang)
        least = min(least, r)
        if r <= MAX_RATIO * (1 - block.ends / block.words / ordinary.density):
            found += block.words
    return found, total, least


def redundant_words(lines: list[str], lang: str | None, ordinary: Ordinary, known: Masked) -> tuple[int, int, float]:
    return redundant(measured(lines, known), lang, ordinary)


_SUMS = ("words", "ends", "n", "x", "y", "xx", "xy")
_PAGE = pa.schema([("page_id", pa.int64()), ("lang", pa.string()), ("blocks", pa.list_(pa.list_(pa.int32()))), *((c, pa.int64()) for c in _SUMS[:3]), *((c, pa.float64()) for c in _SUMS[3:])])


def redundancy(pages: DataFrame) -> DataFrame:
    """One row per page_id with text: body_words, redundant_words, least_ratio, found."""
    pages = pages.where("text IS NOT NULL AND page_id IS NOT NULL").select("page_id", "title", "text", "lang")
    weights = train_on(pages)

    def measure(batches):
        scores, known = LineScores(weights), Masked()
        for b in batches:
            rows = []
            ids, titles, texts, langs = (c.to_pylist() for c in b.columns)
            split = (lines_of(title, text) for title, text in zip(titles, texts, strict=True))
            bodies = ((p[1], of) for pages in chunks((h, lines, raws) for h, _, lines, raws in split) for p, of in zip(pages, scores.of(pages), strict=True))
            for i, lang, (lines, of) in zip(ids, langs, bodies, strict=True):
                page = measured([x for x, k in zip(lines, in_body(of), strict=True) if k], known)
                rows.append((i, language_of(lang), [[*x[:3], *x.packed] for x in page], *sums(page)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_PAGE)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _PAGE.types, strict=True)], schema=_PAGE)

    kinds = "page_id long, lang string, blocks array<array<int>>, words long, ends long, n long, x double, y double, xx double, xy double"
    figures = scratch(spread(pages).mapInArrow(measure, kinds).dropDuplicates(["page_id"]), "spam")
    ordinary = Ordinary([tuple(r) for r in figures.groupBy("lang").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()])

    def run(batches):
        for b in batches:
            rows = []
            for i, lang, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found, total, least = redundant([Block(*x[:3], x[3:]) for x in page], lang, ordinary)
                rows.append((i, total, found, least, total >= MIN_WORDS and 2 * found > total))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "body_words", "redundant_words", "least_ratio", "found"])

    return figures.select("page_id", "lang", "blocks").mapInArrow(run, "page_id long, body_words int, redundant_words int, least_ratio double, found boolean")
