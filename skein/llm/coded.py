"""What skein.llm.body works out line by line, for all lines of many pages at once.

Tokens, shapes and features are numbered as they come; what depends on one of them alone is worked out once for each and
kept in columns; the rest is arithmetic on arrays. Numbers hold within one Lines, which starts anew between chunks of
pages once it knows MOST_TOKENS tokens. Keys of lines are 64-bit hashes that are the same in every process.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skein.llm import body

#: Characters of the pages taken at once (one page at least), tokens remembered, and shapes with their tags.
CHUNK = 1 << 21
MOST_TOKENS = 300_000
MOST_SHAPES = 10_000

Page = tuple[str, list[str], list[str]]


def digest(key: str) -> int:
    return int.from_bytes(blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64 of whole numbers, as signed ones."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of as many values as each size says, one after another; sizes may be 0."""
    out = np.zeros(len(sizes), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes, dtype=np.int64) - sizes)[some])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Numbered(dict):
    """Numbers of keys in the order they come."""

    def __init__(self):
        super().__init__()
        self.names: list = []

    def __missing__(self, key):
        n = self[key] = len(self.names)
        self.names.append(key)
        return n


def _room(values: np.ndarray, n: int) -> np.ndarray:
    return values if n <= len(values) else np.concatenate([values, np.empty(2 * n - len(values), values.dtype)])


class Column:
    """A number for every name of a growing list, worked out once for each."""

    def __init__(self, names: list, function: Callable, dtype=np.int64):
        self.names, self.function, self.n = names, function, 0
        self.values = np.empty(1024, dtype)

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.names)
        if n > self.n:
            self.values = _room(self.values, n)
            self.values[self.n : n] = np.fromiter(map(self.function, self.names[self.n :]), self.values.dtype, n - self.n)
            self.n = n
        return self.values[ids]


class Lists:
    """A list of whole numbers for every name of a growing list."""

    def __init__(self, names: list, function: Callable):
        self.names, self.function, self.n, self.end = names, function, 0, 0
        self.starts, self.sizes, self.items = (np.empty(1024, np.int64) for _ in range(3))

    def __getitem__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists one after another, and how long each is."""
        n = len(self.names)
        if n > self.n:
            new = list(map(self.function, self.names[self.n :]))
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            end = self.end + int(sizes.sum())
            self.starts, self.sizes, self.items = _room(self.starts, n), _room(self.sizes, n), _room(self.items, end)
            self.starts[self.n : n], self.sizes[self.n : n] = self.end + np.cumsum(sizes) - sizes, sizes
            self.items[self.end : end] = np.fromiter((i for x in new for i in x), np.int64, end - self.end)
            self.n, self.end = n, end
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.items[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


def chunks(pages: Iterable[Page]) -> Iterator[list[Page]]:
    out, size = [], 0
    for p in pages:
        out.append(p)
        size += sum(map(len, p[1]))
        if size >= CHUNK:
            yield out
            out, size = [], 0
    if out:
        yield out


def _pairs(tags: list[str]) -> list[str]:
    return ["<" + t for t in tags]


class Facts(NamedTuple):
    """Of the lines of some pages: their keys (4 by n), lines of each page, and whether a line is a sentence, its page's title,
    furniture if its key with names, its key with rare words, its shape is repeated, and in parts."""

    keys: np.ndarray
    of_page: np.ndarray
    flags: np.ndarray

    def labels(self, on: Callable[[np.ndarray], np.ndarray], pages: int) -> np.ndarray:
        """body.labels_of all lines. on: on how many of so many pages keys stand, 0 if not once a page."""
        names, common, exact, shape = map(on, self.keys)
        sentence, heading, by_names, by_common, by_shape, parted = self.flags
        few = body.least_pages(pages)
        least = np.where(sentence, max(few, body.SENTENCE_SHARE * pages), few)
        furniture = (exact >= few) | by_names & (names >= least) | by_common & (common >= least) | by_shape & (shape >= few)
        out = np.where(furniture, 0, np.where(sentence & ~parted & (names < few) & (common < few), 1, -1))
        out[heading] = 1
        told, flat, at = sums(((out == 1) & ~heading).astype(np.int64), self.of_page).tolist(), out.tolist(), 0
        filled = []
        for size, sentences in zip(self.of_page.tolist(), told, strict=True):
            filled += body._filled(flat[at : at + size], sentences)
            at += size
        return np.array(filled, np.int64)


class Chunk:
    """The lines of some pages: tokens, shapes and what body.Patterns and body.Features need of them."""

    def __init__(self, pages: list[Page], known: Lines):
        self.known = known
        self.lines = [x for _, lines, _ in pages for x in lines]
        self.raws = [x for *_, raws in pages for x in raws]
        self.of_page = np.fromiter((len(lines) for _, lines, _ in pages), np.int64, len(pages))
        self.page = np.repeat(np.arange(len(pages)), self.of_page)
        self.first = np.zeros(len(self.lines), bool)
        self.first[(np.cumsum(self.of_page) - self.of_page)[self.of_page > 0]] = True
        self.headings = [h for h, *_ in pages]
        self.tokens, self.sizes = known.code(self.lines)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def any(self, column: Column) -> np.ndarray:
        """Whether a token of the line has it."""
        return np.logical_or.reduceat(column[self.tokens], self.starts) if len(self.lines) else np.zeros(0, bool)

    def once(self) -> tuple[np.ndarray, np.ndarray]:
        """Line and token of each different token of a line."""
        x = distinct(np.repeat(np.arange(len(self.lines)) << 32, self.sizes) | self.tokens)
        return x >> 32, x & 0xFFFFFFFF

    def titles(self) -> None:
        """self.title: 1 where body has the tag §title, 2 where it has §endtitle; self.heading: lines that are the title; self.ends: those that end with it."""
        n = len(self.lines)
        self.title, self.heading, self.ends = np.zeros(n, np.int64), np.zeros(n, bool), []
        at = 0
        for heading, size in zip(self.headings, self.of_page.tolist(), strict=True):
            if heading:
                for i in range(at, at + size):
                    line = self.lines[i]
                    low = line.lower()
                    if low.endswith(heading):
                        self.heading[i] = low == heading
                        if len(line) >= len(heading):
                            self.title[i] = 1 if low == heading else 2
                        if len(line) > len(heading):
                            self.ends.append((i, line[: len(line) - len(heading)] + "T"))
            at += size

    def shapes(self) -> None:
        """self.shape: the number of each line's shape; self.alike: how many lines of its page share it."""
        known = self.known
        kinds = known.kind[self.tokens]
        new = np.ones(len(kinds), bool)
        new[1:] = kinds[1:] != kinds[:-1]
        new[self.starts] = True
        kinds, sizes = kinds[new], sums(new.astype(np.int64), self.sizes)
        seen, where, which = np.unique(known.sequence(mixed(kinds), sizes), return_index=True, return_inverse=True)
        numbers, ends = np.empty(len(seen), np.int64), np.cumsum(sizes)
        for j, (h, i) in enumerate(zip(seen.tolist(), where.tolist(), strict=True)):
            if h not in known.shape_numbers:
                known.shape_numbers[h] = len(known.shapes)
                known.shapes.append(tuple([known.kinds.names[k] for k in kinds[ends[i] - sizes[i] : ends[i]].tolist()]))
            numbers[j] = known.shape_numbers[h]
        self.shape = numbers[which]
        _, which, count = np.unique(self.page << 32 | self.shape, return_inverse=True, return_counts=True)
        self.alike = count[which]

    def keys(self) -> np.ndarray:
        """Four keys of each line, as of body.Patterns; self.kept and self.masked say what body.labels_of reads from their text."""
        known, n = self.known, len(self.lines)
        out, self.kept = np.empty((4, n), np.int64), np.empty((2, n), np.int64)
        out[0], self.kept[0] = known.names_of(self.tokens, self.sizes)
        out[1], self.kept[1], self.masked = known.common_of(self.tokens, self.sizes)
        out[2] = known.sequence(known.exact[self.tokens], self.sizes)
        out[3] = known.shape_key[self.shape]
        other = dict(self.ends)
        if other:
            at = list(other)
            out[0, at], self.kept[0, at] = known.names_of(*known.code(list(other.values())))
        for i, x in enumerate(self.lines):
            x = other.get(i, x)
            if x.isupper() and x != "T":
                other[i] = x.lower()
        if other:
            at = list(other)
            out[1, at], self.kept[1, at], self.masked[at] = known.common_of(*known.code(list(other.values())))
        for i, kind in enumerate(("", "~", "=", "#")):
            out[i] = mixed(out[i] ^ np.int64(digest("key" + kind)))
        return out

    def facts(self) -> Facts:
        """What the labels of the lines depend on, but for how often keys stand in other pages."""
        keys, n = self.keys(), len(self.lines)
        sentence = np.fromiter((k >= 9 and bool(body._SENTENCE_END.search(x[-200:])) for x, k in zip(self.lines, self.sizes.tolist(), strict=True)), bool, n)
        dated = self.any(self.known.date) & (np.fromiter(map(len, self.lines), np.int64, n) < 200)
        marked = sentence | dated | self.known.marks[self.shape]
        enough = np.where(sentence, 2 * self.masked, np.where(dated, 1, 2))
        parted = sentence.copy()
        for i in np.flatnonzero(sentence).tolist():
            parted[i] = bool(body._SEPARATOR.search(self.raws[i]))
        flags = (sentence, self.heading, (marked | ~self.any(self.known.digit)) & (self.kept[0] >= 2), marked & (self.kept[1] >= enough), self.known.counters[self.shape] & ~sentence, parted)
        return Facts(keys, self.of_page, np.array(flags))

    def tags(self) -> None:
        """self.tag: the number of the tags of each line that neither its shape nor its words show; those of the line before are among them."""
        n = self.sizes
        own = _by_value(n, lambda k: int(body.line_tags("", "", k)[0][0][2:])) | self.any(self.known.copy) << 6 | (self.any(self.known.date) & (n < 15)) << 7 | self.title << 8
        wide = np.fromiter(("  " in x for x in self.raws), bool, len(self.raws))
        before = np.concatenate((own[:1], own[:-1]))
        before[self.first] = 1 << 10
        all_tags = own | wide.astype(np.int64) << 11 | _by_value(self.alike, lambda k: int(math.log2(k))) << 12 | before << 20
        seen, which = np.unique(all_tags, return_inverse=True)
        self.tag = np.fromiter(map(self.known.tag_numbers.__getitem__, seen.tolist()), np.int64, len(seen))[which]


def _by_value(x: np.ndarray, function: Callable[[int], int]) -> np.ndarray:
    seen, which = np.unique(x, return_inverse=True)
    return np.fromiter(map(function, seen.tolist()), np.int64, len(seen))[which]


def seen_tags(own: int) -> tuple[list[str], str | None]:
    """Tags of a line that the next one sees, from their number: length, copyright sign, date, title."""
    return [f"§n{own & 63}", *(["§copy"] if own >> 6 & 1 else []), *(["§date"] if own >> 7 & 1 else [])], (None, "§title", "§endtitle")[own >> 8 & 3]


def own_tags(number: int) -> tuple[list[str], list[str]]:
    """Tags by their number: those of body.line_tags, and those of the line before, the title and lines alike."""
    own, title = seen_tags(number & 1023)
    before = number >> 20
    seen, last = seen_tags(before)
    also = ["<edge"] if before >> 10 & 1 else _pairs([*seen, *([last] if last else [])])
    return [*own, *(["§wide"] if number >> 11 & 1 else [])], [*also, f"§like{number >> 12 & 255}", *([title] if title else [])]


class Lines:
    """Numbers of tokens, kinds, shapes, tags and features, and what is known of each. rare: body.often_words, for keys."""

    def __init__(self, rare: body._Remembered | None = None):
        self.token_numbers, self.kinds, self.features, self.tag_numbers = Numbered(), Numbered(), Numbered(), Numbered()
        self.shape_numbers: dict[int, int] = {}
        self.shapes: list[tuple[str, ...]] = []
        self.places = np.empty(0, np.int64)
        names, hashes = self.token_numbers.names, body._Remembered(digest, MOST_TOKENS)
        column = lambda function, dtype=np.int64: Column(names, function, dtype)
        self.kind = column(lambda t: self.kinds[body.kind_of(t)])
        self.date = column(lambda t: bool(body._DATE.search(t)), bool)
        self.digit = column(lambda t: any(map(str.isdigit, t)), bool)
        self.copy = column(lambda t: "©" in t, bool)
        self.exact = column(lambda t: hashes[body._NUMBER.sub("0", t.lower())])
        masked = lambda t: body._NAME.sub("X", body._NUMBER.sub("0", t))
        kept = body._Remembered(body._kept, MOST_TOKENS)
        self.named, self.named_kept = column(lambda t: hashes[masked(t)]), column(lambda t: kept[masked(t)])
        if rare is not None:
            self.rare, self.rare_kept, self.is_rare = column(lambda t: hashes[rare[t]]), column(lambda t: kept[rare[t]]), column(lambda t: rare[t] == "X", bool)
        words = body._Remembered(body.words_of, MOST_TOKENS)
        number = self.features.__getitem__
        self.words = Lists(names, lambda t: list(map(number, words[t])))
        self.words_before = Lists(names, lambda t: [number("<" + w) for w in words[t]])
        text = body._Remembered(lambda shape: "#" + body._AGAIN.sub(r"\1+", "".join(shape)), MOST_TOKENS)
        self.shape_key = Column(self.shapes, lambda s: digest(text[s]))
        self.marks = Column(self.shapes, lambda s: not body._MARKS.isdisjoint(text[s]), bool)
        self.counters = Column(self.shapes, lambda s: "(" in text[s] and "+" in text[s], bool)
        shape_tags = body._Remembered(body.shape_tags, MOST_SHAPES)
        self.shape_own = Lists(self.shapes, lambda s: list(map(number, shape_tags[s][0])))
        self.shape_seen = Lists(self.shapes, lambda s: list(map(number, shape_tags[s][1])))
        self.tags = Lists(self.tag_numbers.names, lambda t: [number(f) for x in own_tags(t) for f in x])

    def full(self) -> bool:
        return len(self.token_numbers) > MOST_TOKENS

    def code(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tokens of lines, and how many each has."""
        if not lines:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        tokens = split.values.dictionary_encode()
        numbers = np.fromiter(map(self.token_numbers.__getitem__, tokens.dictionary.to_pylist()), np.int64, len(tokens.dictionary))
        return numbers[tokens.indices.to_numpy()], np.diff(split.offsets.to_numpy()).astype(np.int64)

    def sequence(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One hash of each sequence of hashes."""
        if not len(sizes):
            return np.zeros(0, np.int64)
        most = int(sizes.max())
        if most > len(self.places):
            self.places = mixed(np.arange(2 * most)) | 1
        starts = np.cumsum(sizes) - sizes
        return mixed(np.add.reduceat(hashes * self.places[np.arange(len(hashes)) - np.repeat(starts, sizes)], starts) + mixed(sizes))

    def names_of(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sequence(self.named[tokens], sizes), sums(self.named_kept[tokens], sizes)

    def common_of(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key with runs of rare words as one, words kept, and rare words after the first place."""
        starts, rare = np.cumsum(sizes) - sizes, self.is_rare[tokens]
        again = np.zeros(len(tokens), bool)
        again[1:] = rare[1:] & rare[:-1]
        again[starts] = False
        left = sums((~again).astype(np.int64), sizes)
        return self.sequence(self.rare[tokens[~again]], left), sums(self.rare_kept[tokens], sizes), sums((rare & ~again).astype(np.int64), sizes) - rare[starts]


class LineScores:
    """body.Scores of the lines of many pages."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, None

    def _fresh(self) -> Lines:
        w, known = self.weights, Lines()
        total = lambda features: sum([w.get(f, 0.0) for f in features])
        words, shape_tags = body._Remembered(body.words_of, MOST_TOKENS), body._Remembered(body.shape_tags, MOST_SHAPES)
        token, shape, tag = ((lambda f, dtype=float, x=x: Column(x, f, dtype)) for x in (known.token_numbers.names, known.shapes, known.tag_numbers.names))
        self.word, self.before = token(lambda t: total(words[t])), token(lambda t: total(_pairs(words[t])))
        self.rare = token(lambda t: any(f not in w for f in words[t]), bool)
        self.shape, self.seen = shape(lambda s: total(shape_tags[s][0])), shape(lambda s: total(shape_tags[s][1]))
        self.rare_shape = shape(lambda s: any(f not in w for f in shape_tags[s][0]), bool)
        self.tag = tag(lambda t: total([f for x in own_tags(t) for f in x]))
        self.rare_tag = tag(lambda t: any(f not in w for f in own_tags(t)[0]), bool)
        return known

    def of(self, pages: list[Page]) -> list[list[float]]:
        if self.known is None or self.known.full():
            self.known = self._fresh()
        c = Chunk(pages, self.known)
        if not c.lines:
            return [[] for _ in pages]
        c.titles()
        c.shapes()
        c.tags()
        places = np.repeat(np.arange(len(c.lines)) << 32, c.sizes) | c.tokens
        order = np.argsort(places, kind="stable")
        places = places[order]
        first = np.ones(len(places), bool)
        first[order[1:]] = places[1:] != places[:-1]
        before = self.seen[c.shape] + np.where(c.sizes <= 4, sums(self.before[c.tokens] * first, c.sizes), 0.0)
        before = np.concatenate(([0.0], before[:-1]))
        before[c.first] = 0.0
        rare = self.rare_shape[c.shape] | self.rare_tag[c.tag] | c.any(self.rare)
        s = self.shape[c.shape] + self.tag[c.tag] + sums(self.word[c.tokens] * first, c.sizes) + before + np.where(rare, self.weights.get("§rare", 0.0), 0.0)
        out, ends = np.clip(s, -body._CLIP, body._CLIP).tolist(), np.cumsum(c.of_page).tolist()
        return [out[b - n : b] for b, n in zip(ends, c.of_page.tolist(), strict=True)]
