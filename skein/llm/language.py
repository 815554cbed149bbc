"""Languages of documents and of their segments, by a byte convolutional network.

The network reads fixed windows of WINDOW bytes of lower-cased UTF-8: byte embedding, filters of several widths, maximum
over positions, softmax. It is trained here, in numpy: first on the short labelled texts (at most MAX_SAMPLES of them),
then on lines of a bounded sample of labelled pages (SAMPLE_PAGES), those whose page is in the language its label names
and that the first network doesn't place elsewhere. It is applied to every window of every line; a line's probabilities
are the mean over its windows, and a language other than the page's main one needs MIN_FOREIGN of it. Addresses, mail addresses, hashtags
and words with digits are taken out first; a line of which fewer than MIN_WORDS words or a third of its words remain has
no language.

Defined cases: null and empty texts have no segments; a line whose best language stays under MIN_CONFIDENCE has none; a
row delivered twice counts once; without labelled texts there is nothing to apply and training raises ValueError.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import scratch, spread
from skein.llm.common import bounded_sample
from skein.llm.langlabels import language_of

WINDOW = 96
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
DIMS = 8
MAX_SAMPLES = 2000
MIN_WORDS = 5
MIN_CONFIDENCE = 0.6
MIN_FOREIGN = 0.85
#: What a line of fewer than SHORT_LINE words needs instead; menus and the like are hardly more than names.
MIN_FOREIGN_SHORT, SHORT_LINE = 0.95, 20
SAMPLE_PAGES = 1500

_OPAQUE = re.compile(r"://|^www\.|@|^[#＃]|\d")
_QUOTED = re.compile(r"„[^“”]*[“”]|“[^”]*”|«[^»]*»|\"[^\"]*\"")
_SPAN = max(WIDTHS)


class Words(dict):
    """Words of a lower-cased line as the network reads them, remembered up to a bound; "" for those without language."""

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = word if any(map(str.isalpha, word)) and not _OPAQUE.search(word) else ""
        return out


def plain(line: str, known: Words) -> list[str]:
    """The line's words in lower case, without addresses, hashtags, words with digits, and quotations where enough is left without them."""
    line = line.lower()
    if any(q in line for q in "„«“\""):
        rest = list(filter(None, map(known.__getitem__, _QUOTED.sub(" ", line).split())))
        if len(rest) >= MIN_WORDS:
            return rest
    return list(filter(None, map(known.__getitem__, line.split())))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) of all texts, the last of each moved back to end with its text, and the text each is from."""
    short = [i for i, t in enumerate(texts) if len(t) < WINDOW]
    texts = list(texts)
    for i in short:
        texts[i] = texts[i].ljust(WINDOW)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else sizes
    counts = -(-sizes // WINDOW)
    of = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offset[of] + np.minimum(nth * WINDOW, sizes[of] - WINDOW)
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return (np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[start] if len(start) else np.empty((0, WINDOW), np.uint8)), of


class ByteCnn:
    """The network. languages: the classes, in the order of its outputs."""

    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        f = FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.zeros((_SPAN * DIMS, f), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * DIMS, k * FILTERS : (k + 1) * FILTERS] = 1
        self.p = {
            "e": rng.normal(0, 0.5, (256, DIMS)).astype(np.float32),
            "w": (rng.normal(0, 1, self.mask.shape) / np.sqrt(self.mask.sum(0))).astype(np.float32) * self.mask,
            "b": np.zeros(f, np.float32),
            "v": rng.normal(0, 0.2, (f, len(languages))).astype(np.float32),
            "c": np.zeros(len(languages), np.float32),
        }

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["e"][x].reshape(len(x), -1)
        t = x.shape[1] - _SPAN + 1
        view = np.lib.stride_tricks.as_strided(e, (len(x), t, _SPAN * DIMS), (e.strides[0], DIMS * e.strides[1], e.strides[1]))
        return np.ascontiguousarray(view)

    def probabilities(self, x: np.ndarray, batch: int = 48) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), batch):
            cols = self._columns(x[i : i + batch])
            n, t, k = cols.shape
            top = (cols.reshape(n * t, k) @ self.p["w"]).reshape(n, t, -1).max(axis=1) + self.p["b"]
            z = np.maximum(top, 0) @ self.p["v"] + self.p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + batch] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, texts: list[str], labels: list[str], steps: int = 450, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteCnn:
        """Adam on random windows of the texts."""
        rng = np.random.default_rng(seed)
        known = Words()
        words = [[w for w in t.split() if known[w.lower()]] for t in texts]
        # names say nothing about the language of a text: each is replaced by one from any text
        # (texts that capitalise more than names are left out)
        few = [t for t in words if 5 * sum(w[:1].isupper() for w in t) < len(t)]
        names = [w for t in few for w, before in zip(t[1:], t, strict=False) if w[:1].isupper() and before[-1:].isalnum() and self._foreign(w)]
        y = np.array([self.languages.index(x) for x in labels])
        def draw():
            pick = rng.integers(0, len(words), batch)
            return np.stack([self._window(words[i], names, rng) for i in pick]), y[pick]

        return self._descend(draw, steps, rate, rng)

    def refit(self, x: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 96, rate: float = 0.003, seed: int = 6) -> ByteCnn:
        """Go on with windows x of classes y; each class is drawn as often as any other."""
        rng = np.random.default_rng(seed)
        weight = 1.0 / np.bincount(y, minlength=len(self.languages))[y]
        weight /= weight.sum()
        order = rng.choice(len(y), steps * batch, p=weight).reshape(steps, batch)
        turns = iter(order)

        def draw():
            pick = next(turns)
            return x[pick], y[pick]

        return self._descend(draw, steps, rate, rng)

    def _descend(self, draw, steps: int, rate: float, rng: np.random.Generator) -> ByteCnn:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        mean: dict[str, np.ndarray] = {}
        for step in range(1, steps + 1):
            g = self._gradients(*draw(), rng)
            for k, d in g.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                scale = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.p[k] = (self.p[k] - scale * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            self.p["w"] *= self.mask
            if 2 * step > steps:
                # the mean of the second half's weights depends less on the order of the draws
                for k, v in self.p.items():
                    mean[k] = mean.get(k, 0) + v / (steps - steps // 2)
        self.p = {k: v.astype(np.float32) for k, v in mean.items()}
        return self

    @staticmethod
    def _foreign(word: str) -> bool:
        return word.isascii() and word.isalpha()

    def _window(self, words: list[str], names: list[str], rng: np.random.Generator) -> np.ndarray:
        """A random window of a text, some words dropped, names swapped, now and then with a name or two put in."""
        out = []
        chance = rng.random(len(words))
        few = 5 * sum(w[:1].isupper() for w in words) < len(words)
        for k, w in enumerate(words):
            if chance[k] < 0.08:
                continue
            if few and names and k and w[:1].isupper() and self._foreign(w) and words[k - 1][-1:].isalnum() and chance[k] < 0.7:
                w = names[int(rng.integers(len(names)))]
            out.append(w)
            if names and chance[k] > 0.93:
                out.append(names[int(rng.integers(len(names)))])
        data = " ".join(out).lower().encode().ljust(WINDOW)
        a = int(rng.integers(0, len(data) - WINDOW + 1))
        return np.frombuffer(data, np.uint8)[a : a + WINDOW]

    def _gradients(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        cols = self._columns(x)
        z = (cols.reshape(-1, cols.shape[2]) @ p["w"]).reshape(n, cols.shape[1], -1)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0, :] + p["b"]
        keep = (rng.random(top.shape) < 0.8) / np.float32(0.8)
        h = np.maximum(top, 0) * keep
        o = h @ p["v"] + p["c"]
        o = np.exp(o - o.max(axis=1, keepdims=True))
        o /= o.sum(axis=1, keepdims=True)
        o[np.arange(n), y] -= 1
        o /= n
        dh = (o @ p["v"].T) * keep * (top > 0)
        picked = cols[np.arange(n)[:, None], at]
        back = (dh[:, :, None] * p["w"].T[None]).reshape(n, -1, _SPAN, DIMS)
        de = np.zeros_like(p["e"])
        np.add.at(de, x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(_SPAN)], back)
        return {"e": de, "w": np.einsum("bf,bfk->kf", dh, picked), "b": dh.sum(0), "v": h.T @ o + 1e-4 * p["v"], "c": o.sum(0)}


def train(samples: DataFrame, pages: DataFrame | None = None, limit: int = MAX_SAMPLES, sample_pages: int = SAMPLE_PAGES) -> ByteCnn:
    """Fit on at most limit labelled rows (sample_id, lang, text), the smallest ids first, then on at most sample_pages pages."""
    rows = samples.where("text IS NOT NULL AND lang IS NOT NULL").select("sample_id", "lang", "text").orderBy("sample_id").limit(limit).collect()
    pairs = [(r.text, code) for r in rows if (code := language_of(r.lang))]
    if not pairs:
        raise ValueError("no labelled texts to train on")
    model = ByteCnn(sorted({c for _, c in pairs})).fit([t for t, _ in pairs], [c for _, c in pairs])
    if pages is None:
        return model
    rows = bounded_sample(pages.where("text IS NOT NULL").select("page_id", "lang", "text"), "page_id", sample_pages)
    return learn_from_pages(model, [(r.lang, r.text) for r in rows], pairs)


def learn_from_pages(model: ByteCnn, pages: list[tuple[str | None, str]], samples: list[tuple[str, str]]) -> ByteCnn:
    """Go on with the lines of pages (label, text) that the network finds to be in the language of their label.

    A language without such a line is represented by its labelled texts, samples (text, language).
    """
    known = Words()
    texts, classes = [], []
    for label, text in pages:
        named = language_of(label)
        lines = [x for x in text.split("\n") if x.count(" ") >= MIN_WORDS]
        if named not in model.languages or not lines:
            continue
        found = classify_lines(lines, model, known)
        votes = [lang for lang, _ in found if lang]
        if 2 * votes.count(named) <= len(votes) or not votes:
            continue
        for line, (lang, sure) in zip(lines, found, strict=True):
            words = plain(line, known)
            if len(words) >= MIN_WORDS and (lang in (None, named) or sure < 0.8):
                texts.append(" ".join(words).encode("utf-8", "replace"))
                classes.append(model.languages.index(named))
    seen = {model.languages[c] for c in classes}
    for text, lang in samples:
        if lang not in seen:
            texts.append(" ".join(plain(text, known)).encode("utf-8", "replace"))
            classes.append(model.languages.index(lang))
    x, of = windows(texts)
    return model.refit(x, np.array(classes)[of])


def classify_lines(lines: list[str], model: ByteCnn, known: Words | None = None) -> list[tuple[str | None, float]]:
    """Language and confidence of each line; (None, 0.0) where it has none."""
    known = Words() if known is None else known
    out: list[tuple[str | None, float]] = [(None, 0.0)] * len(lines)
    texts, at = [], []
    for i, line in enumerate(lines):
        words = plain(line, known)
        if len(words) >= MIN_WORDS and 3 * len(words) > line.count(" "):
            texts.append(" ".join(words).encode("utf-8", "replace"))
            at.append(i)
    if texts:
        x, of = windows(texts)
        prob = model.probabilities(x)
        mean = np.add.reduceat(prob, np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1]), axis=0)
        mean /= np.bincount(of)[:, None]
        best = mean.argmax(axis=1)
        for i, b, c in zip(at, best, mean.max(axis=1), strict=True):
            if c >= MIN_CONFIDENCE:
                out[i] = (model.languages[b], float(c))
    return out


def settle(ids: list, sizes: list[int], found: list[tuple[str | None, float]]) -> list[tuple[str | None, float]]:
    """found without the languages that differ from their page's main one and aren't sure. ids: the page of each line, in runs."""
    out, start = list(found), 0
    while start < len(ids):
        end, weight = start, {}
        while end < len(ids) and ids[end] == ids[start]:
            lang, sure = found[end]
            if lang:
                weight[lang] = weight.get(lang, 0.0) + sure * sizes[end]
            end += 1
        main = max(sorted(weight), key=weight.get) if weight else None
        for k in range(start, end):
            if found[k][0] != main and found[k][1] < (MIN_FOREIGN if sizes[k] >= SHORT_LINE else MIN_FOREIGN_SHORT):
                out[k] = (None, 0.0)
        start = end
    return out


def line_languages(pages: DataFrame, model: ByteCnn, min_words: int = 1) -> DataFrame:
    """(page_id, line_no, words, lang, confidence, label) of each line of min_words words or more that has a language."""
    pages = pages.where("text IS NOT NULL AND page_id IS NOT NULL").select("page_id", "text", "lang")

    def run(batches):
        known = Words()
        for b in batches:
            ids, nos, sizes, labels, lines = [], [], [], [], []
            for i, text, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                named = language_of(label)
                for k, line in enumerate(text.split("\n")):
                    n = len(line.split())
                    if n >= min_words:
                        ids.append(i)
                        nos.append(k)
                        sizes.append(n)
                        labels.append(named)
                        lines.append(line)
            found = settle(ids, sizes, classify_lines(lines, model, known))
            has = [k for k, (lang, _) in enumerate(found) if lang]
            cols = [[c[k] for k in has] for c in (ids, nos, sizes, [x for x, _ in found], [x for _, x in found], labels)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "line_no", "words", "lang", "confidence", "label"])

    return spread(pages).mapInArrow(run, "page_id long, line_no int, words int, lang string, confidence double, label string")


def page_guesses(pages: DataFrame, model: ByteCnn) -> DataFrame:
    """(page_id, lang, confidence): the network's best language of each page's whole text; null and 0 where no word is left to read."""
    pages = pages.where("page_id IS NOT NULL").select("page_id", "text")

    def run(batches):
        known = Words()
        for b in batches:
            texts = [" ".join(plain(" ".join((t or "").split()), known)).encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            langs: list[str | None] = [None] * len(texts)
            sure = np.zeros(len(texts))
            at = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
            if len(at):
                x, of = windows([texts[i] for i in at])
                mean = np.zeros((len(at), len(model.languages)))
                np.add.at(mean, of, model.probabilities(x))
                mean /= np.bincount(of)[:, None]
                sure[at] = mean.max(axis=1)
                for i, k in zip(at, mean.argmax(axis=1), strict=True):
                    langs[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(sure)], names=["page_id", "lang", "confidence"])

    return spread(pages).mapInArrow(run, "page_id long, lang string, confidence double").dropDuplicates(["page_id"])


def page_languages(pages: DataFrame, model: ByteCnn) -> DataFrame:
    """One row per page and language found in its lines: lines, words, confidence (mean by words), and whether it is the main one.

    A page in which no line has a language gets the best one of its whole text, of 0 lines, with what confidence it has.
    """
    from pyspark.sql import Window

    per = (
        line_languages(pages, model, 1).dropDuplicates(["page_id", "line_no"]).groupBy("page_id", "lang")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("words").alias("n_words"), (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("confidence"))
    )
    order = Window.partitionBy("page_id").orderBy(F.desc("n_words"), "lang")
    found = scratch(per.withColumn("is_main", F.row_number().over(order) == 1), "langs")
    rest = page_guesses(pages.join(found.select("page_id").distinct(), "page_id", "left_anti"), model)
    none = F.lit(0).cast("long")
    return found.unionByName(rest.select("page_id", "lang", none.alias("n_lines"), none.alias("n_words"), "confidence", F.lit(True).alias("is_main")))


def segments(pages: DataFrame, model: ByteCnn) -> DataFrame:
    """(page_id, first_line, last_line, lang, confidence): runs of lines of one language; lines without language don't break a run."""
    from pyspark.sql import Window

    order = Window.partitionBy("page_id").orderBy("line_no")
    lines = line_languages(pages, model, 1).dropDuplicates(["page_id", "line_no"])
    fresh = F.when(F.lag("lang").over(order) == F.col("lang"), 0).otherwise(1)
    return (
        lines.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order)).groupBy("page_id", "run")
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.first("lang").alias("lang"), (F.sum(F.col("words") * F.col("confidence")) / F.sum("words")).alias("confidence"))
        .drop("run")
    )


def unnamed_languages(pages: DataFrame, model: ByteCnn, min_words: int = 12) -> DataFrame:
    """(page_id, lang): languages of lines of min_words words or more that the page's label doesn't name."""
    return line_languages(pages, model, min_words).where("label IS NULL OR label <> lang").select("page_id", "lang").distinct()
