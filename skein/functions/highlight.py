"""Highlights of the rows of one page of hits, as an Arrow UDF."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import tokenize

WINDOW, MARGIN, SNIPPET = 150, 40, 240


def snippet(text: str, limit: int = SNIPPET) -> str:
    """The text cut to limit: after a sentence past the middle, else at the last space with an ellipsis."""
    if len(text) <= limit:
        return text
    cut = text[:limit]
    stop = max(cut.rfind(". "), cut.rfind("! "), cut.rfind("? "))
    if stop > limit / 2:
        return cut[: stop + 1]
    space = cut.rfind(" ")
    return cut[: space if space > 0 else limit] + "…"


def highlight(text: str, terms: list[str]) -> str | None:
    """The window of WINDOW characters with the most different terms, a margin around it, matches in <em>; None without a match.

    A word matches a term when it begins with the term's first four characters (the whole term if shorter). All terms are
    marked in one pass, so marks are never marked again.
    """
    stems = list(dict.fromkeys(t[:4].lower() for t in terms if t))
    if not text or not stems:
        return None
    words = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(stems, key=len, reverse=True))) + r")\w*", re.IGNORECASE)
    at = [(m.start(), next(s for s in stems if m.group().lower().startswith(s))) for m in words.finditer(text)]
    if not at:
        return None
    best, most, lo = at[0][0], 0, 0
    for hi in range(len(at)):
        while at[hi][0] - at[lo][0] > WINDOW:
            lo += 1
        n = len({s for _, s in at[lo : hi + 1]})
        if n > most:
            best, most = at[lo][0], n
    start, end = max(0, best - MARGIN), min(len(text), best + WINDOW + MARGIN)
    if start:
        start = text.find(" ", start, best) + 1 or start
    marked = words.sub(lambda m: f"<em>{m.group()}</em>", text[start:end])
    return ("… " if start else "") + marked + (" …" if end < len(text) else "")


def highlight_column(text: Column, query: str, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Highlight of a text column for a query; with synonyms the words are taken unstemmed and widened."""
    terms = tokenize(query, True, synonyms is None)
    terms += [s for t in list(terms) for s in (synonyms or {}).get(t, [])]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else highlight(x, terms))

    return run(text)
