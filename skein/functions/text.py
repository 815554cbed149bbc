"""Text analysis: normalise, tokenise, stop, stem, hash; URL and page expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?"

# A published English stop list.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves "
    "then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def normalize_text(s: str) -> str:
    """NFKD without combining marks U+0300 to U+036F, lower case."""
    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", s)).lower()


@F.pandas_udf(StringType())
def _normalize_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalize_text(x))


def normalize(c: Column) -> Column:
    """normalize_text as a column; pure ASCII rows never leave the JVM's own lower()."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(_normalize_udf(c))


def raw_tokens(c: Column, ascii_only: bool = False) -> Column:
    """Tokens in order, unfiltered."""
    return F.regexp_extract_all(F.lower(c) if ascii_only else normalize(c), F.lit(TOKEN), F.lit(0))


def split_compound(s: str) -> str:
    """userId, user_id, user-id, user.id -> user id."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", s)
    return re.sub(r"[-_.]+", " ", s)


# --- Porter's stemmer, after the 1980 paper ----------------------------------------------------------------------------

_V = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in _V and not (c == "y" and i > 0 and _is_consonant(w, i - 1))


def _shape(w: str) -> str:
    return "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix rules of the paper's steps 2 to 4.
_STEP2 = (
    "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
)
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES2 = sorted((tuple(x.split(" ")) for x in _STEP2.split("|")), key=lambda r: -len(r[0]))
_RULES3 = sorted((tuple(x.split(" ")) for x in _STEP3.split("|")), key=lambda r: -len(r[0]))
_RULES4 = sorted(_STEP4.split(), key=len, reverse=True)


def _replace(w: str, rules) -> str:
    for end, new in rules:
        if w.endswith(end):
            root = w[: -len(end)]
            return root + new if _measure(root) > 0 else w
    return w


@lru_cache(100_000)
def stem(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        elif _measure(cut) == 1 and _short(cut):
            w = cut + "e"
        else:
            w = cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _RULES2)
    w = _replace(w, _RULES3)
    for end in _RULES4:
        if w.endswith(end):
            root = w[: -len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e"):
        root = w[:-1]
        m = _measure(root)
        if m > 1 or (m == 1 and not _short(root)):
            w = root
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def tokenize(text: str, stopwords: bool = True, stemming: bool = True) -> list[str]:
    """Driver-side analysis of one string (queries): normalise, tokenise, stop, drop single characters, stem."""
    out = [t for t in re.findall(TOKEN, normalize_text(text)) if len(t) > 1 and not (stopwords and t in STOPWORDS)]
    return [stem(t) for t in out] if stemming else out


@F.pandas_udf(StringType())
def stem_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else stem(x))


# --- Fuzziness and wildcards -------------------------------------------------------------------------------------------


def auto_distance(token: str) -> int:
    """Edit distance that AUTO allows: 0 up to 2 characters, 1 up to 5, else 2."""
    return 0 if len(token) <= 2 else 1 if len(token) <= 5 else 2


def has_wildcard(s: str) -> bool:
    return "*" in s or "?" in s


def wildcard_regex(p: str, ignore_case: bool = False) -> str:
    """Anchored regular expression of a glob of * and ?."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
    return ("(?i)" if ignore_case else "") + "^" + body + "$"


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a string's characters, as BIGINT."""
    step = lambda h, x: ((h.bitwiseXOR(F.ascii(x).cast("bigint"))) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("bigint"), step)


def shard_of(c: Column, shards: int) -> Column:
    return (fnv1a(c) % shards).cast("int")


def js_round(c: Column, digits: int = 3) -> Column:
    """Half up towards plus infinity."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


# --- URLs and pages ----------------------------------------------------------------------------------------------------


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, " ")))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(F.coalesce(p, F.lit("")) == "", "/").otherwise(p)


# Category rules, first match counts.
CATEGORY_RULES = (
    ("/(blog|posts?|articles?|news|stories)\\b", "blog"),
    ("/(docs?|documentation|guide|manual|reference|api)\\b", "docs"),
    ("/(products?|shop|store|catalog|pricing|item)\\b", "product"),
    ("/(about|company|team|careers|jobs)\\b", "about"),
    ("/(contact|support|help|faq)\\b", "support"),
    ("/(login|signin|signup|register|account|auth)\\b", "auth"),
    ("/(search|results)\\b", "search"),
    ("/(home)?/?$", "home"),
)


def page_category(url: Column, title: Column, keywords: Column) -> Column:
    is_url = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    path = F.lower(F.when(is_url, path_of(url)).otherwise(F.coalesce(url, F.lit(""))))
    hay = F.concat(path, F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(F.coalesce(F.array_join(keywords, " "), F.lit(""))))
    segment = F.regexp_extract(path, r"^/*([^/]+)", 1)
    out = F.when(segment.rlike(r"^[a-z0-9_-]{2,32}$"), segment).otherwise("page")
    for pattern, name in reversed(CATEGORY_RULES):
        out = F.when(hay.rlike(pattern), name).otherwise(out)
    return out


def page_type(path: Column, content_type: Column, has_article: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(ct.contains("xml") | path.endswith(".xml"), "feed")
        .when(F.coalesce(has_article, F.lit(False)), "article")
        .when(path.rlike(r"(?i)/(docs?|guide)\b"), "documentation")
        .when((path == "/") | (path == ""), "landing")
        .otherwise("webpage")
    )


_UTM = "utm_source|utm_medium|utm_campaign|utm_term|utm_content"


def normalize_url(url: Column) -> Column:
    """http and https only, without fragment and campaign parameters; others become null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, rf"(?<=[?&])(?:{_UTM})=[^&]*&?", "")
    u = F.regexp_replace(u, r"[?&]+$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z]+://[^/?#]*", "")
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, rest))
