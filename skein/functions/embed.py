"""Embeddings that need no model files, as Arrow UDFs, and a registry for others."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import split_compound, stem, tokenize
from skein.plans.model import EngineError

_FNV, _PRIME, _GOLDEN = 2166136261, 16777619, 0x9E3779B9


def _units(s: str) -> list[int]:
    b = s.encode("utf-16-le", "surrogatepass")
    return [b[i] | b[i + 1] << 8 for i in range(0, len(b), 2)]


def _fnv(s: str, seed: int = 0) -> int:
    h = (_FNV ^ seed) & 0xFFFFFFFF
    for c in _units(s):
        h = ((h ^ c) * _PRIME) & 0xFFFFFFFF
    return h


def _grams(t: str) -> list[str]:
    if len(t) < 3:
        return ["#" + t] if t else []
    p = f"#{t}#"
    return [p[i : i + 3] for i in range(len(p) - 2)]


@lru_cache(200_000)
def _feature(key: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the four salted hashes of a feature lie, and their signed weights for a weight of 1."""
    hashes = [_fnv(key, (salt * _GOLDEN) & 0xFFFFFFFF) for salt in range(4)]
    return np.array([h % dims for h in hashes]), np.array([1.0 if h & 1 else -1.0 for h in hashes])


_SALTS = np.arange(1.0, 5.0)


def local_embed(text: str, dims: int = 384, synonyms: Callable[[str], list[str]] | None = None) -> list[float]:
    """Signed feature hashing of unigrams, character trigrams and bigrams with four salts; unit length, or zeros without tokens."""
    dims = max(1, min(int(dims), 1536))
    words = tokenize(split_compound(text))
    if not words:
        return np.zeros(dims).tolist()
    spread = [x for w in words for x in (w, *(stem(s.lower()) for s in (synonyms(w) if synonyms else ())))]
    features = [("u:" + w, 1.0) for w in spread] + [("c:" + g, 0.35) for w in spread for g in _grams(w)]
    features += [(f"b:{a}_{b}", 0.6) for a, b in zip(words, words[1:], strict=False)]
    found = [_feature(key, dims) for key, _ in features]
    weights = np.array([weight for _, weight in features])[:, None]
    values = np.array([signs for _, signs in found]) * weights / _SALTS
    vec = np.bincount(np.concatenate([at for at, _ in found]), values.ravel(), dims)
    n = math.sqrt(float(vec @ vec)) or 1.0
    return (vec / n).tolist()


def _to_int32(x: float) -> int:
    """ToInt32 of a double."""
    n = int(math.fmod(x, 4294967296.0)) if math.isfinite(x) else 0
    n &= 0xFFFFFFFF
    return n - (1 << 32) if n >= 1 << 31 else n


def _double_hash(s: str, seed: int) -> float:
    """FNV-like hash whose product is an IEEE double that wraps only at the next xor."""
    h = float(seed)
    for c in _units(s):
        h = float(_to_int32(h) ^ c) * _PRIME
    return h


@lru_cache(100_000)
def _part(part: str, dims: int, heads: int) -> tuple[list[int], list[float]]:
    """Where a part of a word lies in each head, and its signs."""
    size, at, sign = dims // heads, [], []
    for head in range(heads):
        h = _double_hash(part, _to_int32(float((head * 0x45D9F3B) ^ _GOLDEN)))
        at.append((head * size + int(math.fmod(abs(h), size))) % dims)
        sign.append(1.0 if _to_int32(h) & 1 else -1.0)
    return at, sign


@lru_cache(30_000)
def _heads(word: str, dims: int, heads: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the word, its stem and its 2- and 3-grams lie in each head, their signs, and the heads' divisors."""
    parts = [word, stem(word)]
    for i in range(len(word) - 1):
        parts.append(word[i : i + 2])
        if i < len(word) - 2:
            parts.append(word[i : i + 3])
    found = [_part(p, dims, heads) for p in parts]
    return np.array([i for at, _ in found for i in at]), np.array([x for _, sign in found for x in sign]), np.tile(np.arange(1.0, heads + 1), len(parts))


@lru_cache(200_000)
def _pair(a: str, b: str, dims: int) -> tuple[int, float]:
    h = _double_hash(f"{a}_{b}", 0x811C9DC5)
    return int(math.fmod(abs(h), dims)), (1 if _to_int32(h) & 1 else -1) * 0.85


def micro_embed(text: str, dims: int = 384) -> list[float]:
    """Six hashed heads over words and their 2- and 3-grams with a positional weight, and bigrams; unit length."""
    clean = (text or "").strip()
    words = list(dict.fromkeys([*tokenize(split_compound(clean), True, False), *re.findall(r"[^\W_]+", clean)]))
    if not words:
        return np.zeros(dims).tolist()
    where, values = [], []
    for pos, w in enumerate(words):
        at, sign, divisor = _heads(w, dims)
        where.append(at)
        values.append(sign * (1.0 + 0.15 * math.sin(pos / 10)) / divisor)
        if pos < len(words) - 1:
            i, x = _pair(w, words[pos + 1], dims)
            where.append([i])
            values.append([x])
    vec = np.bincount(np.concatenate(where), np.concatenate(values), dims)
    n = math.sqrt(float(vec @ vec)) or 1.0
    return (vec / n).tolist()


def vision_embed(key: str | bytes, dims: int = 512, is_text: bool = False) -> list[float]:
    """Unit vector of a SHA-512 chain over a URL, the SHA-256 of image bytes, or a trimmed lower-case text; 6 decimals."""
    if isinstance(key, (bytes, bytearray)):
        key = hashlib.sha256(key).hexdigest()
    if is_text:
        key = key.strip().lower()
    block, raw = hashlib.sha512(key.encode()).digest(), b""
    while len(raw) < dims:
        raw += block
        block = hashlib.sha512(block).digest()
    v = (np.frombuffer(raw[:dims], np.uint8) / 255.0 * 2.0 - 1.0).astype(np.float32).astype(np.float64)
    n = math.sqrt(float(v @ v)) or 1.0
    return [float(f"{x:.6f}") for x in v / n]


EMBEDDERS: dict[str, tuple[Callable[[str, int], list[float]], int]] = {"local": (local_embed, 384), "micro-transformer": (micro_embed, 384)}


def register_embedder(name: str, embed: Callable[[str, int], list[float]], dims: int) -> None:
    """Add an embedder of one text; it runs inside an Arrow UDF."""
    EMBEDDERS[name] = (embed, dims)


def embedder(name: str) -> tuple[Callable[[str, int], list[float]], int]:
    if name not in EMBEDDERS:
        raise EngineError("ERR_VALIDATION", f"no embedder {name}; register one")
    return EMBEDDERS[name]


def embed_column(text: Column, name: str = "local", dims: int | None = None) -> Column:
    fn, native = embedder(name)
    d = dims or native

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [float(v) for v in fn(x or "", d)])

    return run(text)


def vision_column(key: Column, dims: int = 512) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else vision_embed(x, dims))

    return run(key)


_PREFERRED = ("title", "name", "body", "description", "content", "text", "summary", "desc")
_SKIPPED = ("url", "location", "status", "id")


def text_of_fields(df: DataFrame) -> Column:
    """Text to embed: preferred string fields first, title and name three times, then the other string fields."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    order = [n for n in _PREFERRED if n in strings] + [n for n in strings if n not in _PREFERRED and n not in _SKIPPED]
    part = lambda n: F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) != "", F.col(n))
    return F.concat_ws(" ", *[part(n) for n in order for _ in range(3 if n in ("title", "name") else 1)])
