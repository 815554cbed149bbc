"""Colours and motifs of pixel buffers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour palette (name, category, red, green, blue).
PALETTE = (
    ("Gold Zari", "Metallic", 212, 175, 55), ("Copper Bronze", "Metallic", 184, 115, 51), ("Silver Zari", "Metallic", 192, 192, 192), ("Royal Blue", "Blue", 65, 105, 225),
    ("Navy Blue", "Blue", 0, 0, 128), ("Peacock Blue", "Blue", 0, 95, 115), ("Indigo Blue", "Blue", 75, 0, 130), ("Sky Blue", "Blue", 135, 206, 235),
    ("Crimson Red", "Red", 220, 20, 60), ("Maroon", "Red", 128, 0, 0), ("Sindoor Red", "Red", 203, 40, 33), ("Rani Pink", "Pink", 233, 30, 99),
    ("Magenta", "Pink", 255, 0, 255), ("Mauve", "Pink", 224, 176, 255), ("Peach Coral", "Orange", 248, 131, 121), ("Rust Orange", "Orange", 196, 91, 40),
    ("Mustard Yellow", "Yellow", 225, 173, 1), ("Haldi Yellow", "Yellow", 255, 215, 0), ("Emerald Green", "Green", 80, 200, 120), ("Bottle Green", "Green", 0, 66, 37),
    ("Mehendi Olive", "Green", 128, 128, 0), ("Mint Green", "Green", 152, 255, 152), ("Deep Purple", "Purple", 54, 1, 63), ("Dark Chocolate Brown", "Brown", 61, 35, 20),
    ("Off White Cream", "Neutral", 250, 249, 246), ("Jet Black", "Neutral", 10, 10, 10),
)
_RGB = np.array([p[2:] for p in PALETTE], dtype=np.int64)

# Motifs and keywords of each texture.
TEXTURES = {
    "plain": (("Plain Weave", "Solid Finish"), ("plain", "solid", "minimal", "smooth")),
    "butta_scattered": (("Small Buttas", "Zari Dots", "Scatter Print"), ("butta", "scattered", "dots", "subtle zari", "bootis")),
    "checks_stripes": (("Kattam Checks", "Temple Border Checks", "Geometric Grid"), ("checks", "stripes", "grid", "kattam", "geometric")),
    "heavy_zari": (("Heavy Zari Pallu", "Ganga Jamuna Border", "Broad Temple Border"), ("heavy zari", "rich pallu", "temple border", "ornate", "festive border")),
    "figural_floral": (
        ("Floral Jaal", "Paisley Mango Motif", "Peacock / Elephant Silhouette Motif"),
        ("floral", "paisley", "mango", "kalka", "peacock", "elephant", "traditional motif", "figural"),
    ),
}


def nearest_color(rgb: np.ndarray) -> np.ndarray:
    """Index in PALETTE of the colour nearest to each row; ties go to the first."""
    return ((rgb[:, None, :].astype(np.int64) - _RGB[None]) ** 2).sum(axis=2).argmin(axis=1)


def dominant_colors(data: bytes, channels: int = 4, samples: int = 1000) -> tuple[list[str], list[tuple[str, int]]]:
    """Up to 4 dominant names and 6 (name, percent) of the pixels at even steps; transparent ones are skipped."""
    n = len(data) // channels
    if n == 0:
        return [], []
    px = np.frombuffer(data, np.uint8)[: n * channels].reshape(n, channels)[:: max(1, n // samples)]
    if channels == 4:
        px = px[px[:, 3] >= 50]
    at = nearest_color(px[:, :3]) if len(px) else np.empty(0, int)
    names, first, count = np.unique(at, return_index=True, return_counts=True)
    share = sorted(((int(np.floor(c / len(at) * 100 + 0.5)), f, PALETTE[k][0]) for k, f, c in zip(names, first, count, strict=True)), key=lambda x: (-x[0], x[1]))
    return [x[2] for x in share[:4]], [(x[2], x[0]) for x in share[:6]]


def motifs(data: bytes, width: int = 100, height: int = 100, channels: int = 4) -> tuple[str, float, list[str], list[str]]:
    """Texture, edge density, motifs and keywords from the gradients at every second pixel."""
    if len(data) < width * height * channels:
        return "plain", 0.0, ["solid"], ["plain", "solid"]
    px = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(height, width, channels).astype(np.float64)
    light = px[:, :, 0] * 0.299 + px[:, :, 1] * 0.587 + px[:, :, 2] * 0.114
    here = light[1 : height - 1 : 2, 1 : width - 1 : 2]
    dx = np.abs(here - light[1 : height - 1 : 2, 2:width:2][:, : here.shape[1]])
    dy = np.abs(here - light[2:height:2, 1 : width - 1 : 2][: here.shape[0]])
    slope = np.hypot(dx, dy)
    edge = slope > 35
    edges = int(edge.sum())
    density = edges / here.size if here.size else 0.0
    across, down, sharp = int((edge & (dx > 40)).sum()), int((edge & (dy > 40)).sum()), int((edge & (slope > 70)).sum())
    if density < 0.08:
        kind = "plain"
    elif density < 0.25:
        kind = "butta_scattered"
    elif abs(across - down) < edges * 0.15 and sharp > edges * 0.4:
        kind = "checks_stripes"
    else:
        kind = "heavy_zari" if density > 0.45 else "figural_floral"
    return kind, float(np.floor(density * 100 + 0.5) / 100), list(TEXTURES[kind][0]), list(TEXTURES[kind][1])


def visual_features(pixels: Column, width: Column, height: Column, channels: Column) -> Column:
    """STRUCT of dominant colours, palette, texture, edge density, tags and searchable text of a pixel buffer. No text recognition."""

    @F.pandas_udf("dominant array<string>, palette array<struct<name:string,percentage:int>>, texture string, edge_density double, tags array<string>, searchable string")
    def run(p: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.DataFrame:
        rows = []
        for data, ww, hh, cc in zip(p, w, h, c, strict=True):
            data = bytes(data or b"")
            dominant, palette = dominant_colors(data, int(cc))
            texture, density, m, k = motifs(data, int(ww), int(hh), int(cc))
            text = [f"Colors: {', '.join(dominant)}"] if dominant else []
            text += [f"Motifs: {', '.join(m)}", f"Patterns: {' '.join(k)}"]
            rows.append((dominant, [{"name": n, "percentage": s} for n, s in palette], texture, density, list(dict.fromkeys([*dominant, *m, *k])), " | ".join(text)))
        return pd.DataFrame(rows, columns=["dominant", "palette", "texture", "edge_density", "tags", "searchable"])

    return run(pixels, width, height, channels)
