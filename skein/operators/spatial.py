"""Points near other points, and points in regions.

Near points: latitude is cut into strips of a few radii, each point also goes to the strip below when it lies within the
radius of it, and strips are cut into blocks of longitude the same way, so a town is many blocks. The blocks are range
partitioned by (strip, block) and sorted by longitude inside; a sweep keeps, for each point, the points up to the radius
to the east, and verifies their great-circle distance. A pair belongs to the strip of its southern point and the block of
its western one, so it is found once. Blocks of more than HOT points are cut into parts, and pairs of parts are swept as
tasks of their own.

Regions: polygons are laid out over one-degree cells; a point meets the polygons of its cell and is tested even-odd.

Defined cases: points with a null, non-finite or out-of-range coordinate, with both coordinates 0, or with a null id are
no points; a point is not near itself; equal points are near each other; a point on an edge of a polygon counts to the
side the half-open rule gives it; polygons of fewer than three corners contain nothing; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.runtime import maybe_broadcast, scratch

EARTH_KM = 6371.0088
#: Height of a strip and width of a block, in radii.
STRIP_RADII, BLOCK_RADII = 8, 32
HOT = 20_000
_PIECE = 2_000_000


def valid_point(lat: Column, lon: Column) -> Column:
    """Latitude within 90, longitude within 180, neither null, not both 0."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def latest_points(rows: DataFrame, id_column: str = "id", order: str = "seq", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """id, lat, lon of the row of the highest order of each id, if that row has a valid point. Ties: the larger point."""
    last = rows.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.max(F.struct(F.col(order).alias("o"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))).alias("x"))
    return last.select("id", "x.lat", "x.lon").where(valid_point(F.col("lat"), F.col("lon")))


def _blocks(points: DataFrame, km: float) -> DataFrame:
    """Rows (strip, block, x, lat, lon, id, low, west): the point, where it stands in a block, whether strip and block are its own."""
    r = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-12
    h = min(STRIP_RADII * r, 180.0)
    strip = lambda c: F.floor((c + 90.0) / h)
    rows = points.withColumn("s", strip(F.col("lat"))).withColumn("strip", F.explode(F.sequence(strip(F.col("lat") - r), F.col("s")))).where("strip >= 0")
    low, high = F.col("strip") * h - 90.0, (F.col("strip") + 1) * h - 90.0 + r
    farthest = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
    reach = F.when(farthest + r >= 90.0, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(r)) / F.cos(F.radians(farthest))))) * (1 + 1e-9) + 1e-12)
    rows = rows.withColumn("reach", reach).withColumn("n", F.floor(F.lit(360.0) / (BLOCK_RADII * F.col("reach"))))
    rows = rows.withColumn("n", F.when(F.col("n") < 3, 1).otherwise(F.col("n"))).withColumn("width", F.lit(360.0) / F.col("n"))
    east = F.col("lon") + 180.0
    block = lambda c: F.pmod(F.floor(c / F.col("width")), F.col("n"))
    rows = rows.withColumn("own", block(east)).withColumn("block", F.explode(F.array_distinct(F.array("own", block(east - F.col("reach"))))))
    x = F.pmod(east - F.col("block") * F.col("width") + 180.0, F.lit(360.0)) - 180.0
    rows = rows.withColumn("x", F.when(F.col("n") == 1, east).otherwise(x)).withColumn("west", F.col("own") == F.col("block"))
    # a block that goes round the earth also holds its western edge again in the east
    again = (F.col("n") == 1) & (F.col("x") <= F.col("reach"))
    rows = rows.withColumn("turn", F.explode(F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "strip", "block", (F.col("x") + 360.0 * F.col("turn")).alias("x"), "lat", "lon", "id",
        (F.col("s") == F.col("strip")).alias("low"), (F.col("west") & (F.col("turn") == 0)).alias("west"), "reach",
    )


def _cut(rows: DataFrame, hot: int) -> DataFrame:
    """Rows with the parts u, v of their task and their own part; blocks of up to hot rows are one task."""
    sizes = rows.groupBy("strip", "block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot)
    sizes = scratch(sizes.select("strip", "block", F.ceil(F.col("size") / hot).cast("int").alias("parts")), "hot")
    if sizes.isEmpty():
        return rows.withColumns({"part": F.lit(0), "u": F.lit(0), "v": F.lit(0)})
    rows = rows.join(maybe_broadcast(sizes), ["strip", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("u", F.least("part", "with")).withColumn("v", F.greatest("part", "with")).drop("parts", "with")


def distance_km(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Great-circle distance by the haversine formula."""
    a, b = np.radians(lat_a), np.radians(lat_b)
    half = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(half)))


def _sweep(km: float):
    """Sweep over sorted rows; the rows of a task that a batch breaks off are kept for the next."""

    def pairs(t: pa.Table):
        get = lambda c: t.column(c).to_numpy()
        keys = [get(c) for c in ("strip", "block", "u", "v")]
        fresh = np.ones(len(t), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        task = np.cumsum(fresh)
        x, reach, lat, lon, low, west, part = (get(c) for c in ("x", "reach", "lat", "lon", "low", "west", "part"))
        crossed = keys[2] != keys[3]
        ids = t.column("id")
        # x lies within 900 of 0, so tasks of one batch stand apart; the slack covers rounding and is verified away
        place = task * 2000.0 + x
        end = np.searchsorted(place, place + reach + 1e-6, side="right")
        first = np.flatnonzero(west)
        n = end[first] - first - 1
        first, n = first[n > 0], n[n > 0]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n) // _PIECE)) + 1, [len(n)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            i = np.repeat(first[lo:hi], n[lo:hi])
            if not len(i):
                continue
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            keep = (task[i] == task[j]) & (low[i] | low[j]) & (~crossed[i] | (part[i] != part[j])) & (x[j] - x[i] < 180.0)
            i, j = i[keep], j[keep]
            d = distance_km(lat[i], lon[i], lat[j], lon[j])
            near = d <= km
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i[near])).combine_chunks(), ids.take(pa.array(j[near])).combine_chunks(), pa.array(d[near])], names=["p", "q", "km"])

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = [t.column(c).to_numpy() for c in ("strip", "block", "u", "v")]
            same = np.all([k == k[-1] for k in keys], axis=0) if len(t) else np.zeros(0, bool)
            cut = len(t) - (int(np.argmin(same[::-1])) if not same.all() else len(t))
            rest = t.slice(cut)
            if cut:
                yield from pairs(t.slice(0, cut).combine_chunks())
        if rest is not None and len(rest):
            yield from pairs(rest.combine_chunks())

    return run


def near_pairs(points: DataFrame, km: float, hot: int = HOT) -> DataFrame:
    """(id_a, id_b, km), the smaller id first: all pairs of points (id, lat, lon) at most km apart."""
    kind = dict(points.dtypes)["id"]
    rows = _cut(_blocks(points.select("id", "lat", "lon"), km), hot)
    rows = rows.repartitionByRange("strip", "block", "u", "v").sortWithinPartitions("strip", "block", "u", "v", "x", "id")
    found = rows.mapInArrow(_sweep(km), f"p {kind}, q {kind}, km double")
    return found.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"), "km")


def containing_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, area_id) of each point (id, lat, lon) and each polygon (area_id, ring of (lat, lon)) that contains it.

    A ring may run on past 180 or -180 degrees of longitude.
    """
    ring = F.col("ring")
    corner = lambda f: F.transform(ring, lambda p: p[f])
    boxes = regions.where("size(ring) >= 3 AND area_id IS NOT NULL").select(
        "area_id", "ring", *(g(corner(f)).alias(n) for n, g, f in (("south", F.array_min, "lat"), ("north", F.array_max, "lat"), ("left", F.array_min, "lon"), ("right", F.array_max, "lon")))
    )
    cells = boxes.select("area_id", "ring", F.explode(F.sequence(F.floor("south"), F.floor("north"))).alias("clat"), "left", "right")
    cells = cells.select("area_id", "ring", "clat", F.explode(F.sequence(F.floor("left"), F.floor("right"))).alias("cell")).withColumn("clon", F.pmod("cell", F.lit(360)))
    at = points.select("id", "lat", "lon", F.floor("lat").alias("clat"), F.pmod(F.floor("lon"), F.lit(360)).alias("clon"))
    met = at.join(cells, ["clat", "clon"]).withColumn("x", F.col("lon") + (F.col("cell") - F.floor("lon")))
    edges = F.arrays_zip("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)).alias("next"))

    def crossing(n: Column, e: Column) -> Column:
        a, b = e["ring"], e["next"]
        spans = (a["lat"] > F.col("lat")) != (b["lat"] > F.col("lat"))
        where = (b["lon"] - a["lon"]) * (F.col("lat") - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return n + F.when(spans & (F.col("x") < where), 1).otherwise(0)

    return met.where(F.aggregate(edges, F.lit(0), crossing) % 2 == 1).select("id", "area_id").distinct()
