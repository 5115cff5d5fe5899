"""Distances, cells and containment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NM, KM = 3440.065, 6371.0


def haversine(lat1, lon1, lat2, lon2, radius: float = KM) -> Column:
    c = [F.radians(F.col(x) if isinstance(x, str) else x) for x in (lat1, lon1, lat2, lon2)]
    a = F.pow(F.sin((c[2] - c[0]) / 2), 2) + F.cos(c[0]) * F.cos(c[2]) * F.pow(F.sin((c[3] - c[1]) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting against one ring of (lon, lat); fewer than three vertices hold nothing."""
    if len(ring) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = ((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def near_pairs(left: DataFrame, right: DataFrame, degrees: float) -> DataFrame:
    """Pairs (a, b) of rows whose planar distance in degrees is within ``degrees``, as ``deg``.

    The plane is cut into cells of that size; the right side goes to its cell and the eight around, so each task
    meets the rows of some cells only. Columns of the sides come as structs a and b.
    """
    cell = lambda c: F.floor(F.col(c) / degrees)
    a = left.select(F.struct(*left.columns).alias("a"), cell("lat").alias("cy"), cell("lon").alias("cx"))
    around = F.array(*[F.struct((cell("lat") + i).alias("cy"), (cell("lon") + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.select(F.struct(*right.columns).alias("b"), F.explode(around).alias("c")).select("b", "c.*")
    d = F.sqrt(F.pow(F.col("a.lat") - F.col("b.lat"), 2) + F.pow(F.col("a.lon") - F.col("b.lon"), 2))
    return a.join(b, ["cy", "cx"]).withColumn("deg", d).where(F.col("deg") <= degrees).select("a", "b", "deg")
