"""Vessel behaviour, geofences and risk, for all vessels at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewright.functions.geo import NM, haversine, in_ring

#: Weights of the six risk factors.
WEIGHTS = {"flag": 0.15, "gap": 0.20, "behaviour": 0.20, "encounter": 0.15, "geofence": 0.15, "identity": 0.15}


def seconds(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) / 1e6


def windows(tracks: DataFrame, minutes: int = 30, step: int = 15, least: int = 3) -> DataFrame:
    """Each fix in every window it is in: windows of one vessel start at its first fix, and hold both their ends. Windows of
    fewer than ``least`` fixes go, but a track that has no more than that is one window."""
    first = F.min("ts").over(W.partitionBy("mmsi"))
    last = F.max("ts").over(W.partitionBy("mmsi"))
    off = (seconds("ts") - seconds(first)) / 60.0
    t = tracks.withColumns({"first_ts": first, "off": off, "span": (seconds(last) - seconds(first)) / 60.0})
    t = t.withColumn("short", F.count(F.lit(1)).over(W.partitionBy("mmsi")) < least)
    low, high = F.greatest(F.ceil((F.col("off") - minutes) / step), F.lit(0)), F.floor(F.col("off") / step)
    zero = F.lit(0).cast("long")
    t = t.withColumn("w", F.explode(F.sequence(F.when(F.col("short"), zero).otherwise(low), F.when(F.col("short"), zero).otherwise(high))))
    n = F.count(F.lit(1)).over(W.partitionBy("mmsi", "w"))
    return t.withColumn("n", n).where((F.col("n") >= least) | F.col("short")).drop("n", "off", "span", "short")


def features(w: DataFrame) -> DataFrame:
    """Kinematic features of each window of each vessel."""
    order = W.partitionBy("mmsi", "w").orderBy("ts", "id")
    w = w.withColumns({f"p_{c}": F.lag(c).over(order) for c in ("lat", "lon", "ts", "cog")})
    minutes = (seconds("ts") - seconds("p_ts")) / 60.0
    turn = F.abs(F.pmod(F.col("cog") - F.col("p_cog") + 180, F.lit(360.0)) - 180)
    w = w.withColumns({"nm": haversine("p_lat", "p_lon", "lat", "lon", NM), "rate": F.when(minutes > 0, turn / F.nullif(minutes, F.lit(0.0)))})
    g = w.groupBy("mmsi", "w").agg(
        F.count(F.lit(1)).alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.avg("sog").alias("mean_sog"), F.stddev_pop("sog").alias("std_sog"),
        F.avg(F.sin(F.radians("cog"))).alias("sy"), F.avg(F.cos(F.radians("cog"))).alias("cx"), F.coalesce(F.sum("nm"), F.lit(0.0)).alias("path_nm"), F.avg("rate").alias("turn_rate"),
        F.min(F.struct("ts", "id", "lat", "lon")).alias("a"), F.max(F.struct("ts", "id", "lat", "lon")).alias("b"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
    )
    g = g.withColumns({"straight_nm": haversine("a.lat", "a.lon", "b.lat", "b.lon", NM), "course_variance": F.when(F.col("points") < 2, 0.0).otherwise(1 - F.sqrt(F.col("sy") * F.col("sy") + F.col("cx") * F.col("cx")))})
    sinuosity = F.when(F.col("straight_nm") > 0.01, F.col("path_nm") / F.nullif("straight_nm", F.lit(0.0))).when(F.col("path_nm") < 0.01, 1.0).otherwise(99.0)
    return g.withColumns({"sinuosity": sinuosity, "turn_rate": F.coalesce("turn_rate", F.lit(0.0))}).drop("sy", "cx", "a", "b")


def classified(f: DataFrame) -> DataFrame:
    """An ordered decision on speed, course variance, sinuosity and turning, and how sure it is.

    Fishing needs a score of 0.65 of its three signs (0.35, 0.35, 0.30): in floating point, the first with the third stay below.
    """
    s, v, turn = F.col("mean_sog"), F.col("course_variance"), F.col("turn_rate")
    steady = s.between(1.5, 5) & (v >= 0.25)
    cases = [
        (F.col("points") < 2, "unknown", F.lit(0.0)),
        (s < 0.5, "anchored", F.least(F.lit(1.0), (1 - s / 0.5) * 0.5 + 0.5)),
        (steady, "fishing", F.when(F.col("sinuosity") >= 1.5, 1.0).otherwise(0.7)),
        ((s < 2) & (v >= 0.4), "loitering", F.least(F.lit(1.0), 0.5 + v * 0.5)),
        (turn >= 3, "maneuvering", F.least(F.lit(1.0), turn / 6)),
        ((s >= 4) & (v <= 0.15), "transiting", F.least(F.lit(1.0), 0.5 + (1 - v) * 0.3 + F.least(s / 15, F.lit(0.2)))),
        ((s < 3) & (v <= 0.15), "drifting", F.lit(0.5)),
    ]
    kind, sure = F.lit("unknown"), F.lit(0.2)
    for when, name, confidence in reversed(cases):
        kind, sure = F.when(when, name).otherwise(kind), F.when(when, confidence).otherwise(sure)
    return f.withColumns({"behaviour": kind, "confidence": sure})


def merged(c: DataFrame) -> DataFrame:
    """Runs of windows of one behaviour as one segment; points and distance of overlapping windows add up. Confidence is
    the mean of that so far and the next window's, window by window: weights that halve, as sums."""
    order = W.partitionBy("mmsi").orderBy("w")
    c = c.withColumn("new", (~F.col("behaviour").eqNullSafe(F.lag("behaviour").over(order))).cast("int"))
    c = c.withColumn("segment", F.sum("new").over(order))
    run = W.partitionBy("mmsi", "segment")
    after = F.count(F.lit(1)).over(run) - F.row_number().over(run.orderBy("w"))
    c = c.withColumn("weight", F.pow(F.lit(0.5), F.when(F.col("new") == 1, after).otherwise(after + 1)))
    return c.groupBy("mmsi", "segment", "behaviour").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("points").alias("points"), F.sum("path_nm").alias("path_nm"), F.min("south").alias("south"), F.max("north").alias("north"), F.sum(F.col("weight") * F.col("confidence")).alias("confidence"))


def behaviour_summary(segments: DataFrame) -> DataFrame:
    m = (seconds("end_ts") - seconds("start_ts")) / 60.0
    g = segments.groupBy("mmsi", "behaviour").agg(F.sum(m).alias("minutes"))
    return g.withColumn("pct", F.col("minutes") / F.nullif(F.sum("minutes").over(W.partitionBy("mmsi")), F.lit(0.0)) * 100)


def gaps(tracks: DataFrame, hours: float = 2.0) -> DataFrame:
    before = F.lag("ts").over(W.partitionBy("mmsi").orderBy("ts", "id"))
    t = tracks.withColumn("gap_start", before).withColumn("gap_hours", (seconds("ts") - seconds("gap_start")) / 3600)
    return t.where(F.col("gap_hours") >= hours).select("mmsi", "gap_start", F.col("ts").alias("gap_end"), F.round("gap_hours", 1).alias("gap_hours"))


#: Columns of a session of two vessels, as ``encounters`` finds them in a task.
SESSION = "mmsi_a long, mmsi_b long, first_mark long, last_mark long, marks long, min_nm double, avg_nm double, sog_a double, sog_b double, cog_apart double, seen_minutes double, lat double, lon double"


def encounters(nearest: DataFrame, nm: float = 10.0, least_minutes: float = 10.0, bucket_minutes: int = 5, degrees: float = 1.0) -> DataFrame:
    """Sessions of two vessels within ``nm``, from their nearest fixes at each mark (one a vessel and mark). A session ends
    only when the pair is seen farther apart; marks at which one of them is missing do not end it.

    A vessel's whole track goes to each cell that it comes into or within ``nm`` of. A pair is followed in one task: that of
    the first vessel's cell when they first meet. No pair is made as rows before its sessions are summed up."""
    fixes = nearest.where("mmsi is not null and mark is not null and lat is not null and lon is not null")
    fixes = fixes.select("mmsi", "mark", "lat", "lon", F.col("sog").cast("double").alias("sog"), F.col("cog").cast("double").alias("cog"), seconds("ts").alias("sec"))
    margin = nm / NM * 180 / math.pi * 1.001
    wide = F.least(margin / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + margin, F.lit(90.0)))), F.lit(1e-6)), F.lit(360.0))
    y = F.sequence(F.floor((F.col("lat") - margin) / degrees), F.floor((F.col("lat") + margin) / degrees))
    span = lambda turn: F.sequence(F.floor((F.col("lon") + turn - wide) / degrees), F.floor((F.col("lon") + turn + wide) / degrees))
    none = F.array().cast("array<bigint>")
    x = F.concat(span(0), F.when(F.col("lon") + wide >= 180, span(-360)).otherwise(none), F.when(F.col("lon") - wide <= -180, span(360)).otherwise(none))
    visits = fixes.select("mmsi", F.explode(y).alias("cy"), x.alias("x")).select("mmsi", "cy", F.explode("x").alias("cx")).distinct()
    track = fixes.groupBy("mmsi").agg(F.sort_array(F.collect_list(F.struct("mark", "lat", "lon", F.coalesce("sog", F.lit(float("nan"))).alias("sog"), F.coalesce("cog", F.lit(float("nan"))).alias("cog"), "sec"))).alias("t"))
    track = track.select("mmsi", *[F.col(f"t.{c}").alias(c) for c in ("mark", "lat", "lon", "sog", "cog", "sec")])

    def follow(key: tuple, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("mmsi")
        mmsi, marks = v["mmsi"].to_numpy(), np.unique(np.concatenate(v["mark"].to_list()))
        row, at = np.repeat(np.arange(len(v)), v["mark"].str.len()), np.searchsorted(marks, np.concatenate(v["mark"].to_list()))
        lat, lon, sog, cog, sec = (_dense(np.concatenate(v[c].to_list()), row, at, (len(v), len(marks))) for c in ("lat", "lon", "sog", "cog", "sec"))
        own = (np.floor(lat / degrees) == key[0]) & (np.floor(lon / degrees) == key[1])
        phi, theta = np.radians(lat), np.radians(lon)
        place = np.stack([np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)])
        out = []
        inside = np.flatnonzero(own.any(axis=1))
        for i in range(0, len(inside), 256):
            some = inside[i : i + 256]
            for a, first in zip(some, _first_meetings(place, some, nm)):
                b = np.flatnonzero(first >= 0)
                b = b[(b > a) & own[a, first[b]]]
                seen = np.flatnonzero(~np.isnan(lat[a]))
                for k in range(0, len(b), max(1, 500_000 // len(seen))):
                    out += _sessions(a, b[k : k + max(1, 500_000 // len(seen))], seen, marks, mmsi, place, lat, lon, sog, cog, sec, nm, least_minutes / bucket_minutes)
        columns = [c.split()[0] for c in SESSION.split(", ")]
        if not out:
            return pd.DataFrame([], columns=columns)
        return pd.DataFrame({c: np.concatenate([part[k] for part in out]) for k, c in enumerate(columns)})

    g = visits.join(track, "mmsi").groupBy("cy", "cx").applyInPandas(follow, SESSION)
    g = g.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in ("sog_a", "sog_b", "cog_apart") else F.col(c) for c in g.columns])
    return meeting_kind(g.withColumn("minutes", (F.col("last_mark") - F.col("first_mark")) * bucket_minutes))


def _dense(values: np.ndarray, row: np.ndarray, at: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[row, at] = values
    return out


def _first_meetings(place: np.ndarray, some: np.ndarray, nm: float) -> np.ndarray:
    """Of ``some`` vessels, the first mark at which each vessel is within ``nm``, else -1. Vessels at one place are met once
    a mark."""
    _, n, m = place.shape
    first = np.full((len(some), n), -1, np.int32)
    chord = (2 * np.sin(nm / NM / 2)) ** 2
    for t in range(m):
        mine = np.flatnonzero(~np.isnan(place[0, some, t]))
        if not len(mine):
            continue
        here = np.flatnonzero(~np.isnan(place[0, :, t]))
        spots_a, of_a = np.unique(place[:, some[mine], t], axis=1, return_inverse=True)
        spots_b, of_b = np.unique(place[:, here, t], axis=1, return_inverse=True)
        near = sum((spots_a[c][:, None] - spots_b[c][None, :]) ** 2 for c in range(3)) <= chord * (1 + 1e-9) + 1e-18
        x, y = np.nonzero(near[of_a.ravel()][:, of_b.ravel()])
        x, y = mine[x], here[y]
        new = first[x, y] < 0
        first[x[new], y[new]] = t
    return first


def _sessions(a: int, b: np.ndarray, seen: np.ndarray, marks, mmsi, place, lat, lon, sog, cog, sec, nm: float, least: float) -> list[tuple]:
    """The sessions of vessel ``a`` with each of ``b`` that last ``least`` marks and more."""
    if not len(b):
        return []
    apart = sum((place[c, b][:, seen] - place[c, a, seen]) ** 2 for c in range(3))
    d = 2 * NM * np.arcsin(np.sqrt(np.minimum(apart, 4)) / 2)
    close = d <= nm
    island = np.cumsum(d > nm, axis=1)
    r, c = np.nonzero(close)
    if not len(r):
        return []
    at = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (island[r[1:], c[1:]] != island[r[:-1], c[:-1]]))))
    last = np.concatenate((at[1:], [len(r)])) - 1
    t = seen[c]
    keep = marks[t[last]] - marks[t[at]] >= least
    if not keep.any():
        return []
    total = lambda x: np.add.reduceat(x, at)
    n, near = last - at + 1, d[r, c]

    def mean(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        if known.all():
            return total(x) / n
        count = total(known.astype(float))
        return np.divide(total(np.where(known, x, 0.0)), count, out=np.full(len(at), np.nan), where=count > 0)

    turn = np.abs((cog[a, t] - cog[b[r], t] + 180) % 360 - 180)
    time = sec[a, t]
    found = (np.full(len(at), mmsi[a]), mmsi[b[r[at]]], marks[t[at]], marks[t[last]], n, np.minimum.reduceat(near, at), mean(near), mean(sog[a, t]), mean(sog[b[r], t]), mean(turn), (np.maximum.reduceat(time, at) - np.minimum.reduceat(time, at)) / 60, mean(lat[a, t]), mean(lon[a, t]))
    return [tuple(x[keep] for x in found)]


def meeting_kind(g: DataFrame) -> DataFrame:
    """Kind, risk and confidence of meetings from speeds, courses, distance and how long the first vessel was seen."""
    a, b, close, long = F.col("sog_a"), F.col("sog_b"), F.col("min_nm"), F.col("seen_minutes")
    slow = (a < 3) & (b < 3)
    fast = F.greatest(a, b)
    parallel = (F.col("cog_apart") < 20) & (F.when(fast > 0.5, F.least(a, b) / fast).otherwise(0.0) > 0.7)
    kind = F.when(slow, "rendezvous").when(parallel, "parallel_transit").when(long < 30, "crossing").when((a < 2) & (b < 2), "loitering_pair").otherwise("unknown")
    sure = F.least(F.lit(1.0), 0.7 + F.when(close < 0.1, 0.15).otherwise(0.0) + F.when(F.col("marks") > 5, 0.1).otherwise(0.0))
    confidence = F.when(slow, sure).when(parallel, 0.6).when(long < 30, 0.4).when((a < 2) & (b < 2), 0.5).otherwise(0.3)
    met = F.when(long > 60, "critical").when((long > 30) | (close < 0.1), "high").otherwise("medium")
    risk = F.when(slow, met).when(parallel, F.when(close < 0.2, "medium").otherwise("low")).when(long < 30, "low").when((a < 2) & (b < 2), "medium").otherwise("low")
    return g.withColumns({"kind": kind, "risk": risk, "confidence": confidence})


def in_area(tracks: DataFrame, west: float, south: float, east: float, north: float, start: str | None = None, end: str | None = None) -> DataFrame:
    t = tracks.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    t = t if start is None else t.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return t if end is None else t.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def around_vessel(tracks: DataFrame, mmsi: int, nm: float = 10.0) -> DataFrame:
    """The vessel's fixes, and those of others in the box of its track and in its time, widened by ``nm`` (60 to a degree)."""
    own = tracks.where(F.col("mmsi") == mmsi)
    box = own.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    r = nm / 60.0
    near = tracks.crossJoin(F.broadcast(box)).where((F.col("mmsi") == mmsi) | (F.col("lat").between(F.col("s") - r, F.col("n") + r) & F.col("lon").between(F.col("w") - r, F.col("e") + r) & F.col("ts").between(F.col("t0"), F.col("t1"))))
    return near.select(tracks.columns)


def legs(tracks: DataFrame, stays: DataFrame) -> DataFrame:
    """Voyages: between two stays completed, after the last one (five fixes and over a mile) or of a vessel without stays
    (two fixes) in progress. With distance, speed, and stops: runs below a knot of 15 to under 60 minutes."""
    fixes = tracks.select("mmsi", "ts", "id", "lat", "lon", "sog", F.lit(1).alias("order"), F.lit(0).alias("ends"), F.lit(None).cast("int").alias("open"))
    null = lambda kind: F.lit(None).cast(kind)
    mark = lambda c, order, ends, open_: stays.select("mmsi", F.col(c).alias("ts"), null("long").alias("id"), null("double").alias("lat"), null("double").alias("lon"), null("double").alias("sog"), F.lit(order).alias("order"), F.lit(ends).alias("ends"), F.lit(open_).alias("open"))
    # The fix that ends a stay begins the voyage, and the one that begins the next stay ends it.
    both = fixes.unionByName(mark("end_ts", 0, 1, 1)).unionByName(mark("start_ts", 2, 0, 0))
    flow = W.partitionBy("mmsi").orderBy("ts", "order", "id")
    so_far = both.withColumns({"leg": F.sum("ends").over(flow), "under_way": F.coalesce(F.last("open", ignorenulls=True).over(flow), F.lit(1)), "stays": F.sum("ends").over(W.partitionBy("mmsi"))})
    sea = so_far.where("id is not null and under_way = 1 and (leg > 0 or stays = 0)")
    leg = W.partitionBy("mmsi", "leg").orderBy("ts", "id")
    sea = sea.withColumns({"nm": haversine(F.lag("lat").over(leg), F.lag("lon").over(leg), "lat", "lon", NM), "run": F.sum((F.col("sog") >= 1).cast("int")).over(leg), "slow": F.col("sog") < 1})
    runs = sea.where("slow").groupBy("mmsi", "leg", "run").agg(((seconds(F.max("ts")) - seconds(F.min("ts"))) / 60).alias("m")).where("m >= 15 and m < 60").groupBy("mmsi", "leg").agg(F.count(F.lit(1)).alias("stops"))
    g = sea.groupBy("mmsi", "leg").agg(F.min("ts").alias("depart"), F.max("ts").alias("arrive"), F.count(F.lit(1)).alias("points"), F.coalesce(F.sum("nm"), F.lit(0.0)).alias("distance_nm"), F.max("sog").alias("max_sog"), F.max("stays").alias("stays"))
    g = g.join(runs, ["mmsi", "leg"], "left").withColumn("hours", (seconds("arrive") - seconds("depart")) / 3600)
    done = F.col("leg") < F.col("stays")
    kept = done | ((F.col("stays") == 0) & (F.col("points") >= 2)) | ((F.col("stays") > 0) & (F.col("points") >= 5) & (F.col("distance_nm") > 1))
    return g.where(kept).select("mmsi", "leg", "depart", "arrive", "points", "distance_nm", "hours", (F.col("distance_nm") / F.nullif("hours", F.lit(0.0))).alias("avg_knots"), "max_sog", F.coalesce("stops", F.lit(0)).alias("stops"), F.when(done, "completed").otherwise("in_progress").alias("status"))


def port_stays(tracks: DataFrame, knots: float = 0.5, minutes: float = 60.0, drift_nm: float = 0.5) -> DataFrame:
    """Runs of slow fixes that last and stay near their centre; a run that ends the track is not held to the centre."""
    order = W.partitionBy("mmsi").orderBy("ts", "id")
    t = tracks.withColumns({"slow": (F.col("sog") <= knots).cast("int"), "rn": F.row_number().over(order), "last_id": F.last("id").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    t = t.withColumn("run", F.sum(1 - F.col("slow")).over(order)).where("slow = 1")
    run = W.partitionBy("mmsi", "run")
    t = t.withColumns({"clat": F.avg("lat").over(run), "clon": F.avg("lon").over(run)})
    g = t.groupBy("mmsi", "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("points"), F.max("clat").alias("lat"), F.max("clon").alias("lon"), F.max(haversine("clat", "clon", "lat", "lon", NM)).alias("drift_nm"), F.max((F.col("id") == F.col("last_id")).cast("int")).alias("final"))
    return g.where(((seconds("end_ts") - seconds("start_ts")) / 60 >= minutes) & ((F.col("drift_nm") <= drift_nm) | (F.col("final") == 1))).drop("run", "final")


def simplified(tracks: DataFrame, tolerance_nm: float = 1.0) -> DataFrame:
    """Ramer-Douglas-Peucker by vessel, with a stack of spans; distances on a plane in nautical miles about the span."""
    import numpy as np

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["ts", "id"])
        y, x, n = t["lat"].to_numpy() * 60, t["lon"].to_numpy() * 60, len(t)
        keep, spans = np.zeros(n, bool), [(0, n - 1)]
        keep[[0, -1]] = True
        while spans:
            i, j = spans.pop()
            if j - i < 2:
                continue
            k = np.cos(np.radians(y[i] / 60))
            dx, dy = (x[j] - x[i]) * k, y[j] - y[i]
            px, py = (x[i + 1 : j] - x[i]) * k, y[i + 1 : j] - y[i]
            length = np.hypot(dx, dy)
            d = np.abs(dx * py - dy * px) / length if length > 0 else np.hypot(px, py)
            if d.max() > tolerance_nm:
                m = i + 1 + int(d.argmax())
                keep[m] = True
                spans += [(i, m), (m, j)]
        return t[keep][["mmsi", "id", "lat", "lon"]]

    return tracks.groupBy("mmsi").applyInPandas(run, "mmsi long, id long, lat double, lon double")


def flag_of(mmsi: Column, table: dict[int, str]) -> Column:
    """The flag of a nine-digit MMSI by its first three digits; others and unknown ones are null."""
    pairs = [x for k, v in sorted(table.items()) for x in (F.lit(k), F.lit(v))]
    return F.when(mmsi.between(100_000_000, 999_999_999), F.try_element_at(F.create_map(*pairs), F.floor(mmsi / 1_000_000).cast("int")))


def gap_factor(tracks: DataFrame) -> DataFrame:
    """Risk from the longest silence and from how many there are; it rises to 1 at just under a day, where the
    next rule starts again at 0.8."""
    g = gaps(tracks, 2.0).groupBy("mmsi").agg(F.max("gap_hours").alias("longest"), F.count(F.lit(1)).alias("n"))
    x = F.col("longest")
    base = F.when(x >= 24, 0.8 + (x - 24) / 120).when(x >= 6, 0.5 + (x - 6) / 36).otherwise(0.15 + (x - 2) / 16)
    return g.select("mmsi", "longest", F.col("n").alias("gaps"), F.least(F.lit(1.0), base + F.when(F.col("n") >= 3, 0.1).otherwise(0.0)).alias("gap"))


def behaviour_factor(summary: DataFrame, segments: DataFrame) -> DataFrame:
    """From shares of time by behaviour, and from how many segments are unsure."""
    share = lambda b: F.coalesce(F.max(F.when(F.col("behaviour") == b, F.col("pct"))), F.lit(0.0)) / 100
    s = summary.groupBy("mmsi").agg(*[share(b).alias(b) for b in ("fishing", "loitering", "maneuvering", "drifting")])
    unsure = segments.groupBy("mmsi").agg(F.avg((F.col("confidence") < 0.4).cast("double")).alias("unsure"))
    part = lambda b, over, score: F.when(F.col(b) > over, score).otherwise(0.0)
    total = part("fishing", 0.3, 0.3) + part("loitering", 0.2, 0.2) + part("maneuvering", 0.3, 0.15) + part("drifting", 0.4, 0.1) + part("unsure", 0.3, 0.1)
    return s.join(unsure, "mmsi", "left").select("mmsi", F.least(F.lit(1.0), total).alias("behaviour"))


def encounter_factor(e: DataFrame) -> DataFrame:
    """From meetings at sea, those of high or critical risk, and how many there are."""
    both = e.select(F.explode(F.array("mmsi_a", "mmsi_b")).alias("mmsi"), "kind", "risk")
    g = both.groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "rendezvous").alias("r"), F.count_if(F.col("risk").isin("high", "critical")).alias("h"))
    steps = lambda c, *of: F.coalesce(*[F.when(F.col(c) >= least, score) for least, score in of], F.lit(0.0))
    return g.select("mmsi", F.least(F.lit(1.0), steps("r", (3, 0.5), (1, 0.25)) + steps("h", (2, 0.3), (1, 0.15)) + steps("n", (5, 0.1))).alias("encounter"))


#: What an alert's severity adds.
SEVERITY = {"info": 0.05, "warning": 0.1, "alert": 0.2, "critical": 0.4}


def geofence_factor(alerts: DataFrame, newest: int = 50) -> DataFrame:
    """The severities of a vessel's newest alerts (mmsi, ts, severity, id) added up."""
    value = F.lit(0.05)
    for name, v in SEVERITY.items():
        value = F.when(F.col("severity") == name, v).otherwise(value)
    last = W.partitionBy("mmsi").orderBy(F.desc("ts"), "id")
    some = alerts.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= newest)
    return some.groupBy("mmsi").agg(F.least(F.lit(1.0), F.sum(value)).alias("geofence"))


#: Names that say nothing.
NO_NAMES = ("UNKNOWN", "TEST", "N/A", "NONE", "DEFAULT", "123456", "VESSEL", "SHIP")


def identity_factor(vessels: DataFrame) -> DataFrame:
    """From vessels (mmsi, flag, imo, ship_type, name, avg_sog): what does not fit of number, flag, name, type and speed."""
    length, kind, sog = F.length(F.col("mmsi").cast("string")), F.col("ship_type"), F.col("avg_sog")
    name = F.upper(F.trim("name"))
    rules = [
        (length != 9, 0.2),
        ((length == 9) & F.col("flag").isNull(), 0.15),
        ((kind >= 60) & (F.coalesce(F.col("imo").cast("string"), F.lit("")) == ""), 0.2),
        ((F.coalesce(F.col("name"), F.lit("")) != "") & (name.isin(*NO_NAMES) | (F.length(name) <= 1)), 0.15),
        ((F.coalesce(F.col("name"), F.lit("")) == "") & (kind >= 30), 0.1),
        ((kind == 30) & (sog > 12), 0.15),
        (kind.isin(70, 71, 72, 73, 74, 79) & (sog < 2) & (sog > 0), 0.1),
    ]
    return vessels.select("mmsi", F.least(F.lit(1.0), sum(F.when(when, score).otherwise(0.0) for when, score in rules)).alias("identity"))


def composite_risk(vessels: DataFrame, factors: dict[str, DataFrame]) -> DataFrame:
    """The weighted mean of all six factors, of 100, and its level; a vessel that a factor does not know scores 0 there (0.5
    for the flag). One plan for the whole fleet."""
    if missing := set(WEIGHTS) - set(factors):
        raise ValueError(f"factors missing: {', '.join(sorted(missing))}")
    for name, f in factors.items():
        vessels = vessels.join(f.select("mmsi", name), "mmsi", "left")
    total = sum(F.coalesce(F.col(n), F.lit(0.5 if n == "flag" else 0.0)) * w for n, w in WEIGHTS.items()) / sum(WEIGHTS.values()) * 100
    out = vessels.select("mmsi", total.alias("risk"))
    return out.withColumn("level", F.when(F.col("risk") >= 75, "critical").when(F.col("risk") >= 50, "high").when(F.col("risk") >= 25, "medium").otherwise("low"))


# Geofences

ALERTS = T.StructType([T.StructField("mmsi", T.LongType()), T.StructField("zone", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("detail", T.DoubleType())])


def contains(zone: dict, lat: float, lon: float) -> bool:
    from math import asin, cos, radians, sin, sqrt

    if zone["kind"] == "circle":
        a = sin(radians(lat - zone["lat"]) / 2) ** 2 + cos(radians(lat)) * cos(radians(zone["lat"])) * sin(radians(lon - zone["lon"]) / 2) ** 2
        return 2 * NM * asin(sqrt(min(a, 1.0))) <= zone["radius_nm"]
    inside, ring = False, zone["ring"]
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside and len(ring) >= 3


def evaluate(zone: dict, state: dict, ts: float, lat: float, lon: float, sog: float | None) -> Iterator[tuple[str, float]]:
    """One fix against one zone's rules; ``state`` is carried from fix to fix, in batch and in streams alike."""
    inside, was, rules = contains(zone, lat, lon), state.get("inside", False), zone["rules"]
    entered, seen = state.get("entered"), state.get("seen")
    if inside and not was:
        if "entry" in rules:
            yield "entry", 0.0
        entered = ts
    if was and not inside and "exit" in rules:
        yield "exit", (ts - entered) / 60 if entered else 0.0
    if inside and "loiter" in rules:
        entered = ts if entered is None else entered
        if (ts - entered) / 60 >= rules["loiter"]:
            yield "loiter", (ts - entered) / 60
            entered = ts
    if inside and "speed" in rules and sog is not None and sog > rules["speed"]:
        yield "speed", sog
    if inside and "silence" in rules and seen is not None and (ts - seen) / 3600 >= rules["silence"]:
        yield "silence", (ts - seen) / 3600
    state.update(inside=inside, entered=entered if inside else None, seen=ts)


def geofence_alerts(tracks: DataFrame, zones: list[dict]) -> DataFrame:
    """All alerts of all vessels, in the order of event time and id; the zones are a list of fixed size."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t, out = t.sort_values(["ts", "id"]), []
        states = [{} for _ in zones]
        for r in t.itertuples():
            for zone, state in zip(zones, states, strict=True):
                if zone.get("mmsi") and r.mmsi not in zone["mmsi"]:
                    continue
                out += [(r.mmsi, zone["name"], rule, r.ts, float(x)) for rule, x in evaluate(zone, state, r.ts.timestamp(), r.lat, r.lon, r.sog)]
        return pd.DataFrame(out, columns=ALERTS.names)

    return tracks.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("mmsi").applyInPandas(run, ALERTS)


def contains_column(zone: dict) -> Column:
    if zone["kind"] == "circle":
        return haversine("lat", "lon", F.lit(zone["lat"]), F.lit(zone["lon"]), NM) <= zone["radius_nm"]
    return in_ring(F.col("lon"), F.col("lat"), zone["ring"])


def zone_states(tracks: DataFrame, zones: list[dict]) -> DataFrame:
    """Of each vessel and zone whether its last fix is inside, since when, and the time of the last fix."""
    order = W.partitionBy("mmsi", "zone").orderBy("ts", "id")
    each = F.explode(F.array(*[F.struct(F.lit(z["name"]).alias("zone"), contains_column(z).alias("inside")) for z in zones])).alias("z")
    t = tracks.select("mmsi", "ts", "id", each).select("mmsi", "ts", "id", "z.*").withColumn("visit", F.sum((~F.col("inside")).cast("int")).over(order))
    last = t.groupBy("mmsi", "zone").agg(F.max_by(F.struct("inside", "visit", "ts"), F.struct("ts", "id")).alias("x"))
    since = t.where("inside").groupBy("mmsi", "zone", "visit").agg(F.min("ts").alias("since"))
    now = last.select("mmsi", "zone", "x.inside", "x.visit", F.col("x.ts").alias("seen"))
    return now.join(since, ["mmsi", "zone", "visit"], "left").select("mmsi", "zone", "inside", F.when(F.col("inside"), F.col("since")).alias("since"), "seen")
