"""Operators that SQL does not check: fixtures with known answers."""

import time
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.common import Scratch, free_name, spread_join
from tidewright.operators import graph as G
from tidewright.operators import olap as O
from tidewright.operators import records as R
from tidewright.operators import rows as X
from tidewright.operators import vessels as V
from tidewright.operators.components import connected_components
from tidewright.plans.vessels import ZONES
from tidewright.sources import connectors as C
from tidewright.streaming import live as L


def test_uuid5(spark):
    df = spark.createDataFrame([("a:1",), ("src1:42",), ("ünï:7",)], "n string").select("n", R.uuid5(F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in df.collect()) or all(r.u == str(uuid.uuid5(uuid.UUID(R.NAMESPACE), r.n)) for r in df.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (201, 202), (202, 200), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 150)}, 201: 200, 202: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).collect() == []


def test_spread_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 60)] + [(None, 0)], "k long, x long")
    right = left.where("k is not null and k < 50").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("y", F.col("k") * 10)
    got = spread_join(left, right, "k", "n", left.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    assert spread_join(left, right, "k", "n", left.count(), "left").count() == left.count()


def fix(k, lat, lon, sog=5.0, minutes=10):
    return (k, 203000001, f"2024-01-01 {k * minutes // 60:02d}:{k * minutes % 60:02d}:00", lat, lon, sog)


def fixes(spark, rows):
    return spark.createDataFrame(rows, "id long, mmsi long, ts string, lat double, lon double, sog double").withColumn("ts", F.col("ts").cast("timestamp"))


ROUTE = [fix(0, 9.0, 21.0), fix(1, 10.5, 21.0), fix(2, 10.5, 21.0), fix(7, 10.5, 21.0), fix(14, 10.5, 21.0, 12.0), fix(30, 10.5, 21.0), fix(31, 14.0, 21.0)]


def test_geofence(spark):
    got = [(r.rule, r.ts.strftime("%H:%M"), r.detail) for r in V.geofence_alerts(fixes(spark, ROUTE), ZONES[:1]).orderBy("ts", "rule").collect()]
    assert got == [("entry", "00:10", 0.0), ("loiter", "01:10", 60.0), ("loiter", "02:20", 70.0), ("loiter", "05:00", 160.0), ("exit", "05:10", 10.0)]


def test_geofence_stream_is_the_batch(spark, tmp_path):
    for i, part in enumerate((ROUTE[:3], ROUTE[3:5], ROUTE[5:])):
        fixes(spark, part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = fixes(spark, ROUTE).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = L.drained(L.geofence_stream(L.cleaned(stream), ZONES), spark, "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, V.geofence_alerts(fixes(spark, ROUTE), ZONES).collect()))


def test_simplified(spark):
    rows = [fix(k, 10 + 0.01 * k, 20.0, minutes=1) for k in range(20)] + [fix(20 + k, 10.19, 20.0 + 0.05 * k, minutes=1) for k in range(1, 10)]
    assert sorted(r.id for r in V.simplified(fixes(spark, rows)).collect()) == [0, 19, 29]


def test_pagerank_of_a_star(spark):
    rank = {r.id: r["rank"] for r in G.pagerank(spark.createDataFrame([("a", x) for x in "bcde"], "source_id string, dest_id string"), rounds=100, tolerance=1e-12).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["a"] == pytest.approx((0.03 + 0.85 * 4 * 0.03) / (1 - 0.85**2)) and rank["b"] == pytest.approx(0.03 + 0.85 * rank["a"] / 4)


def test_connectors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name, VALUE_usd\nx,1\ny,2\n")
    got = C.csv_by_alias(spark, f"{tmp_path}/a.csv", {"name": ["title", "name"], "value": ["value", "value_usd"], "none": ["q"]})
    assert [tuple(r) for r in got.collect()] == [("x", "1", None), ("y", "2", None)]
    (tmp_path / "c.txt").write_text("1950 1951\n 1950 " + " ".join(["1.5"] * 11) + " -99.9\nfoot\n")
    rows = C.climate_table(spark, f"{tmp_path}/c.txt").collect()
    assert len(rows) == 11 and rows[0].ts.day == 15 and rows[10].ts.month == 11
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>A</title><link>l</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><description>&lt;b&gt;x&lt;/b&gt; y</description></item><item><title>B</title></item></channel></rss>")
    got = {r.title: r for r in C.rss_items(spark, f"{tmp_path}/r.xml").collect()}
    assert got["A"].published.hour == 3 and got["A"].summary == "x  y" and got["B"].published is None
    g = spark.createDataFrame([([1.0, 2.0], [10.0, 20.0, 30.0], [1.0, 2.0, float("nan"), 4.0, 5.0, 6.0])], "lat array<double>, lon array<double>, sst array<double>")
    assert sorted(map(tuple, C.gridded(g, "sst", ["lat", "lon"]).collect())) == [(1.0, 10.0, 1.0), (1.0, 20.0, 2.0), (2.0, 10.0, 4.0), (2.0, 20.0, 5.0), (2.0, 30.0, 6.0)]


def pages(n):
    return [(f"{n}-{i}", "2024-01-01", "{}") for i in range(3)]


def test_paged_source(spark):
    spark.dataSource.register(C.PagedSource)
    df = spark.read.format("paged").option("fetch", "tests.test_operators:pages").option("pages", 4).load()
    assert df.count() == 12


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return [1]

    assert C.fetched(flaky, pause=0) == [1] and len(calls) == 3


def test_encounter_survives_a_missing_mark(spark):
    rows = [(1, m, 10.0, 20.0) for m in range(6)] + [(2, m, 10.0, 20.01) for m in (0, 1, 2, 4, 5)] + [(1, 6, 10.0, 20.0), (2, 6, 15.0, 20.0), (1, 7, 10.0, 20.0), (2, 7, 10.0, 20.0)]
    near = spark.createDataFrame(rows, "mmsi long, mark long, lat double, lon double").select("*", F.lit(1.0).alias("sog"), F.lit(0.0).alias("cog"), F.lit(None).cast("timestamp").alias("ts"))
    got = V.encounters(near, 2.0, 10.0).collect()
    assert [(r.first_mark, r.last_mark, r.kind) for r in got] == [(0, 5, "rendezvous")]


@pytest.mark.parametrize("y, x", [(10.9, 20.9), (84.5, 20.5), (-0.1, 179.95)])
def test_sessions_are_those_of_all_pairs(spark, y, x):
    """Tracks that cross cells, far north and over the date line, with marks and speeds missing."""
    from math import asin, cos, radians, sin, sqrt

    rng, rows, want = np.random.default_rng(5), [], {}
    for mmsi in range(9):
        lat, lon = y, x
        for mark in range(25):
            lat, lon = lat + rng.normal() * 0.03, lon + rng.normal() * 0.03 / cos(radians(y))
            if rng.random() < 0.85:
                rows.append((mmsi, mark, lat, (lon + 180) % 360 - 180, None if rng.random() < 0.1 else float(rng.random() * 5), float(rng.random() * 360), datetime(2024, 1, 1) + timedelta(seconds=300 * mark + mmsi)))
    at = {r[:2]: r for r in rows}

    def miles(p, q):
        h = sin(radians(q[2] - p[2]) / 2) ** 2 + cos(radians(p[2])) * cos(radians(q[2])) * sin(radians(q[3] - p[3]) / 2) ** 2
        return 2 * 3440.065 * asin(sqrt(min(h, 1.0)))

    for a in range(9):
        for b in range(a + 1, 9):
            runs = [[]]
            for m in range(25):
                if (a, m) in at and (b, m) in at:
                    p, q = at[a, m], at[b, m]
                    runs = [*runs, []] if miles(p, q) > 6.0 else [*runs[:-1], [*runs[-1], (m, miles(p, q), p, q)]]
            for run in runs:
                if run and (run[-1][0] - run[0][0]) * 5 >= 10:
                    fast = [r[3][4] for r in run if r[3][4] is not None]
                    want[a, b, run[0][0]] = (run[-1][0], len(run), min(r[1] for r in run), sum(abs((r[2][5] - r[3][5] + 180) % 360 - 180) for r in run) / len(run), sum(fast) / len(fast) if fast else None)
    near = spark.createDataFrame(rows, "mmsi long, mark long, lat double, lon double, sog double, cog double, ts timestamp")
    got = V.encounters(near, 6.0, 10.0).collect()
    assert len(got) == len(want) > 10
    for r in got:
        last, marks, least, turn, fast = want[r.mmsi_a, r.mmsi_b, r.first_mark]
        assert (r.last_mark, r.marks) == (last, marks) and r.sog_b == pytest.approx(fast) and r.min_nm == pytest.approx(least, abs=1e-6) and r.cog_apart == pytest.approx(turn)


def test_capped_components(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)], "source_id string, dest_id string")
    near = {r.id: r.label for r in G.min_label_components(edges, 10).collect()}
    assert near["n10"] == "n00" and near["n11"] == "n01" and near["n12"] == "n02"
    assert set(r.label for r in G.min_label_components(edges, 12).collect()) == {"n00"}


def test_f_tail():
    # From tables: the 5 % and 1 % points.
    for f, a, b, p in ((4.351, 1, 20, 0.05), (2.711, 5, 20, 0.05), (8.096, 1, 20, 0.01), (1.0, 10, 10, 0.5), (0.0, 3, 9, 1.0)):
        assert O.f_tail(f, a, b) == pytest.approx(p, abs=2e-4)


def test_granger_against_least_squares(spark):
    rng = np.random.default_rng(4)
    n, start = 120, datetime(2024, 1, 1)
    x = rng.normal(size=n)
    y = np.concatenate([[0.0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=n)
    rows = [(c, start + timedelta(days=i), float(v[i])) for c, v in (("x", x), ("y", y)) for i in range(n)]
    got = {(r.cause, r.effect, r["lag"]): r for r in O.granger(spark.createDataFrame(rows, "code string, day timestamp_ntz, value double"), (1, 3)).collect()}

    def plain(a, b, p):
        own = np.column_stack([np.ones(n - p), *[b[p - k : n - k] for k in range(1, p + 1)]])
        both = np.column_stack([own, *[a[p - k : n - k] for k in range(1, p + 1)]])
        rest = [float(((b[p:] - m @ np.linalg.lstsq(m, b[p:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
        return (rest[0] - rest[1]) / p / (rest[1] / (n - p - 2 * p - 1))

    for p in (1, 3):
        assert got["x", "y", p].f == pytest.approx(plain(x, y, p), rel=1e-6) and got["x", "y", p].significant
        assert got["y", "x", p].f == pytest.approx(plain(y, x, p), rel=1e-6, abs=1e-9) and not got["y", "x", p].significant
    assert O.granger(spark.createDataFrame([], "code string, day timestamp_ntz, value double")).collect() == []


def test_forecast_against_a_plain_fold(spark):
    v = [float(10 + i % 5 + i * 0.2) for i in range(45)]
    rows = [("c", datetime(2024, 1, 1) + timedelta(days=i), x) for i, x in enumerate(v)]
    got = O.smoothing_forecast(spark.createDataFrame(rows, "code string, day timestamp_ntz, value double"), 3).orderBy("step").collect()
    level, sq = v[0], 0.0
    for x in v[1:]:
        level = 0.3 * x + 0.7 * level
        sq += (x - level) ** 2
    drift, sigma = (v[-1] - v[-30]) / 29, (sq / (len(v) - 1)) ** 0.5
    for k, r in enumerate(got, 1):
        assert r.forecast == pytest.approx(level + drift * k) and r.high - r.forecast == pytest.approx(1.96 * sigma * k**0.5) and r.day == datetime(2024, 1, 1) + timedelta(days=44 + k)


def test_a_series_is_folded_whole(spark):
    daily = spark.range(1_100_000).select(F.lit("c").alias("code"), (F.lit("1000-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("day"), F.when(F.col("id") > 1_050_000, 5.0).otherwise(F.col("id") % 2).cast("double").alias("value"))
    last = O.cusum(daily, sensitivity=0.001).agg(F.max("day")).first()[0]
    assert last > datetime(1000, 1, 1) + timedelta(minutes=1_050_000)


def test_unknown_periods_are_errors():
    with pytest.raises(ValueError, match="period must be one of"):
        O.period_of("ts", "fortnight")


def test_short_tracks_are_one_window(spark):
    rows = [(1, 5, datetime(2024, 1, 1), 0.0, 0.0, 0.1, 5.0), (2, 6, datetime(2024, 1, 1), 0.0, 0.0, 9.0, 5.0), (3, 6, datetime(2024, 1, 1, 2), 0.2, 0.2, 9.0, 5.0)]
    w = V.windows(spark.createDataFrame(rows, "id long, mmsi long, ts timestamp_ntz, lat double, lon double, sog double, cog double"))
    got = {r.mmsi: r for r in V.classified(V.features(w)).collect()}
    assert (got[5].behaviour, got[5].confidence, got[5].points) == ("unknown", 0.0, 1) and (got[6].behaviour, got[6].points) == ("transiting", 2)


@pytest.mark.parametrize(
    ("row", "kind", "risk", "confidence"),
    [
        ((1.0, 1.0, 0.05, 90.0, 61.0, 9), "rendezvous", "critical", 0.95),
        ((1.0, 2.9, 0.5, 0.0, 10.0, 3), "rendezvous", "medium", 0.7),
        ((10.0, 9.0, 0.1, 5.0, 50.0, 9), "parallel_transit", "medium", 0.6),
        ((10.0, 9.0, 0.5, 50.0, 20.0, 9), "crossing", "low", 0.4),
        ((10.0, 9.0, 0.5, 50.0, 40.0, 9), "unknown", "low", 0.3),
    ],
)
def test_kinds_of_meetings(spark, row, kind, risk, confidence):
    r = V.meeting_kind(spark.createDataFrame([row], "sog_a double, sog_b double, min_nm double, cog_apart double, seen_minutes double, marks int")).first()
    assert (r.kind, r.risk) == (kind, risk) and r.confidence == pytest.approx(confidence)


def test_a_composite_needs_every_factor(spark):
    one = lambda name, v: spark.createDataFrame([(1, v)], f"mmsi long, {name} double")
    factors = {name: one(name, 1.0) for name in V.WEIGHTS}
    vessels = spark.createDataFrame([(1,), (2,)], "mmsi long")
    got = {r.mmsi: (round(r.risk, 6), r.level) for r in V.composite_risk(vessels, factors).collect()}
    assert got == {1: (100.0, "critical"), 2: (7.5, "low")}
    with pytest.raises(ValueError, match="factors missing: gap"):
        V.composite_risk(vessels, {k: v for k, v in factors.items() if k != "gap"})
    alerts = spark.createDataFrame([(1, i, "critical" if i == 0 else "info", "x") for i in range(60)], "mmsi long, ts int, severity string, id string")
    assert V.geofence_factor(alerts).first().geofence == 1.0
    assert V.geofence_factor(alerts.where("ts < 4")).first().geofence == pytest.approx(0.55)


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.range(400).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    with pytest.raises(RuntimeError, match="not settled"):
        connected_components(chain, Scratch(spark, "t"), max_rounds=2)


def test_one_failing_detector_stops_no_other(spark):
    def bad():
        raise RuntimeError("no data")

    out, failed = X.full_scan({"a": lambda: spark.createDataFrame([("HIGH",)], "severity string"), "b": bad})
    assert [tuple(r) for r in out.collect()] == [("a", "HIGH", 1)] and failed == {"b": "no data"}
    assert X.backfilled({"a": lambda: 3, "b": bad}) == {"a": 3, "b": "failed: no data"}


def test_names_that_are_free():
    assert free_name(["__X", "__x_"], "__x") == "__x__" and free_name([], "a") == "a"


def test_late_rows_are_dropped_and_repeated_ones_count_once(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    batches = [[(1, at(8, 5), "a", 1.0), (1, at(8, 5), "a", 1.0), (2, at(12, 0), "a", 1.0)], [(4, at(11, 55), "a", 1.0), (5, at(15, 0), "a", 1.0)], [(3, at(8, 10), "a", 1.0), (6, at(15, 5), "a", 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.02)
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "10 minutes")
    got = sorted((r.period.hour, r.n) for r in L.drained(L.windowed_counts(stream), spark, "append").collect())
    assert got == [(8, 2), (11, 1), (12, 1)]  # the row of 8:10 came too late; the window of 15 is still open
    seen = sorted(r.event_id for r in L.drained(L.once(stream), spark, "append").collect())
    assert seen == [1, 2, 4, 5, 6]


def test_vessel_identity_makes_no_pair_to_drop_it(spark):
    from tidewright.operators import rows as X

    rows = [(i, f"AIS-{i % 3}", f"v-{i % 7}" if i % 11 else None, "{}") for i in range(400)] + [(5, "AIS-1", "v-5", "{}"), (5, "AIS-9", "v-5", "{}"), (None, "AIS-1", "v-5", "{}")]
    df = spark.createDataFrame(rows, "id long, source_name string, identifier string, payload string")
    known = [(i, s, v[2:]) for i, s, v, _ in rows if v and i is not None]
    want = sorted((a, b, m) for a, s, m in known for b, t, n in known if m == n and a < b and s != t)
    out = X.identity_edges(df, block=10)
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ids_a" in plan and "NOT (source_a" not in plan  # rows of one MMSI met in one task, those of one source as well


def test_entities_met_often_are_paired_without_a_shuffle_of_pairs(spark):
    from tidewright.operators import rows as X

    seen = [((i * i * 31 + i) % 40, str(i * 7 % 1300)) for i in range(6000)] + [(None, "1"), (3, None)]
    df = spark.createDataFrame(seen, "at long, id string")
    at = {}
    for k, i in seen:
        if k is not None and i is not None:
            at.setdefault(k, set()).add(i)
    want = {(a, b) for x in at.values() for a in x for b in x if a < b}
    for sparse in (0.0, 1e9):
        out = X.met_pairs(df, sparse=sparse)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want
    assert "Join" in out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in X.met_pairs(df)._jdf.queryExecution().executedPlan().toString()


def test_ancestry_reads_edges_once_a_round_and_ends_at_the_top(spark):
    from tidewright.operators import records as R

    edges = [(f"n{i + 1}", f"n{i}") for i in range(14)] + [("n2", "n0"), ("m", "n1"), ("n0", "m"), (None, "n1"), ("n1", "n0"), ("z", "y")]
    df = spark.createDataFrame(edges, "parent_id string, child_id string")
    for depth in (1, 3, 10):
        want, front = {}, {e for e in edges if e[1] == "n0"}
        for d in range(depth):
            for e in front:
                want.setdefault(e, d)
            front = {e for e in edges if e[1] in {p for p, _ in front}}
        out = R.ancestry(df, "n0", depth)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) and {(p, c): d for p, c, d in got} == want
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()  # a join for each step to each depth, 45 in all
    assert R.ancestry(df, "top").collect() == []
