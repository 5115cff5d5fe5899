"""Roll-ups, windows and statistics over time series, entities, flows, events, assessments, claims and observations.

Each operator takes the tables it needs and returns a lazy frame. Groups add up with map-side aggregation; windows
are partitioned by the series unless the question is about one series, whose points are then one partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERIODS = ("hour", "day", "week", "month", "quarter", "year")


def period_of(ts: str, period: str) -> Column:
    """The start of the period; an unknown period is an error."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {', '.join(PERIODS)}")
    return F.date_trunc(period, F.col(ts)).cast("timestamp_ntz").alias("period")


def conjunction(df: DataFrame, start=None, end=None, **equal) -> DataFrame:
    """Optional filters, all inclusive; None leaves a filter out."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df


def ts_rollup(ts: DataFrame, period: str = "month") -> DataFrame:
    g = ts.groupBy(period_of("ts", period), "code", "commodity", "country")
    return g.agg(F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("n"))


def series(ts: DataFrame, code: str) -> DataFrame:
    return ts.where(F.col("code") == code)


def ts_moving_average(ts: DataFrame, code: str, window: int = 7) -> DataFrame:
    w = W.partitionBy("code").orderBy("ts", "id").rowsBetween(-(window - 1), 0)
    return series(ts, code).select("id", "ts", "value", F.avg("value").over(w).alias("moving_avg"), F.stddev_pop("value").over(w).alias("moving_std"))


def monthly(ts: DataFrame, code: str) -> DataFrame:
    return series(ts, code).groupBy(period_of("ts", "month")).agg(F.avg("value").alias("avg_value"))


def ts_yoy_change(ts: DataFrame, code: str, rows: int = 12) -> DataFrame:
    """Against the row twelve rows before, whatever months are missing."""
    before = F.lag("avg_value", rows).over(W.orderBy("period"))
    m = monthly(ts, code).withColumn("prior", before)
    return m.select("period", "avg_value", "prior", F.when(F.col("prior") != 0, (F.col("avg_value") - F.col("prior")) / F.nullif("prior", F.lit(0.0)) * 100).alias("yoy_pct"))


def ts_volatility(ts: DataFrame, code: str, window: int = 30) -> DataFrame:
    order = W.partitionBy("code").orderBy("ts", "id")
    roll = order.rowsBetween(-(window - 1), 0)
    before = F.lag("value").over(order)
    r = series(ts, code).withColumn("pct_return", (F.col("value") - before) / F.nullif(before, F.lit(0.0)))
    return r.select("id", "ts", "value", "pct_return", F.stddev_pop("value").over(roll).alias("value_volatility"), F.stddev_pop("pct_return").over(roll).alias("return_volatility"))


def ts_correlation(ts: DataFrame, a: str, b: str, start=None, end=None) -> DataFrame:
    ts = conjunction(ts, start, end)
    x, y = monthly(ts, a).withColumnRenamed("avg_value", "a"), monthly(ts, b).withColumnRenamed("avg_value", "b")
    return x.join(y, "period").agg(F.corr("a", "b").alias("correlation"), F.regr_slope("a", "b").alias("slope"), F.regr_r2("a", "b").alias("r2"), F.count(F.lit(1)).alias("n"))


def ts_trend(ts: DataFrame, code: str, window: int = 5) -> DataFrame:
    h = window // 2
    m = monthly(ts, code).withColumn("rn", F.row_number().over(W.orderBy("period")).cast("double"))
    m = m.withColumns({"trend": F.avg("avg_value").over(W.orderBy("period").rowsBetween(-h, h)), "slope": F.regr_slope("avg_value", "rn").over(W.partitionBy())})
    return m.select("period", "avg_value", "trend", (F.col("avg_value") - F.col("trend")).alias("residual"), "slope")


def ts_zscore(ts: DataFrame, window: int = 30, threshold: float = 2.5) -> DataFrame:
    """Points far from the ``window`` points before them, per code."""
    order = W.partitionBy("code").orderBy("ts", "id")
    prior = order.rowsBetween(-window, -1)
    z = (F.col("value") - F.avg("value").over(prior)) / F.nullif(F.stddev_pop("value").over(prior), F.lit(0.0))
    out = ts.withColumns({"rn": F.row_number().over(order), "z": z}).where((F.col("rn") > window) & (F.abs("z") >= threshold))
    return out.select("id", "code", "ts", "value", F.round("z", 3).alias("z_score"), F.when(F.col("z") > 0, "spike").otherwise("drop").alias("direction"))


def zscore_scan(ts: DataFrame, window: int = 30, threshold: float = 2.5) -> DataFrame:
    """As above with the point in its own window, and a severity."""
    roll = W.partitionBy("code").orderBy("ts", "id").rowsBetween(-(window - 1), 0)
    z = (F.col("value") - F.avg("value").over(roll)) / F.nullif(F.stddev_pop("value").over(roll), F.lit(0.0))
    size = F.abs("z_score")
    out = ts.withColumn("z_score", z).where(size >= threshold)
    return out.select("id", "code", "ts", "value", "z_score", F.when(size >= 5, "CRITICAL").when(size >= 4, "HIGH").otherwise("MEDIUM").alias("severity"))


def anomaly_map(ts: DataFrame, window: int = 30, threshold: float = 2.5) -> DataFrame:
    return zscore_scan(ts, window, threshold).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("z_score")).alias("worst"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def cusum(daily: DataFrame, sensitivity: float = 0.5, least: int = 30) -> DataFrame:
    """Change points of each code's daily series: both one-sided sums of z less a slack of 0.5, from the second
    point on; a sum over sensitivity times the length fires and both start anew. One fold over the sorted days."""
    s = daily.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("points"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n"))
    s = s.where((F.col("n") >= least) & (F.col("sd") > 0)).withColumn("limit", F.lit(sensitivity) * F.col("n"))
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast("array<struct<day:timestamp_ntz,direction:string,size:double>>").alias("found"))

    def step(acc, p):
        z = (p["value"] - F.col("mean")) / F.col("sd")
        up, down = F.greatest(F.lit(0.0), acc["up"] + z - 0.5), F.greatest(F.lit(0.0), acc["down"] - z - 0.5)
        fired = (up > F.col("limit")) | (down > F.col("limit"))
        hit = F.struct(p["day"].alias("day"), F.when(up > F.col("limit"), "increase").otherwise("decrease").alias("direction"), F.greatest(up, down).alias("size"))
        return F.struct(F.when(fired, 0.0).otherwise(up).alias("up"), F.when(fired, 0.0).otherwise(down).alias("down"), F.when(fired, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    s = s.select("code", F.explode(F.aggregate(F.slice("points", 2, F.size("points")), start, step)["found"]).alias("f"))
    return s.select("code", "f.day", "f.direction", F.col("f.size").alias("cusum"))


def daily_series(ts: DataFrame) -> DataFrame:
    return ts.where("value is not null").groupBy("code", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.avg("value").alias("value"))


def smoothing_forecast(daily: DataFrame, horizon: int = 7, alpha: float = 0.3, least: int = 10) -> DataFrame:
    """Exponential smoothing of each code's days, drift over the last 30, and a band of 1.96 residual deviations."""
    s = daily.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "value"))), lambda p: p["value"]).alias("v"), F.max("day").alias("last")).where(F.size("v") >= least)
    start = F.struct(F.get("v", F.lit(0)).alias("level"), F.lit(0.0).alias("sq"))

    def step(acc, x):
        level = alpha * x + (1 - alpha) * acc["level"]
        return F.struct(level.alias("level"), (acc["sq"] + (x - level) * (x - level)).alias("sq"))

    s = s.withColumn("acc", F.aggregate(F.slice("v", 2, F.size("v")), start, step)).withColumn("back", F.least(F.size("v"), F.lit(30)))
    first = F.get(F.col("v"), F.size("v") - F.col("back"))
    s = s.select("code", "last", F.col("acc.level").alias("level"), F.sqrt(F.col("acc.sq") / (F.size("v") - 1)).alias("sigma"), ((F.element_at("v", -1) - first) / (F.col("back") - 1)).alias("drift"))
    s = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    mid, band = F.col("level") + F.col("drift") * F.col("step"), 1.96 * F.col("sigma") * F.sqrt("step")
    day = (F.col("last") + F.make_dt_interval(days=F.col("step"))).cast("timestamp_ntz").alias("day")
    return s.select("code", day, "step", mid.alias("forecast"), (mid - band).alias("low"), (mid + band).alias("high"))


def lagged_correlation(daily: DataFrame, lags=(0, 7, 14, 30, 60, 90), least: int = 20) -> DataFrame:
    """Pearson's correlation of each pair of codes with the second taken ``lag`` days later."""
    a = daily.select(F.col("code").alias("code_a"), "day", F.col("value").alias("a"))
    b = daily.select(F.col("code").alias("code_b"), F.col("day").alias("day_b"), F.col("value").alias("b"))
    a = a.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn("day_b", (F.col("day") + F.make_dt_interval(days=F.col("lag"))).cast("timestamp_ntz"))
    j = a.join(b, "day_b").where("code_a < code_b").groupBy("code_a", "code_b", "lag")
    return j.agg(F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def heatwaves(daily: DataFrame, quantile: float = 0.9, run: int = 5, least: int = 30) -> DataFrame:
    """Runs of at least ``run`` points above the element at ``quantile`` of the sorted values, per code."""
    by = W.partitionBy("code")
    n = F.count(F.lit(1)).over(by)
    s = daily.withColumns({"n": n, "mean": F.avg("value").over(by), "rank": F.row_number().over(by.orderBy("value", "day")), "rn": F.row_number().over(by.orderBy("day"))})
    s = s.withColumn("threshold", F.max(F.when(F.col("rank") == F.floor(F.col("n") * quantile) + 1, F.col("value"))).over(by))
    hot = s.where((F.col("n") >= least) & (F.col("value") > F.col("threshold")))
    hot = hot.withColumn("island", F.col("rn") - F.row_number().over(by.orderBy("day")))
    g = hot.groupBy("code", "island").agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count(F.lit(1)).alias("days"), F.max(F.col("value") - F.col("mean")).alias("max_intensity"), F.avg(F.col("value") - F.col("mean")).alias("mean_intensity"))
    return g.where(F.col("days") >= run).drop("island")


def pair_overlap(daily: DataFrame, least: int = 20) -> DataFrame:
    a = daily.select(F.col("code").alias("code_a"), "day")
    b = daily.select(F.col("code").alias("code_b"), "day")
    return a.join(b, "day").where("code_a < code_b").groupBy("code_a", "code_b").agg(F.count(F.lit(1)).alias("overlap_days")).where(F.col("overlap_days") >= least)


def discovered_pairs(ts: DataFrame, least: int = 20, limit: int = 200) -> DataFrame:
    """Pairs of series (code, source, commodity, country) of different sources with at least ``least`` points each and as many
    days in common: the ``limit`` pairs with the most points, ranked by days in common."""
    key = ["code", "source_name", "commodity", "country"]
    days = ts.where("value is not null").groupBy(*key, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    named = days.withColumn("series", F.concat_ws("|", *key))
    many = named.groupBy("series").agg(F.sum("n").alias("points")).where(F.col("points") >= least)
    held = named.select("series", F.col("source_name").alias("source"), "day").join(F.broadcast(many), "series")
    a, b = (held.select("day", *[F.col(c).alias(f"{c}_{x}") for c in ("series", "source", "points")]) for x in "ab")
    met = a.join(b, "day").where("series_a < series_b and source_a <> source_b")
    g = met.groupBy("series_a", "series_b").agg(F.count(F.lit(1)).alias("overlap_days"), F.max(F.col("points_a") + F.col("points_b")).alias("points")).where(F.col("overlap_days") >= least)
    first = g.orderBy(F.desc("points"), "series_a", "series_b").limit(limit)
    return first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("overlap_days"), "series_a", "series_b")))


def aligned(observations: DataFrame, ts: DataFrame, period: str = "day") -> DataFrame:
    a = observations.groupBy(period_of("ts", period)).agg(F.avg("quality").alias("avg_quality"))
    b = ts.groupBy(period_of("ts", period)).agg(F.avg("value").alias("avg_value"))
    return a.join(b, "period")


def aligned_correlation(both: DataFrame) -> DataFrame:
    """Pearson's correlation of what ``aligned`` gives, null for fewer than two pairs or where one side does not vary."""
    pairs = both.where("avg_quality is not null and avg_value is not null")
    flat = (F.stddev_pop("avg_quality") == 0) | (F.stddev_pop("avg_value") == 0)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 2) & ~flat, F.corr("avg_quality", "avg_value")).alias("r"))


def granger(daily: DataFrame, lags: tuple[int, ...] = (1, 3, 7, 14), least: int = 34) -> DataFrame:
    """For each ordered pair of codes and each number of lags, whether the cause's past days better the effect's forecast by its
    own: the F test of the two least squares fits over the days that both have, and its p value.

    Lagged columns and the sums of their products are windows and aggregates; only a matrix a pair and lag is solved in Python.
    """
    a, b = (daily.select(F.col("code").alias(f"code_{x}"), "day", F.col("value").alias(x)) for x in "ab")
    both = a.join(b, "day").where("code_a <> code_b").select(F.col("code_a").alias("cause"), F.col("code_b").alias("effect"), "day", "a", "b")
    order = W.partitionBy("cause", "effect").orderBy("day")
    most = max(lags)
    wide = both.withColumns({f"b{k}": F.lag("b", k).over(order) for k in range(1, most + 1)} | {f"a{k}": F.lag("a", k).over(order) for k in range(1, most + 1)} | {"n": F.count(F.lit(1)).over(W.partitionBy("cause", "effect"))})
    out = None
    for p in lags:
        cols = ["one", *[f"b{k}" for k in range(1, p + 1)], *[f"a{k}" for k in range(1, p + 1)], "b"]
        rows = wide.where((F.col("n") >= least) & F.col(f"b{p}").isNotNull()).withColumn("one", F.lit(1.0))
        products = F.array(*[F.sum(F.col(x) * F.col(y)) for i, x in enumerate(cols) for y in cols[: i + 1]])
        g = rows.groupBy("cause", "effect").agg(products.alias("m"), F.count(F.lit(1)).alias("rows")).withColumn("lag", F.lit(p))
        out = g if out is None else out.unionByName(g)

    @F.pandas_udf("f double, p double")
    def test(m: pd.Series, lag: pd.Series, rows: pd.Series) -> pd.DataFrame:
        found = []
        for flat, p, n in zip(m, lag, rows, strict=True):
            size = 2 * p + 2
            full = np.zeros((size, size))
            full[np.tril_indices(size)] = flat
            full = full + np.tril(full, -1).T

            def rest(keep: list[int], full: np.ndarray = full) -> float:
                x, y = full[np.ix_(keep, keep)], full[keep, -1]
                return float(full[-1, -1] - y @ np.linalg.lstsq(x, y, rcond=None)[0])

            free = n - 2 * p - 1
            fewer, more = rest(list(range(p + 1))), rest(list(range(2 * p + 1)))
            f = max((fewer - more) / p / (more / free), 0.0) if free > 0 and more > 1e-9 else None
            found.append((f, None if f is None else f_tail(f, p, free)))
        return pd.DataFrame(found, columns=["f", "p"], dtype="float64")

    scored = out.withColumn("t", test("m", "lag", "rows"))
    return scored.select("cause", "effect", "lag", "rows", F.col("t.f").alias("f"), F.col("t.p").alias("p"), (F.col("t.p") < 0.05).alias("significant"))


def f_tail(f: float, a: int, b: int) -> float:
    """How likely an F value of at least ``f`` is by chance, for a and b degrees of freedom: the incomplete beta function
    by its continued fraction."""
    from math import exp, lgamma, log

    def fraction(x: float, p: float, q: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / (max(abs(1 - (p + q) * x / (p + 1)), tiny) * (1 if 1 - (p + q) * x / (p + 1) >= 0 else -1))
        h = d
        for m in range(1, 500):
            for up in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / ((1 + up * d) or tiny), (1 + up / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    x, p, q = b / (b + a * f), b / 2, a / 2
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * log(x) + q * log(1 - x))
    return front * fraction(x, p, q) / p if x < (p + 1) / (p + q + 2) else 1 - front * fraction(1 - x, q, p) / q


# Entities, flows


def distribution(entities: DataFrame, by: str = "entity_type") -> DataFrame:
    """``by`` is one of a fixed list, else the first of it."""
    by = by if by in ("entity_type", "country", "sector") else "entity_type"
    return entities.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree in one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dest_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def connectivity(entities: DataFrame, edges: DataFrame) -> DataFrame:
    d = entities.select("id", "name").join(degrees(edges), "id", "left")
    out, into = F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0))
    return d.select("id", "name", out.alias("out_degree"), into.alias("in_degree"), (out + into).alias("total_degree"))


def cell(df: DataFrame, res: float) -> DataFrame:
    return df.withColumns({"cell_lat": F.floor(F.col("lat") / res).cast("double") * res, "cell_lon": F.floor(F.col("lon") / res).cast("double") * res})


def density(df: DataFrame, res: float = 5.0, least: int = 1) -> DataFrame:
    return cell(df.where("lat is not null and lon is not null"), res).groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def trade_balance(flows: DataFrame, entities: DataFrame) -> DataFrame:
    src = entities.select(F.col("id").alias("source_id"), F.col("country").alias("source_country"))
    dst = entities.select(F.col("id").alias("dest_id"), F.col("country").alias("dest_country"))
    j = flows.join(src, "source_id", "left").join(dst, "dest_id", "left")
    return j.groupBy("source_country", "dest_country", "commodity", "currency").agg(F.round(F.sum("amount"), 2).alias("total_amount"), F.count(F.lit(1)).alias("n"))


def top_flows(flows: DataFrame, n: int = 20, flow_type: str | None = None) -> DataFrame:
    f = flows.where("amount is not null")
    if flow_type:
        f = f.where(F.col("flow_type") == flow_type)
    return f.orderBy(F.desc("amount"), "id").limit(n).select("id", "flow_type", "source_id", "dest_id", "amount", "commodity")


def network_stats(edges: DataFrame) -> DataFrame:
    d = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"))
    return d.select("nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce(F.col("edges").cast("double") / F.nullif("nodes", F.lit(0)), F.lit(0.0)).alias("avg_degree"))


# Events, assessments, claims, relationships


def event_frequency(events: DataFrame, period: str = "day", kind: str = "event_type") -> DataFrame:
    return events.groupBy(period_of("ts", period), kind).agg(F.count(F.lit(1)).alias("n"))


def severity_trend(events: DataFrame, period: str = "week") -> DataFrame:
    q = [F.percentile("impact", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95)]
    return events.where("impact is not null").groupBy(period_of("ts", period)).agg(F.count(F.lit(1)).alias("n"), F.avg("impact").alias("avg_impact"), *q)


def event_correlation(events: DataFrame, ts: DataFrame, code: str, period: str = "day") -> DataFrame:
    e = events.groupBy(period_of("ts", period)).agg(F.count(F.lit(1)).alias("event_count"), F.avg("impact").alias("avg_impact"))
    v = series(ts, code).groupBy(period_of("ts", period)).agg(F.avg("value").alias("avg_value"))
    return e.join(v, "period", "full_outer").withColumn("correlation", F.corr("event_count", "avg_value").over(W.partitionBy()))


def score_distribution(a: DataFrame) -> DataFrame:
    q = [F.percentile("score", p).alias(n) for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    return a.groupBy("metric_code", "assessor").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("lo"), F.max("score").alias("hi"), *q)


def latest_ranking(a: DataFrame, metric: str, limit: int = 50) -> DataFrame:
    last = a.where(F.col("metric_code") == metric).groupBy("entity_id").agg(F.max(F.struct("ts", "id", "score")).alias("x"))
    return last.select("entity_id", "x.ts", "x.score").orderBy(F.desc("score"), "entity_id").limit(limit)


def assessment_trend(a: DataFrame) -> DataFrame:
    return a.where("ts is not null and score is not null").groupBy(period_of("ts", "month"), "entity_id", "assessor").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n"))


def claim_delivery(c: DataFrame) -> DataFrame:
    g = c.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("progress").alias("avg_progress"), F.count_if(F.col("progress") >= 100).alias("delivered"))
    return g.withColumn("share", F.col("n").cast("double") / F.sum("n").over(W.partitionBy()))


def claim_deadlines(c: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    g = c.groupBy(period_of("deadline", "month"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("deadline") < now) & (F.col("progress") < 100)).alias("overdue"), F.count_if(F.col("progress") >= 100).alias("completed"), F.avg("progress").alias("avg_progress"))


def claim_gaps(c: DataFrame, as_of: str) -> DataFrame:
    days = F.datediff(F.col("deadline").cast("date"), F.lit(as_of).cast("date"))
    return c.select("id", "claimant_id", F.when(F.col("target_value") > 0, F.col("target_value") * (1 - F.col("progress") / 100)).alias("remaining"), days.cast("long").alias("days_left"))


def type_distribution(r: DataFrame) -> DataFrame:
    return r.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("sources"), F.countDistinct("dest_id").alias("targets"))


# Observations


def source_coverage(o: DataFrame) -> DataFrame:
    return o.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("event_type").alias("types"))


def cluster_summary(o: DataFrame, res: float = 5.0, least: int = 5) -> DataFrame:
    g = cell(o, res).groupBy("cell_lat", "cell_lon")
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_name").alias("sources"), F.countDistinct("event_type").alias("types")).where(F.col("n") >= least)


def relative_density(o: DataFrame, res: float = 5.0) -> DataFrame:
    d = density(o, res)
    top = F.broadcast(d.agg(F.max("n").alias("most")))
    return d.crossJoin(top).select("cell_lat", "cell_lon", "n", (F.col("n").cast("double") / F.col("most")).alias("relative"))


def density_surface(o: DataFrame, res: float = 5.0) -> DataFrame:
    g = cell(o, res).groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("avg_quality"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("source_name").alias("sources"))
    top = F.broadcast(density(o, res).agg(F.max("n").alias("most")))
    return g.crossJoin(top).select("cell_lat", "cell_lon", "n", (F.col("n").cast("double") / F.col("most")).alias("relative"), F.round("avg_quality", 9).alias("avg_quality"), "first_ts", "last_ts", "sources")


def in_box(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def latest_positions(tracks: DataFrame) -> DataFrame:
    last = tracks.groupBy("mmsi").agg(F.max(F.struct("ts", "id", "lat", "lon", "sog", "cog")).alias("x"))
    return last.select("mmsi", "x.*")


def active_vessels(tracks: DataFrame, n: int = 50) -> DataFrame:
    return tracks.groupBy("mmsi").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("last_seen"), "mmsi").limit(n)


def density_alerts(o: DataFrame, km: float = 500.0, threshold: float = 1.5) -> DataFrame:
    d = density(o, km / 111)
    stats = F.broadcast(d.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd")))
    z = (F.col("n") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    return d.crossJoin(stats).withColumn("z_score", z).where(F.col("z_score") >= threshold).select("n", "z_score", F.when(F.col("z_score") >= 5, "HIGH").otherwise("MEDIUM").alias("severity"))
