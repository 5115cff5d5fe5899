"""The roll-up and statistics queries with their parameters and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import olap as O
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}
A, B = "1-URGENT", "3-MEDIUM"
NOW = "2000-01-01"


def add(name, run, views, sql):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(views, sql)


def on(op, *tables, **params):
    return lambda s, d: op(*[getattr(D, t)(s, d) for t in tables], **params)


MONTHLY = "SELECT date_trunc('month', ts) AS period, avg(value) AS avg_value FROM time_series WHERE code = '{}' GROUP BY 1"
DAILY = "daily AS (SELECT code, date_trunc('day', ts) AS day, avg(value) AS value FROM time_series WHERE value IS NOT NULL GROUP BY 1, 2)"
GRID = "floor(lat / {0}) * {0} AS cell_lat, floor(lon / {0}) * {0} AS cell_lon"
DEGREES = "deg AS (SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM {0} UNION ALL SELECT dest_id, 0, 1 FROM {0}) GROUP BY id)"


def daily(op, **params):
    return lambda s, d: op(O.daily_series(D.time_series(s, d)), **params)


add("ts01_rollup", on(O.ts_rollup, "time_series"), "time_series", (
    "SELECT date_trunc('month', ts) AS period, code, commodity, country, avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value, "
    "count(value) AS n FROM time_series GROUP BY 1, 2, 3, 4"
))
add("ts01_rollup_week", on(O.ts_rollup, "time_series", period="week"), "time_series", (
    "SELECT date_trunc('week', ts) AS period, code, commodity, country, avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value, "
    "count(value) AS n FROM time_series GROUP BY 1, 2, 3, 4"
))
add("ts02_moving_average", on(O.ts_moving_average, "time_series", code=A), "time_series", (
    f"SELECT id, ts, value, avg(value) OVER w AS moving_avg, stddev_pop(value) OVER w AS moving_std FROM time_series WHERE code = '{A}' WINDOW w AS (ORDER "
    f"BY ts, id ROWS 6 PRECEDING)"
))
add("ts03_yoy_change", on(O.ts_yoy_change, "time_series", code=A), "time_series", (
    f"WITH m AS ({MONTHLY.format(A)}), l AS (SELECT *, lag(avg_value, 12) OVER (ORDER BY period) AS prior FROM m) SELECT period, avg_value, prior, CASE WHEN "
    f"prior != 0 THEN (avg_value - prior) / prior * 100 END AS yoy_pct FROM l"
))
add("ts04_volatility", on(O.ts_volatility, "time_series", code=A), "time_series", (
    f"WITH r AS (SELECT id, ts, value, (value - lag(value) OVER (ORDER BY ts, id)) / nullif(lag(value) OVER (ORDER BY ts, id), 0) AS pct_return FROM "
    f"time_series WHERE code = '{A}') SELECT *, stddev_pop(value) OVER w AS value_volatility, stddev_pop(pct_return) OVER w AS return_volatility FROM r "
    f"WINDOW w AS (ORDER BY ts, id ROWS 29 PRECEDING)"
))
add("ts05_correlation", on(O.ts_correlation, "time_series", a=A, b=B, start="1993-01-01"), "time_series", (
    f"WITH t AS (SELECT * FROM time_series WHERE ts >= TIMESTAMP '1993-01-01'), a AS ({MONTHLY.format(A).replace('FROM time_series', 'FROM t')}), b AS "
    f"({MONTHLY.format(B).replace('FROM time_series', 'FROM t')}) SELECT corr(a.avg_value, b.avg_value) AS correlation, regr_slope(a.avg_value, b.avg_value) "
    f"AS slope, regr_r2(a.avg_value, b.avg_value) AS r2, count(*) AS n FROM a JOIN b USING (period)"
))
add("ts06_trend", on(O.ts_trend, "time_series", code=A), "time_series", (
    f"WITH m AS (SELECT *, row_number() OVER (ORDER BY period) AS rn FROM ({MONTHLY.format(A)})), t AS (SELECT *, avg(avg_value) OVER (ORDER BY period ROWS "
    f"BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS trend, regr_slope(avg_value, rn) OVER () AS slope FROM m) SELECT period, avg_value, trend, avg_value - trend "
    f"AS residual, slope FROM t"
))
add("ts07_zscore", on(O.ts_zscore, "time_series"), "time_series", (
    "WITH z AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, id) AS rn, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS "
    "z FROM time_series WINDOW w AS (PARTITION BY code ORDER BY ts, id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT id, code, ts, value, round(z, 3) "
    "AS z_score, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS direction FROM z WHERE rn > 30 AND abs(z) >= 2.5"
))
SCAN = "scan AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z_score FROM time_series WINDOW w AS (PARTITION BY code ORDER BY ts, id ROWS 29 PRECEDING))"
add("ts08_zscore_scan", on(O.zscore_scan, "time_series", threshold=1.8), "time_series", (
    f"WITH {SCAN} SELECT id, code, ts, value, z_score, CASE WHEN abs(z_score) >= 5 THEN 'CRITICAL' WHEN abs(z_score) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS "
    f"severity FROM scan WHERE abs(z_score) >= 1.8"
))
add("ts09_anomaly_map", on(O.anomaly_map, "time_series", threshold=1.8), "time_series", (
    f"WITH {SCAN} SELECT code, count(*) AS n, max(abs(z_score)) AS worst, min(ts) AS first_ts, max(ts) AS last_ts FROM scan WHERE abs(z_score) >= 1.8 GROUP "
    f"BY code"
))
add("ts10_cusum", daily(O.cusum, sensitivity=0.002), "time_series", f"""WITH RECURSIVE {DAILY}, p AS (SELECT code, day, row_number() OVER (PARTITION BY code ORDER BY day) AS rn, (value - avg(value) OVER (PARTITION BY code)) / stddev_pop(value) OVER (PARTITION BY code) AS z, 0.002 * count(*) OVER (PARTITION BY code) AS lim, count(*) OVER (PARTITION BY code) AS n FROM daily),
    f AS (SELECT code, rn, day, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS hit, 0.0::DOUBLE AS u, 0.0::DOUBLE AS w, lim FROM p WHERE rn = 1 AND n >= 30
    UNION ALL SELECT q.code, q.rn, q.day, CASE WHEN greatest(greatest(0, f.up + z - 0.5), greatest(0, f.down - z - 0.5)) > q.lim THEN 0 ELSE greatest(0, f.up + z - 0.5) END, CASE WHEN greatest(greatest(0, f.up + z - 0.5), greatest(0, f.down - z - 0.5)) > q.lim THEN 0 ELSE greatest(0, f.down - z - 0.5) END,
    greatest(greatest(0, f.up + z - 0.5), greatest(0, f.down - z - 0.5)) > q.lim, greatest(0, f.up + z - 0.5), greatest(0, f.down - z - 0.5), q.lim FROM f JOIN p q ON q.code = f.code AND q.rn = f.rn + 1)
    SELECT code, day, CASE WHEN u > lim THEN 'increase' ELSE 'decrease' END AS direction, greatest(u, w) AS cusum FROM f WHERE hit""")
add("ts11_forecast", daily(O.smoothing_forecast), "", None)
add("ts12_daily", lambda s, d: O.daily_series(D.time_series(s, d)), "time_series", f"WITH {DAILY} SELECT * FROM daily")
add("ts13_lagged_correlation", daily(O.lagged_correlation), "time_series", (
    f"WITH {DAILY} SELECT a.code AS code_a, b.code AS code_b, l.lag::INTEGER AS lag, corr(a.value, b.value) AS r, count(*) AS n FROM daily a CROSS JOIN "
    f"(SELECT unnest([0, 7, 14, 30, 60, 90]) AS lag) l JOIN daily b ON b.day = a.day + to_days(l.lag::INTEGER) AND a.code < b.code GROUP BY 1, 2, 3 HAVING "
    f"count(*) >= 20"
))
add("ts16_pair_overlap", daily(O.pair_overlap), "time_series", (
    f"WITH {DAILY} SELECT a.code AS code_a, b.code AS code_b, count(*) AS overlap_days FROM daily a JOIN daily b ON a.day = b.day AND a.code < b.code GROUP "
    f"BY 1, 2 HAVING count(*) >= 20"
))
add("ts17_heatwaves", daily(O.heatwaves), "time_series", (
    f"WITH {DAILY}, s AS (SELECT code, day, value, count(*) OVER c AS n, avg(value) OVER c AS mean, row_number() OVER (PARTITION BY code ORDER BY day) AS rn "
    f"FROM daily WINDOW c AS (PARTITION BY code)), t AS (SELECT code, list_extract(list_sort(list(value)), CAST(floor(0.9 * count(*)) AS BIGINT) + 1) AS "
    f"threshold FROM daily GROUP BY code), h AS (SELECT s.*, rn - row_number() OVER (PARTITION BY s.code ORDER BY day) AS island FROM s JOIN t USING (code) "
    f"WHERE n >= 30 AND value > threshold) SELECT code, min(day) AS start_day, max(day) AS end_day, count(*) AS days, max(value - mean) AS max_intensity, "
    f"avg(value - mean) AS mean_intensity FROM h GROUP BY code, island HAVING count(*) >= 5"
))
add("ts18_alignment", lambda s, d: O.aligned(D.assessments(s, d).withColumnRenamed("score", "quality"), D.time_series(s, d), "month"), "assessments time_series", (
    "SELECT e.period, avg_quality, avg_value FROM (SELECT date_trunc('month', ts) AS period, avg(score) AS avg_quality FROM assessments GROUP BY 1) e JOIN "
    "(SELECT date_trunc('month', ts) AS period, avg(value) AS avg_value FROM time_series GROUP BY 1) t ON e.period = t.period"
))
add("ts18_alignment_correlation", lambda s, d: O.aligned_correlation(O.aligned(D.assessments(s, d).withColumnRenamed("score", "quality"), D.time_series(s, d), "month")), "assessments time_series", (
    "SELECT count(*) AS n, corr(avg_quality, avg_value) AS r FROM (SELECT date_trunc('month', ts) AS period, avg(score) AS avg_quality FROM assessments "
    "GROUP BY 1) e JOIN (SELECT date_trunc('month', ts) AS period, avg(value) AS avg_value FROM time_series GROUP BY 1) t ON e.period = t.period"
))
add("ts15_granger", daily(O.granger), "", None)
SERIES = "concat_ws('|', code, source_name, commodity, country)"
add(
    "ts16_discovered_pairs",
    lambda s, d: O.discovered_pairs(D.time_series(s, d).withColumn("country", F.lit("all")), 20),
    "time_series",
    (
        f"WITH d AS (SELECT {SERIES.replace('country', chr(39) + 'all' + chr(39))} AS series, source_name AS source, CAST(ts AS DATE) AS day, count(*) AS n FROM "
        f"time_series WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT series, sum(n) AS points FROM d GROUP BY 1 HAVING sum(n) >= 20), h AS (SELECT d.*, "
        f"points FROM d JOIN m USING (series)), g AS (SELECT a.series AS series_a, b.series AS series_b, count(*) AS overlap_days, CAST(max(a.points + b.points) "
        f"AS BIGINT) AS points FROM h a JOIN h b ON a.day = b.day AND a.series < b.series AND a.source <> b.source GROUP BY 1, 2 HAVING count(*) >= 20), f AS "
        f"(SELECT * FROM g ORDER BY points DESC, series_a, series_b LIMIT 200) SELECT *, row_number() OVER (ORDER BY overlap_days DESC, series_a, series_b) AS "
        f"rank FROM f"
    ),
)
for by in ("entity_type", "country", "sector"):
    add(f"en01_distribution_{by}", on(O.distribution, "entities", by=by), "entities", f"SELECT {by} AS key, count(*) AS n FROM entities WHERE {by} IS NOT NULL GROUP BY 1")
add("en02_connectivity", on(O.connectivity, "entities", "relationships"), "entities relationships", (
    f"WITH {DEGREES.format('relationships')} SELECT e.id, name, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree, "
    f"coalesce(out_degree, 0) + coalesce(in_degree, 0) AS total_degree FROM entities e LEFT JOIN deg ON e.id = deg.id"
))
add("en03_density", on(O.density, "entities"), "entities", f"SELECT {GRID.format(5.0)}, count(*) AS n FROM entities GROUP BY 1, 2")
add("en04_hotspots", lambda s, d: O.density(D.entities(s, d), 2.0, 2).orderBy("n", "cell_lat", "cell_lon", ascending=[False, True, True]).limit(20), "entities", f"SELECT {GRID.format(2.0)}, count(*) AS n FROM entities GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, 1, 2 LIMIT 20")
add("fl01_trade_balance", on(O.trade_balance, "flows", "entities"), "flows entities", (
    "SELECT s.country AS source_country, t.country AS dest_country, commodity, currency, round(sum(amount), 2) AS total_amount, count(*) AS n FROM flows "
    "LEFT JOIN entities s ON source_id = s.id LEFT JOIN entities t ON dest_id = t.id GROUP BY 1, 2, 3, 4"
))
add("fl02_top_flows", on(O.top_flows, "flows", flow_type="R"), "flows", "SELECT id, flow_type, source_id, dest_id, amount, commodity FROM flows WHERE flow_type = 'R' AND amount IS NOT NULL ORDER BY amount DESC, id LIMIT 20")
add("fl03_network_stats", on(O.network_stats, "flows"), "flows", (
    "SELECT nodes, edges, CAST(edges AS DOUBLE) / nodes AS avg_degree FROM (SELECT count(*) AS nodes FROM (SELECT source_id FROM flows UNION SELECT dest_id "
    "FROM flows)), (SELECT count(*) AS edges FROM flows)"
))
add("ev01_frequency", on(O.event_frequency, "events"), "ev", "SELECT date_trunc('day', ts) AS period, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
add("ev02_severity_trend", on(O.severity_trend, "events"), "ev", (
    "SELECT date_trunc('week', ts) AS period, count(*) AS n, avg(impact) AS avg_impact, quantile_cont(impact, 0.25) AS p25, quantile_cont(impact, 0.5) AS "
    "p50, quantile_cont(impact, 0.75) AS p75, quantile_cont(impact, 0.95) AS p95 FROM ev WHERE impact IS NOT NULL GROUP BY 1"
))
add("ev03_event_correlation", on(O.event_correlation, "events", "time_series", code=A), "ev time_series", (
    f"SELECT coalesce(e.period, t.period) AS period, event_count, avg_impact, avg_value, nullif(corr(event_count, avg_value) OVER (), 'nan'::DOUBLE) AS "
    f"correlation FROM (SELECT date_trunc('day', ts) AS period, count(*) AS event_count, avg(impact) AS avg_impact FROM ev GROUP BY 1) e FULL JOIN (SELECT "
    f"date_trunc('day', ts) AS period, avg(value) AS avg_value FROM time_series WHERE code = '{A}' GROUP BY 1) t ON e.period = t.period"
))
add("as01_distribution", on(O.score_distribution, "assessments"), "assessments", (
    "SELECT metric_code, assessor, count(score) AS n, avg(score) AS mean, stddev_pop(score) AS sd, min(score) AS lo, max(score) AS hi, quantile_cont(score, "
    "0.25) AS p25, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS p75 FROM assessments GROUP BY 1, 2"
))
add("as02_ranking", on(O.latest_ranking, "assessments", metric="R"), "assessments", (
    "WITH l AS (SELECT * FROM assessments WHERE metric_code = 'R' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC NULLS LAST, id DESC) = "
    "1) SELECT entity_id, ts, score FROM l ORDER BY score DESC, entity_id LIMIT 50"
))
add("as03_trend", on(O.assessment_trend, "assessments"), "assessments", (
    "SELECT date_trunc('month', ts) AS period, entity_id, assessor, avg(score) AS avg_score, count(*) AS n FROM assessments WHERE ts IS NOT NULL AND score "
    "IS NOT NULL GROUP BY 1, 2, 3"
))
add("as04_cross_compare", lambda s, d: D.assessments(s, d).where("entity_id = 7"), "assessments", "SELECT * FROM assessments WHERE entity_id = 7")
add("cl01_delivery", on(O.claim_delivery, "claims"), "claims", (
    "SELECT status, count(*) AS n, avg(progress) AS avg_progress, count(*) FILTER (progress >= 100) AS delivered, CAST(count(*) AS DOUBLE) / sum(count(*)) "
    "OVER () AS share FROM claims GROUP BY 1"
))
add("cl02_deadlines", on(O.claim_deadlines, "claims", as_of=NOW), "claims", (
    f"SELECT date_trunc('month', deadline) AS period, count(*) AS n, count(*) FILTER (deadline < TIMESTAMP '{NOW}' AND progress < 100) AS overdue, count(*) "
    f"FILTER (progress >= 100) AS completed, avg(progress) AS avg_progress FROM claims GROUP BY 1"
))
add("cl03_gaps", on(O.claim_gaps, "claims", as_of=NOW), "claims", (
    f"SELECT id, claimant_id, CASE WHEN target_value > 0 THEN target_value * (1 - progress / 100) END AS remaining, CAST(date_diff('day', DATE '{NOW}', "
    f"CAST(deadline AS DATE)) AS BIGINT) AS days_left FROM claims"
))
add("rl01_degree_centrality", lambda s, d: O.connectivity(D.entities(s, d), D.relationships(s, d)).where("total_degree > 0").orderBy("total_degree", "id", ascending=[False, True]).limit(50), "entities relationships", (
    f"WITH {DEGREES.format('relationships')} SELECT e.id, name, out_degree, in_degree, out_degree + in_degree AS total_degree FROM entities e JOIN deg ON "
    f"e.id = deg.id ORDER BY total_degree DESC, e.id LIMIT 50"
))
add("rl03_types", on(O.type_distribution, "relationships"), "relationships", "SELECT relationship_type, count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT dest_id) AS targets FROM relationships GROUP BY 1")
add("ob01_temporal", on(O.event_frequency, "events"), "ev", "SELECT date_trunc('day', ts) AS period, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
add("ob02_spatial_grid", on(O.density, "events", res=10.0), "ev", f"SELECT {GRID.format(10.0)}, count(*) AS n FROM ev GROUP BY 1, 2")
add("ob03_source_coverage", on(O.source_coverage, "events"), "ev", "SELECT source_name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT event_type) AS types FROM ev GROUP BY 1")
add("ob04_cluster_summary", on(O.cluster_summary, "events"), "ev", (
    f"SELECT {GRID.format(5.0)}, count(*) AS n, count(DISTINCT source_name) AS sources, count(DISTINCT event_type) AS types FROM ev GROUP BY 1, 2 HAVING "
    f"count(*) >= 5"
))
add("ob05_relative_density", on(O.relative_density, "events"), "ev", f"SELECT *, CAST(n AS DOUBLE) / max(n) OVER () AS relative FROM (SELECT {GRID.format(5.0)}, count(*) AS n FROM ev GROUP BY 1, 2)")
LATEST = "SELECT mmsi, ts, id, lat, lon, sog, cog FROM tracks {} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, id DESC) = 1"
add("ob06_latest_positions", lambda s, d: O.latest_positions(O.in_box(D.tracks(s, d), 20, 10, 23, 12)), "tracks", LATEST.format("WHERE lon BETWEEN 20 AND 23 AND lat BETWEEN 10 AND 12"))
add("ob07_latest_of_one", lambda s, d: O.latest_positions(D.tracks(s, d).where("mmsi = 203000009")), "tracks", LATEST.format("WHERE mmsi = 203000009"))
add("ob08_active_vessels", on(O.active_vessels, "tracks"), "tracks", "SELECT mmsi, max(ts) AS last_seen, count(*) AS n FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
add("ob09_area_vessels", lambda s, d: O.in_box(D.tracks(s, d), 20, 10, 22, 12).select("mmsi").distinct(), "tracks", "SELECT DISTINCT mmsi FROM tracks WHERE lon BETWEEN 20 AND 22 AND lat BETWEEN 10 AND 12")
add(
    "ob11_platform_stats",
    lambda s, d: platform_stats(s, d),
    "ev entities flows",
    (
        "SELECT 'events' AS kind, 'all' AS name, count(*) AS n FROM ev UNION ALL SELECT 'entities', 'all', count(*) FROM entities UNION ALL SELECT 'flows', "
        "'all', count(*) FROM flows UNION ALL SELECT 'sources', 'all', count(DISTINCT source_name) FROM ev UNION ALL SELECT 'entity_type', entity_type, "
        "count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM ev GROUP BY 2 UNION ALL (SELECT 'top_source', source_name, "
        "count(*) AS n FROM ev GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20)"
    ),
)


def platform_stats(s, d):
    """Rows of all tables, distinct sources, distributions and the twenty sources with the most rows."""
    e, n, f = D.events(s, d), D.entities(s, d), D.flows(s, d)
    whole = lambda df, kind, value=None: df.agg((value if value is not None else F.count(F.lit(1))).alias("n")).select(F.lit(kind).alias("kind"), F.lit("all").alias("name"), "n")
    by = lambda df, kind, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [whole(e, "events"), whole(n, "entities"), whole(f, "flows"), whole(e, "sources", F.countDistinct("source_name")), by(n, "entity_type", "entity_type"), by(e, "event_type", "event_type"), by(e, "top_source", "source_name").orderBy(F.desc("n"), "name").limit(20)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
add("al01_density_alerts", on(O.density_alerts, "events"), "ev", (
    "WITH g AS (SELECT floor(lat / (500.0::DOUBLE / 111)) AS a, floor(lon / (500.0::DOUBLE / 111)) AS b, count(*) AS n FROM ev GROUP BY 1, 2), z AS (SELECT "
    "n, (n - avg(n) OVER ()) / nullif(stddev_pop(n) OVER (), 0) AS z_score FROM g) SELECT n, z_score, CASE WHEN z_score >= 5 THEN 'HIGH' ELSE 'MEDIUM' END "
    "AS severity FROM z WHERE z_score >= 1.5"
))
add("ge06_density_surface", on(O.density_surface, "events"), "ev", (
    f"SELECT *, CAST(n AS DOUBLE) / max(n) OVER () AS relative FROM (SELECT {GRID.format(5.0)}, count(*) AS n, round(avg(quality), 9) AS avg_quality, "
    f"min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT source_name) AS sources FROM ev GROUP BY 1, 2)"
))
