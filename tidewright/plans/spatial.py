"""Filter, join and spatial queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.common import table
from tidewright.functions.geo import in_ring
from tidewright.operators import olap as O
from tidewright.operators import spatial as S
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}
RING = [(20.0, 10.0), (24.0, 10.0), (24.0, 13.0), (22.0, 11.0), (20.0, 13.0)]


def add(name, run, views, sql):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(views, sql)


def km_sql(a, b, c, d, r=6371.0):
    return f"2 * {r} * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"


def deg_sql(a="a", b="b"):
    return f"sqrt(pow({a}.lat - {b}.lat, 2) + pow({a}.lon - {b}.lon, 2))"


add("fp01_conjunction", lambda s, d: O.conjunction(D.time_series(s, d), "1996-01-01", "1997-12-31", code="2-HIGH", country=None, commodity="F"), "time_series", "SELECT * FROM time_series WHERE code = '2-HIGH' AND commodity = 'F' AND ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-12-31'")
add("fp02_bbox", lambda s, d: O.in_box(D.events(s, d), -50, -30, 50, 30), "ev", "SELECT * FROM ev WHERE lon BETWEEN -50 AND 50 AND lat BETWEEN -30 AND 30")
add("fp03_in_list", lambda s, d: D.events(s, d).where(F.col("source_name").isin(*[x.strip() for x in "src1, src3".split(",")])).select("id", "source_name"), "ev", "SELECT id, source_name FROM ev WHERE source_name IN ('src1', 'src3')")
add("fp04_substring", lambda s, d: D.entities(s, d).where(F.col("name").ilike("%#00000001%")).select("id", "name"), "entities", "SELECT id, name FROM entities WHERE name ILIKE '%#00000001%'")
GRAMS = "list_distinct([substr('  ' || {0} || ' ', i, 3) FOR i IN range(1, len({0}) + 3)])"
add("fp05_trigram", lambda s, d: S.trigram_search(D.entities(s, d), "customer 42"), "entities", (
    f"WITH g AS (SELECT id, name, {GRAMS.format('lower(name)')} AS a, {GRAMS.format(chr(39) + 'customer 42' + chr(39))} AS b FROM entities) SELECT id, name, "
    f"len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS similarity FROM g ORDER BY 3 DESC, id LIMIT 20"
))
add("fp06_page", lambda s, d: S.page(D.events(s, d).select("id", "ts"), [F.desc("ts"), "id"], 40, 20), "ev", "SELECT id, ts, (SELECT count(*) FROM ev) AS total FROM ev ORDER BY ts DESC, id LIMIT 20 OFFSET 40")
add("fp09_null_safe_division", lambda s, d: D.events(s, d).select("id", F.try_divide("impact", F.col("entity_id") % 3).alias("ratio")), "ev", "SELECT id, impact / nullif(entity_id % 3, 0) AS ratio FROM ev")
add("fp10_random_sample", lambda s, d: D.entities(s, d).where("lat between -90 and 90").orderBy(F.rand(42)).limit(50).select("id", "name"), "", None)
add("fp12_entity_page", lambda s, d: S.page(D.entities(s, d).select("id", "name", "country"), ["name", "id"], 0, 50), "entities", "SELECT id, name, country, (SELECT count(*) FROM entities) AS total FROM entities ORDER BY name, id LIMIT 50")
add("fp13_entity_detail", lambda s, d: D.relationships(s, d).where("source_id = 's7' or dest_id = 's7'"), "relationships", "SELECT * FROM relationships WHERE source_id = 's7' OR dest_id = 's7'")
add("jn01_flow_names", lambda s, d: S.with_names(D.flows(s, d), D.entities(s, d)), "flows entities", (
    "SELECT f.id, f.source_id, f.dest_id, s.name AS source_name, t.name AS dest_name, amount FROM flows f LEFT JOIN entities s ON f.source_id = s.id LEFT "
    "JOIN entities t ON f.dest_id = t.id"
))
add("jn06_spatial_edges", lambda s, d: S.spatial_edges(D.entities(s, d), 1.5), "entities", (
    f"SELECT a.id AS source_id, b.id AS target_id, round(greatest(0.1, 1 - {deg_sql()} / 1.5), 4) AS strength FROM entities a JOIN entities b ON a.id < b.id "
    f"AND (a.entity_type <> b.entity_type OR a.source_name <> b.source_name) AND {deg_sql()} <= 1.5"
))
add("jn07_proximity_time", lambda s, d: S.proximity_encounters(D.tracks(s, d)), "tracks", (
    f"SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, count(*) AS n, min(a.ts) AS first_ts, max(a.ts) AS last_ts, "
    f"min({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS min_km, avg({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS avg_km FROM tracks a JOIN tracks b "
    f"ON a.mmsi < b.mmsi AND abs(epoch(a.ts) - epoch(b.ts)) < 300 AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 30.0 GROUP BY 1, 2 HAVING count(*) >= "
    f"2"
))
LAG = "(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6"
FOLLOWS = f"ev a JOIN ev b ON b.ts > a.ts AND b.ts <= a.ts + INTERVAL 60 MINUTE AND a.source_name <> b.source_name"
add("sy01_sequences", lambda s, d: S.event_sequences(D.events(s, d), 60, 60.0), "ev", (
    f"SELECT a.id AS first_id, b.id AS second_id, {LAG} AS lag_s, round((1 - {LAG} / 3600 + CASE WHEN {deg_sql()} > 0 THEN 1 - {deg_sql()} / 60.0 ELSE 0.5 "
    f"END) / 2, 3) AS confidence FROM {FOLLOWS} AND {deg_sql()} <= 60"
))
add("jn08_interval_join", lambda s, d: S.near_followers(D.events(s, d), 60, 60.0).select("first_id", "second_id", "lag_s"), "ev", f"SELECT a.id AS first_id, b.id AS second_id, {LAG} AS lag_s FROM {FOLLOWS} AND {deg_sql()} <= 60")
CHANCE = (
    "(SELECT t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z) FROM (SELECT z, 1 / (1 + "
    "0.3275911 * z) AS t FROM (SELECT sqrt(chi2 / 2) AS z)))"
)
CHAINS = (
    f"p AS (SELECT a.event_type AS type_a, b.event_type AS type_b, count(*) AS observed, avg({LAG}) AS avg_lag_s FROM {FOLLOWS} GROUP BY 1, 2), s AS (SELECT "
    f"event_type, count(*)::DOUBLE / (SELECT count(*) FROM ev) AS p FROM ev GROUP BY 1), x AS (SELECT p.*, s.p * t.p * (SELECT count(*) FROM ev) AS expected "
    f"FROM p JOIN s ON type_a = s.event_type JOIN s t ON type_b = t.event_type), y AS (SELECT *, pow(observed - expected, 2) / expected AS chi2 FROM x WHERE "
    f"observed >= 5 AND expected >= 1), chains AS (SELECT *, {CHANCE} AS p, CASE WHEN {CHANCE} < 0.01 AND observed > 2 * expected THEN 'CAUSES' ELSE "
    f"'PRECEDES' END AS kind FROM y)"
)
add("sy02_causal_chains", lambda s, d: S.causal_chains(D.events(s, d)), "ev", f"WITH {CHAINS} SELECT * FROM chains")
add("sy04_chain_edges", lambda s, d: S.chain_edges(S.causal_chains(D.events(s, d))), "ev", f"WITH {CHAINS} SELECT type_a AS source_id, type_b AS target_id, kind AS edge_type, 1 - p AS strength FROM chains WHERE p < 0.05")
add("jn10_co_occurrence", lambda s, d: S.co_occurrence(D.events(s, d), 6.0, 28), "ev", (
    f"SELECT a.source_name AS source_a, b.source_name AS source_b, a.event_type AS type_a, b.event_type AS type_b, count(*) AS n, avg({deg_sql()}) AS "
    f"avg_deg FROM ev a JOIN ev b ON a.id < b.id AND a.source_name <> b.source_name AND {deg_sql()} <= 6 AND abs(epoch_us(date_trunc('second', a.ts)) - "
    f"epoch_us(date_trunc('second', b.ts))) < 28 * 86400 * 1000000::BIGINT GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2"
))
add("jn11_same_identifier", lambda s, d: S.matched_by(D.entities(s, d), "identifier", "source_name"), "entities", (
    "SELECT a.id AS id_a, b.id AS id_b, a.identifier AS key FROM entities a JOIN entities b ON a.identifier = b.identifier AND a.id < b.id AND "
    "a.source_name <> b.source_name"
))
add("jn12_same_json_value", lambda s, d: S.shared_key_counts(D.events(s, d).withColumn("k", F.get_json_object("props", "$.k")), "k", "source_name"), "ev", (
    "WITH c AS (SELECT json_extract_string(props, '$.k') AS key, source_name, count(*) AS n FROM ev GROUP BY 1, 2) SELECT a.key, a.source_name AS group_a, "
    "b.source_name AS group_b, a.n * b.n AS pairs FROM c a JOIN c b ON a.key = b.key AND a.source_name < b.source_name"
))
add("jn14_either_key", lambda s, d: S.either_key(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 3).alias("x"), F.col("s_nationkey").alias("y")), table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("x"), F.col("c_nationkey").alias("y")), [("x", "x"), ("y", "y")]), "", "SELECT s_suppkey AS id_a, c_custkey AS id_b FROM supplier JOIN customer ON s_suppkey * 3 = c_custkey OR s_nationkey = c_nationkey")
PAIRS = "SELECT a.id AS id_a, b.id AS id_b, a.{0} AS key FROM entities a JOIN entities b ON a.{0} = b.{0} AND a.id < b.id AND a.entity_type <> b.entity_type QUALIFY row_number() OVER (PARTITION BY a.{0} ORDER BY a.id, b.id) <= {1}"
add("jn15_capped_pairs", lambda s, d: S.first_pairs(D.entities(s, d), "country", "entity_type", 50), "entities", PAIRS.format("country", 50))
add("gr06_sector_edges", lambda s, d: S.first_pairs(D.entities(s, d), "sector", "entity_type", 200), "entities", PAIRS.format("sector", 200))
add("jn19_nearest_in_time", lambda s, d: S.nearest_in_time(D.tracks(s, d), 7).select("mmsi", "mark", "id", "gap_s"), "tracks", (
    "WITH m AS (SELECT *, unnest(range(CAST(floor(epoch(ts) / 420) AS BIGINT), CAST(floor(epoch(ts) / 420) AS BIGINT) + 2)) AS mark FROM tracks), g AS "
    "(SELECT mmsi, mark, id, CAST(abs(epoch(ts) - mark * 420) AS BIGINT) AS gap_s FROM m) SELECT * FROM g WHERE gap_s < 120 QUALIFY row_number() OVER "
    "(PARTITION BY mmsi, mark ORDER BY gap_s, id) = 1"
))
INSIDE = " + ".join(f"CAST((({y1} > lat) <> ({y2} > lat)) AND (lon < ({x2} - {x1}) * (lat - {y1}) / ({y2 - y1}) + {x1}) AS INTEGER)" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]], strict=True) if y1 != y2)
add("jn20_point_in_zone", lambda s, d: D.tracks(s, d).where(in_ring(F.col("lon"), F.col("lat"), RING)).select("id", "mmsi"), "tracks", f"SELECT id, mmsi FROM tracks WHERE ({INSIDE}) % 2 = 1")
add("ge10_point_in_polygon", lambda s, d: D.tracks(s, d).select("id", in_ring(F.col("lon"), F.col("lat"), RING).alias("inside")), "tracks", f"SELECT id, ({INSIDE}) % 2 = 1 AS inside FROM tracks")
add("ge11_circle_zone", lambda s, d: S.in_circle(D.tracks(s, d), 11.5, 22.0, 60.0).select("id"), "tracks", f"SELECT id FROM tracks WHERE {km_sql('lat', 'lon', '11.5', '22.0', 3440.065)} <= 60")
add("ge08_radius", lambda s, d: S.around(D.entities(s, d), 0.0, 0.0, 1500.0).select("id"), "entities", "SELECT id FROM entities WHERE sqrt(lat * lat + lon * lon) <= 1500 / 111.32")
add("ge09_nearby_vessels", lambda s, d: S.nearby_vessels(O.latest_positions(D.tracks(s, d)), 11.5, 22.0, 150.0), "tracks", (
    f"WITH l AS (SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, id DESC) = 1), k AS (SELECT mmsi, "
    f"{km_sql('lat', 'lon', '11.5', '22.0')} AS km FROM l) SELECT * FROM k WHERE km <= 150 ORDER BY km, mmsi LIMIT 100"
))
add("ge02_getis_ord", lambda s, d: S.getis_ord(D.events(s, d)), "ev", (
    "WITH c AS (SELECT floor(lat / 10.0) AS cy, floor(lon / 10.0) AS cx, count(*)::DOUBLE AS v FROM ev GROUP BY 1, 2), t AS (SELECT count(*) AS n, avg(v) "
    "AS mean, stddev_pop(v) AS s FROM c), l AS (SELECT a.cy, a.cx, a.v, sum(b.v) AS around, count(*) AS k FROM c a JOIN c b ON abs(a.cy - b.cy) <= 1 AND "
    "abs(a.cx - b.cx) <= 1 GROUP BY 1, 2, 3), z AS (SELECT cy * 10.0 AS cell_lat, cx * 10.0 AS cell_lon, v, (around - mean * k) / nullif(s * sqrt((n * k - "
    "k * k)::DOUBLE / (n - 1)), 0) AS z FROM l, t) SELECT *, CASE WHEN z >= 2.5758 THEN 'hot 99' WHEN z >= 1.96 THEN 'hot 95' WHEN z >= 1.6449 THEN 'hot "
    "90' WHEN z <= -2.5758 THEN 'cold 99' WHEN z <= -1.96 THEN 'cold 95' WHEN z <= -1.6449 THEN 'cold 90' ELSE 'ns' END AS kind FROM z"
))
add("ge05_morans_i", lambda s, d: S.morans_i(D.events(s, d)), "ev", (
    "WITH c AS (SELECT floor(lat / 10.0) AS cy, floor(lon / 10.0) AS cx, count(*)::DOUBLE AS v FROM ev GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT "
    "count(*)::DOUBLE AS n, avg(v) AS mean, sum(v * v) - sum(v) * sum(v) / count(*) AS ss FROM c), p AS (SELECT count(*) AS weights, sum((a.v - mean) * "
    "(b.v - mean)) AS x FROM c a JOIN c b ON abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 AND NOT (a.cy = b.cy AND a.cx = b.cx), t) SELECT *, (morans_i "
    "- expected) / sqrt(variance) AS z, CASE WHEN morans_i > 0.3 THEN 'strong clustering' WHEN morans_i > 0.1 THEN 'moderate clustering' WHEN morans_i > "
    "-0.1 THEN 'random' ELSE 'dispersed' END AS reading FROM (SELECT n, weights, n / weights * x / ss AS morans_i, -1 / (n - 1) AS expected, 1 / (n - 1) AS "
    "variance FROM t, p WHERE n >= 4)"
))
NEAR = f"near AS (SELECT a.id, b.id AS id2 FROM pts a JOIN pts b ON abs(a.lat - b.lat) <= 1.9 AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200)"
add("ge01_dbscan", lambda s, d: S.dbscan(D.events(s, d), 200.0, 3), "ev", (
    f"WITH RECURSIVE pts AS (SELECT id, lat, lon FROM ev), {NEAR}, core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 3), link AS (SELECT n.id, "
    f"n.id2 FROM near n JOIN core a ON n.id = a.id JOIN core b ON n.id2 = b.id), walk(id, root) AS (SELECT id, id FROM core UNION SELECT l.id2, w.root FROM "
    f"walk w JOIN link l ON w.id = l.id), cc AS (SELECT id, min(root) AS cluster FROM walk GROUP BY id) SELECT id, cluster FROM cc UNION ALL SELECT n.id, "
    f"min(cc.cluster) FROM near n JOIN cc ON n.id2 = cc.id WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id"
))
BODY = ORACLES["ge01_dbscan"].split("WITH RECURSIVE ", 1)[1]
SPLIT = BODY.rindex(" SELECT id, cluster FROM cc UNION ALL")
add("ge01_cluster_summary", lambda s, d: S.cluster_summary(D.events(s, d), S.place_clusters(D.events(s, d), 200.0, 3)), "", (
    f"WITH RECURSIVE {BODY[:SPLIT]}, lab AS ({BODY[SPLIT:]}), j AS (SELECT ev.*, cluster FROM ev JOIN lab USING (id)), g AS (SELECT cluster, count(*) AS "
    f"size, avg(lat) AS lat, avg(lon) AS lon, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM j GROUP BY 1), t AS (SELECT "
    f"cluster, string_agg(source_name, ',' ORDER BY n DESC, source_name) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, "
    f"source_name) AS r FROM (SELECT cluster, source_name, count(*) AS n FROM j GROUP BY ALL)) WHERE r <= 5 GROUP BY 1), k AS (SELECT cluster, "
    f"string_agg(event_type || '=' || n, ',' ORDER BY event_type || '=' || n) AS kinds FROM (SELECT cluster, event_type, count(*) AS n FROM j GROUP BY ALL) "
    f"GROUP BY 1) SELECT g.*, sources, kinds FROM g JOIN t USING (cluster) JOIN k USING (cluster)"
))
HEAD = "degrees(atan2(lon - b, lat - a))"
add("ge03_trajectories", lambda s, d: S.trajectory_summary(D.tracks(s, d)), "tracks", (
    f"WITH p AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b, lag(ts) OVER w AS c FROM tracks WINDOW w AS (PARTITION BY mmsi ORDER BY ts, id)), k "
    f"AS (SELECT mmsi, ts, id, {km_sql('a', 'b', 'lat', 'lon')} AS km, (epoch(ts) - epoch(c)) / 3600 AS h, {HEAD} AS head FROM p), t AS (SELECT *, "
    f"abs((((head - lag(head) OVER (PARTITION BY mmsi ORDER BY ts, id) + 180) % 360 + 360) % 360) - 180) AS turn FROM k), g AS (SELECT mmsi, count(*) AS "
    f"points, sum(km) AS distance_km, avg(CASE WHEN h > 0 THEN km / h END) AS avg_kmh, max(CASE WHEN h > 0 THEN km / h END) AS max_kmh, avg(turn) AS "
    f"avg_turn FROM t GROUP BY 1 HAVING count(*) >= 10) SELECT *, CASE WHEN coalesce(avg_kmh, 0) / 1.852 < 0.5 THEN 'anchored' WHEN coalesce(avg_kmh, 0) / "
    f"1.852 < 2 AND coalesce(avg_turn, 0) > 30 THEN 'loitering' WHEN coalesce(avg_kmh, 0) / 1.852 > 8 AND coalesce(avg_turn, 0) < 15 THEN 'transit' WHEN "
    f"coalesce(avg_turn, 0) > 20 THEN 'drift' ELSE 'mixed' END AS behaviour FROM g"
))
add("ge04_encounters", lambda s, d: S.proximity_encounters(D.tracks(s, d), 10.0, 300, 3, 0.5), "tracks", (
    f"SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, count(*) AS n, min(a.ts) AS first_ts, max(a.ts) AS last_ts, "
    f"min({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS min_km, avg({km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS avg_km FROM tracks a JOIN tracks b "
    f"ON a.mmsi < b.mmsi AND abs(epoch(a.ts) - epoch(b.ts)) < 300 AND {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 10.0 GROUP BY 1, 2 HAVING count(*) >= "
    f"3 AND epoch(max(a.ts)) - epoch(min(a.ts)) >= 1800"
))
add("st01_union", lambda s, d: D.flows(s, d).select(F.col("source_id").alias("id")).union(D.flows(s, d).select("dest_id")).distinct(), "flows", "SELECT source_id AS id FROM flows UNION SELECT dest_id FROM flows")
add("st03_intersect", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")), "", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
