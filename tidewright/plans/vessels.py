"""Vessel behaviour, geofence and risk queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import spatial as S
from tidewright.operators import vessels as V
from tidewright.plans.spatial import INSIDE, km_sql
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}
#: Sample zones over the tracks' area, and the first digits of MMSIs by flag.
ZONES = [
    {"name": "reserve", "kind": "polygon", "ring": [(20.0, 10.0), (24.0, 10.0), (24.0, 13.0), (22.0, 11.0), (20.0, 13.0)], "rules": {"entry": 1, "exit": 1, "loiter": 60}},
    {"name": "anchorage", "kind": "circle", "lat": 11.5, "lon": 22.0, "radius_nm": 45.0, "rules": {"speed": 10.0, "silence": 2.0}},
]
FLAGS = {203: "AT", 211: "DE", 224: "ES", 226: "FR", 232: "GB", 247: "IT", 257: "NO", 265: "SE", 273: "RU", 303: "US", 316: "CA", 351: "PA", 412: "CN", 431: "JP", 440: "KR", 503: "AU", 636: "LR"}


def add(name, run, sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views("tracks", sql)


def segments(s, d):
    return V.merged(V.classified(V.features(V.windows(D.tracks(s, d)))))


def meetings(s, d):
    return V.encounters(S.nearest_in_time(D.tracks(s, d), 5))


WIN = (
    "win AS (SELECT * FROM (SELECT t.*, w, count(*) OVER (PARTITION BY t.mmsi, w) AS n FROM (SELECT *, min(ts) OVER (PARTITION BY mmsi) AS f, (epoch(ts) - "
    "epoch(min(ts) OVER (PARTITION BY mmsi))) / 60 AS off FROM tracks) t, LATERAL (SELECT unnest(range(greatest(CAST(ceil((off - 30) / 15) AS BIGINT), 0), "
    "CAST(floor(off / 15) AS BIGINT) + 1)) AS w)) WHERE n >= 3)"
)
LINE = km_sql("y1", "x1", "y2", "x2", 3440.065)
SURE = (
    "CASE WHEN mean_sog < 0.5 THEN least(1.0, (1 - mean_sog / 0.5) * 0.5 + 0.5) WHEN mean_sog BETWEEN 1.5 AND 5 AND course_variance >= 0.25 THEN "
    f"CASE WHEN CASE WHEN {LINE} > 0.01 THEN path_nm / {LINE} WHEN path_nm < 0.01 THEN 1.0 ELSE 99.0 END >= 1.5 THEN 1.0 ELSE 0.7 END "
    "WHEN mean_sog < 2 AND course_variance >= 0.4 THEN least(1.0, 0.5 + course_variance * 0.5) WHEN turn_rate >= 3 THEN least(1.0, turn_rate / 6) "
    "WHEN mean_sog >= 4 AND course_variance <= 0.15 THEN least(1.0, 0.5 + (1 - course_variance) * 0.3 + least(mean_sog / 15, 0.2)) WHEN mean_sog < 3 AND course_variance <= 0.15 THEN 0.5 ELSE 0.2 END"
)
FEAT = f"""{WIN}, lagged AS (SELECT *, lag(lat) OVER o AS a, lag(lon) OVER o AS b, lag(ts) OVER o AS c, lag(cog) OVER o AS e FROM win WINDOW o AS (PARTITION BY mmsi, w ORDER BY ts, id)),
    step AS (SELECT *, {km_sql('a', 'b', 'lat', 'lon', 3440.065)} AS nm, CASE WHEN epoch(ts) > epoch(c) THEN abs(((cog - e + 540) % 360) - 180) / ((epoch(ts) - epoch(c)) / 60) END AS rate FROM lagged),
    feat AS (SELECT mmsi, w, count(*) AS points, min(ts) AS start_ts, max(ts) AS end_ts, avg(sog) AS mean_sog, 1 - sqrt(pow(avg(sin(radians(cog))), 2) + pow(avg(cos(radians(cog))), 2)) AS course_variance, coalesce(sum(nm), 0) AS path_nm, coalesce(avg(rate), 0) AS turn_rate, min(lat) AS south, max(lat) AS north, arg_min(lat, (ts, id)) AS y1, arg_min(lon, (ts, id)) AS x1, arg_max(lat, (ts, id)) AS y2, arg_max(lon, (ts, id)) AS x2 FROM step GROUP BY 1, 2),
    kind AS (SELECT *, CASE WHEN mean_sog < 0.5 THEN 'anchored' WHEN mean_sog BETWEEN 1.5 AND 5 AND course_variance >= 0.25 THEN 'fishing' WHEN mean_sog < 2 AND course_variance >= 0.4 THEN 'loitering' WHEN turn_rate >= 3 THEN 'maneuvering' WHEN mean_sog >= 4 AND course_variance <= 0.15 THEN 'transiting' WHEN mean_sog < 3 AND course_variance <= 0.15 THEN 'drifting' ELSE 'unknown' END AS behaviour, {SURE} AS confidence FROM feat)"""
SEG = (
    f"{FEAT}, marked AS (SELECT *, CASE WHEN behaviour IS DISTINCT FROM lag(behaviour) OVER (PARTITION BY mmsi ORDER BY w) THEN 1 ELSE 0 END AS fresh FROM "
    f"kind), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY mmsi ORDER BY w)::BIGINT AS segment FROM marked), seg AS (SELECT mmsi, segment, behaviour, "
    f"min(start_ts) AS start_ts, max(end_ts) AS end_ts, sum(points)::BIGINT AS points, sum(path_nm) AS path_nm, min(south) AS south, max(north) AS north, "
    f"list_reduce(list(confidence::DOUBLE ORDER BY w), lambda a, b: (a + b) / 2) AS confidence FROM numbered GROUP BY 1, 2, 3)"
)
SUMMARY = (
    f"{SEG}, mins AS (SELECT mmsi, behaviour, sum((epoch(end_ts) - epoch(start_ts)) / 60) AS minutes FROM seg GROUP BY 1, 2), summary AS (SELECT *, minutes "
    f"/ nullif(sum(minutes) OVER (PARTITION BY mmsi), 0) * 100 AS pct FROM mins)"
)
GAPS = (
    "gaps AS (SELECT mmsi, c AS gap_start, ts AS gap_end, round((epoch(ts) - epoch(c)) / 3600, 1) AS gap_hours FROM (SELECT *, lag(ts) OVER (PARTITION BY "
    "mmsi ORDER BY ts, id) AS c FROM tracks) WHERE epoch(ts) - epoch(c) >= 7200)"
)

add("bh01_features", lambda s, d: V.features(V.windows(D.tracks(s, d))).select("mmsi", "w", "points", "mean_sog", "course_variance", "path_nm", "turn_rate"), f"WITH {FEAT} SELECT mmsi, w, points, mean_sog, course_variance, path_nm, turn_rate FROM feat")
add("bh02_classifier", lambda s, d: V.classified(V.features(V.windows(D.tracks(s, d)))).select("mmsi", "w", "behaviour", "confidence"), f"WITH {FEAT} SELECT mmsi, w, behaviour, confidence FROM kind")
add("bh03_windows", lambda s, d: V.windows(D.tracks(s, d)).groupBy("mmsi", "w").agg(F.count(F.lit(1)).alias("n")), f"WITH {WIN} SELECT mmsi, w, count(*) AS n FROM win GROUP BY 1, 2")
add("bh04_merged", lambda s, d: segments(s, d), f"WITH {SEG} SELECT * FROM seg")
add("bh05_classify_track", lambda s, d: V.merged(V.classified(V.features(V.windows(D.tracks(s, d).where("mmsi = 203000009"))))).select("mmsi", "behaviour", "start_ts", "end_ts"), f"WITH {SEG} SELECT mmsi, behaviour, start_ts, end_ts FROM seg WHERE mmsi = 203000009")
add("bh06_summary", lambda s, d: V.behaviour_summary(segments(s, d)), f"WITH {SUMMARY} SELECT * FROM summary")
add("bh11_port_stays", lambda s, d: V.port_stays(D.tracks(s, d), 6.0, 10.0, 20.0).select("mmsi", "start_ts", "end_ts", "points", "drift_nm"), (
    f"WITH r AS (SELECT *, sum(CASE WHEN sog <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi ORDER BY ts, id) AS run, id = last_value(id) OVER (PARTITION BY "
    f"mmsi ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM tracks), c AS (SELECT *, avg(lat) OVER (PARTITION BY mmsi, "
    f"run) AS y, avg(lon) OVER (PARTITION BY mmsi, run) AS x FROM r WHERE sog <= 6), g AS (SELECT mmsi, run, min(ts) AS start_ts, max(ts) AS end_ts, "
    f"count(*) AS points, max({km_sql('y', 'x', 'lat', 'lon', 3440.065)}) AS drift_nm, bool_or(fin) AS fin FROM c GROUP BY 1, 2) SELECT mmsi, start_ts, "
    f"end_ts, points, drift_nm FROM g WHERE epoch(end_ts) - epoch(start_ts) >= 600 AND (drift_nm <= 20 OR fin)"
))
add("bh12_simplified", lambda s, d: V.simplified(D.tracks(s, d)))
add("bh15_gaps", lambda s, d: V.gaps(D.tracks(s, d)), f"WITH {GAPS} SELECT * FROM gaps")
add("bh16_flags", lambda s, d: D.tracks(s, d).select("mmsi").distinct().withColumn("flag", V.flag_of(F.col("mmsi"), FLAGS)), "SELECT DISTINCT mmsi, CASE mmsi // 1000000 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FLAGS.items()) + " END AS flag FROM tracks")
add("rk02_gap_factor", lambda s, d: V.gap_factor(D.tracks(s, d)), (
    f"WITH {GAPS}, g AS (SELECT mmsi, max(gap_hours) AS longest, count(*) AS gaps FROM gaps GROUP BY 1) SELECT mmsi, longest, gaps, least(1.0, CASE WHEN "
    f"longest >= 24 THEN 0.8 + (longest - 24) / 120 WHEN longest >= 6 THEN 0.5 + (longest - 6) / 36 ELSE 0.15 + (longest - 2) / 16 END + CASE WHEN gaps >= 3 "
    f"THEN 0.1 ELSE 0 END) AS gap FROM g"
))
SHARE = "coalesce(max(CASE WHEN behaviour = '{}' THEN pct END), 0) > {}"
add("rk03_behaviour_factor", lambda s, d: V.behaviour_factor(V.behaviour_summary(segments(s, d)), segments(s, d)), f"WITH {SUMMARY}, un AS (SELECT mmsi, avg(CASE WHEN confidence < 0.4 THEN 1.0 ELSE 0.0 END) AS unsure FROM seg GROUP BY 1) SELECT mmsi, least(1.0, " + " + ".join(f"CASE WHEN {SHARE.format(b, over)} THEN {x} ELSE 0.0 END" for b, over, x in (("fishing", 30, 0.3), ("loitering", 20, 0.2), ("maneuvering", 30, 0.15), ("drifting", 40, 0.1))) + " + CASE WHEN max(unsure) > 0.3 THEN 0.1 ELSE 0.0 END)::DOUBLE AS behaviour FROM summary JOIN un USING (mmsi) GROUP BY 1")
MET = f"""near AS (SELECT *, CAST(floor(epoch(ts) / 300) AS BIGINT) AS base FROM tracks), nigh AS (SELECT t.*, m AS mark, abs(epoch(ts) - m * 300) AS gap FROM near t, LATERAL (SELECT unnest(range(base, base + 2)) AS m)),
    one AS (SELECT * FROM nigh WHERE gap < 120 QUALIFY row_number() OVER (PARTITION BY mmsi, mark ORDER BY CAST(gap AS BIGINT), id) = 1),
    pair AS (SELECT a.mmsi AS mmsi_a, b.mmsi AS mmsi_b, a.mark, a.ts, a.lat, a.lon, a.sog AS sa, b.sog AS sb, abs(((a.cog - b.cog + 540) % 360) - 180) AS apart, {km_sql('a.lat', 'a.lon', 'b.lat', 'b.lon', 3440.065)} AS nm FROM one a JOIN one b ON a.mark = b.mark AND a.mmsi < b.mmsi),
    isle AS (SELECT *, sum(CASE WHEN nm > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi_a, mmsi_b ORDER BY mark) AS island FROM pair),
    met AS (SELECT mmsi_a, mmsi_b, min(mark) AS first_mark, max(mark) AS last_mark, count(*) AS marks, min(nm) AS min_nm, avg(nm) AS avg_nm, avg(sa) AS sog_a, avg(sb) AS sog_b, avg(apart) AS cog_apart, (max(epoch(ts)) - min(epoch(ts))) / 60 AS seen_minutes, avg(lat) AS lat, avg(lon) AS lon, (max(mark) - min(mark)) * 5 AS minutes FROM isle WHERE nm <= 10 GROUP BY mmsi_a, mmsi_b, island HAVING (max(mark) - min(mark)) * 5 >= 10),
    flagged AS (SELECT *, sog_a < 3 AND sog_b < 3 AS slow, cog_apart < 20 AND CASE WHEN greatest(sog_a, sog_b) > 0.5 THEN least(sog_a, sog_b) / greatest(sog_a, sog_b) ELSE 0 END > 0.7 AS parallel FROM met),
    enc AS (SELECT * EXCLUDE (slow, parallel), CASE WHEN slow THEN 'rendezvous' WHEN parallel THEN 'parallel_transit' WHEN seen_minutes < 30 THEN 'crossing' ELSE 'unknown' END AS kind,
        CASE WHEN slow THEN CASE WHEN seen_minutes > 60 THEN 'critical' WHEN seen_minutes > 30 OR min_nm < 0.1 THEN 'high' ELSE 'medium' END WHEN parallel AND min_nm < 0.2 THEN 'medium' ELSE 'low' END AS risk,
        CASE WHEN slow THEN least(1.0, 0.7 + CASE WHEN min_nm < 0.1 THEN 0.15 ELSE 0 END + CASE WHEN marks > 5 THEN 0.1 ELSE 0 END) WHEN parallel THEN 0.6 WHEN seen_minutes < 30 THEN 0.4 ELSE 0.3 END AS confidence FROM flagged)"""
add("bh08_encounters", meetings, f"WITH {MET} SELECT * FROM enc")
add("bh10_encounters_in_box", lambda s, d: V.encounters(S.nearest_in_time(V.in_area(D.tracks(s, d), 20.0, 10.0, 23.0, 12.0, "2024-01-01", "2024-01-20"), 5)).select("mmsi_a", "mmsi_b", "first_mark", "kind"), (
    f"WITH "
    f"{MET.replace('FROM tracks)', 'FROM tracks WHERE lon BETWEEN 20 AND 23 AND lat BETWEEN 10 AND 12 AND ts BETWEEN TIMESTAMP ' + chr(39) + '2024-01-01' + chr(39) + ' AND TIMESTAMP ' + chr(39) + '2024-01-20' + chr(39) + ')')} "
    f"SELECT mmsi_a, mmsi_b, first_mark, kind FROM enc"
))
add("bh10_encounters_of_vessel", lambda s, d: (lambda t, m: V.encounters(S.nearest_in_time(V.around_vessel(t, m), 5)).where((F.col("mmsi_a") == m) | (F.col("mmsi_b") == m)).select("mmsi_a", "mmsi_b", "first_mark", "kind"))(D.tracks(s, d), 203000009), (
    f"WITH box AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e, min(ts) AS t0, max(ts) AS t1 FROM tracks WHERE mmsi = 203000009), "
    f"{MET.replace('FROM tracks)', 'FROM tracks, box WHERE mmsi = 203000009 OR (lat BETWEEN s - 1 / 6.0::DOUBLE AND n + 1 / 6.0::DOUBLE AND lon BETWEEN w - 1 / 6.0::DOUBLE AND e + 1 / 6.0::DOUBLE AND ts BETWEEN t0 AND t1))')} "
    f"SELECT mmsi_a, mmsi_b, first_mark, kind FROM enc WHERE mmsi_a = 203000009 OR mmsi_b = 203000009"
))


def stays(s, d):
    return V.port_stays(D.tracks(s, d), 6.0, 10.0, 20.0)


LEGS = f"""marks AS (SELECT mmsi, ts, id, lat, lon, sog, 1 AS o, 0 AS ends, CAST(NULL AS INTEGER) AS open FROM tracks UNION ALL SELECT mmsi, end_ts, NULL, NULL, NULL, NULL, 0, 1, 1 FROM st UNION ALL SELECT mmsi, start_ts, NULL, NULL, NULL, NULL, 2, 0, 0 FROM st),
    flow AS (SELECT *, sum(ends) OVER q AS leg, coalesce(last_value(open IGNORE NULLS) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS under_way, sum(ends) OVER (PARTITION BY mmsi) AS stays FROM marks WINDOW q AS (PARTITION BY mmsi ORDER BY ts, o, id)),
    sea AS (SELECT *, lag(lat) OVER g AS a, lag(lon) OVER g AS b, sum(CASE WHEN sog >= 1 THEN 1 ELSE 0 END) OVER g AS run FROM flow WHERE id IS NOT NULL AND under_way = 1 AND (leg > 0 OR stays = 0) WINDOW g AS (PARTITION BY mmsi, leg ORDER BY ts, id)),
    halt AS (SELECT mmsi, leg, count(*) AS stops FROM (SELECT mmsi, leg, run, (epoch(max(ts)) - epoch(min(ts))) / 60 AS m FROM sea WHERE sog < 1 GROUP BY ALL) WHERE m >= 15 AND m < 60 GROUP BY ALL),
    legs AS (SELECT mmsi, leg, min(ts) AS depart, max(ts) AS arrive, count(*) AS points, coalesce(sum({km_sql('a', 'b', 'lat', 'lon', 3440.065)}), 0) AS distance_nm, max(sog) AS max_sog, max(stays) AS stays, (epoch(max(ts)) - epoch(min(ts))) / 3600 AS hours FROM sea GROUP BY ALL),
    voy AS (SELECT l.mmsi, CAST(l.leg AS BIGINT) AS leg, depart, arrive, points, distance_nm, hours, distance_nm / nullif(hours, 0) AS avg_knots, max_sog, coalesce(stops, 0) AS stops, CASE WHEN l.leg < stays THEN 'completed' ELSE 'in_progress' END AS status FROM legs l LEFT JOIN halt h ON l.mmsi = h.mmsi AND l.leg = h.leg WHERE l.leg < stays OR (stays = 0 AND points >= 2) OR (stays > 0 AND points >= 5 AND distance_nm > 1))"""
VOY = f"st AS ({with_views('', ORACLES['bh11_port_stays'])}), {LEGS}"
add("bh13_voyages", lambda s, d: V.legs(D.tracks(s, d), stays(s, d)), f"WITH {VOY} SELECT * FROM voy")
add("bh14_voyage_summary", lambda s, d: V.legs(D.tracks(s, d), stays(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("hours"), F.sum("distance_nm").alias("distance_nm"), F.countDistinct("mmsi").alias("vessels")), f"WITH {VOY} SELECT status, count(*) AS n, sum(hours) AS hours, sum(distance_nm) AS distance_nm, count(DISTINCT mmsi) AS vessels FROM voy GROUP BY 1")
SCORES = {"entry": "info", "exit": "info", "loiter": "alert", "speed": "warning", "silence": "critical"}
FLAG_RISK = {"PA": 0.6, "LR": 0.55, "RU": 0.8, "CN": 0.5, "NO": 0.1, "DE": 0.1, "GB": 0.1, "US": 0.15}


def alerts(s, d):
    a = V.geofence_alerts(D.tracks(s, d), ZONES)
    rule = F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])
    return a.withColumns({"severity": F.try_element_at(rule, F.col("rule")), "id": F.concat_ws("|", "zone", "rule")})


def identities(s, d):
    """Vessels with a type and name that follow from their number."""
    t = D.tracks(s, d).groupBy("mmsi").agg(F.avg("sog").alias("avg_sog"))
    m = F.col("mmsi")
    kind = F.element_at(F.array(*map(F.lit, (30, 70, 80, 25, 79))), (m % 5 + 1).cast("int"))
    name = F.when(m % 7 == 0, "test").when(m % 7 == 1, "").when(m % 7 == 2, F.lit(None)).otherwise(F.concat(F.lit("MV "), m.cast("string")))
    return t.select("mmsi", "avg_sog", V.flag_of(m, FLAGS).alias("flag"), kind.alias("ship_type"), name.alias("name"), F.when(m % 3 == 0, m * 7).alias("imo"))


MAP = "CASE mmsi // 1000000 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in FLAGS.items()) + " END"
IDENTITY = f"""v AS (SELECT mmsi, avg(sog) AS s, {MAP} AS flag, [30, 70, 80, 25, 79][mmsi % 5 + 1] AS kind, mmsi % 7 AS n, mmsi % 3 = 0 AS imo FROM tracks GROUP BY mmsi),
    ident AS (SELECT mmsi, least(1.0, CASE WHEN flag IS NULL THEN 0.15 ELSE 0 END + CASE WHEN kind >= 60 AND NOT imo THEN 0.2 ELSE 0 END + CASE WHEN n = 0 THEN 0.15 ELSE 0 END + CASE WHEN n IN (1, 2) AND kind >= 30 THEN 0.1 ELSE 0 END + CASE WHEN kind = 30 AND s > 12 THEN 0.15 ELSE 0 END + CASE WHEN kind IN (70, 79) AND s < 2 AND s > 0 THEN 0.1 ELSE 0 END)::DOUBLE AS identity FROM v)"""
ENCOUNTER = (
    "ef AS (SELECT mmsi, least(1.0, CASE WHEN r >= 3 THEN 0.5 WHEN r >= 1 THEN 0.25 ELSE 0 END + CASE WHEN h >= 2 THEN 0.3 WHEN h >= 1 THEN 0.15 ELSE 0 END "
    "+ CASE WHEN n >= 5 THEN 0.1 ELSE 0 END)::DOUBLE AS encounter FROM (SELECT mmsi, count(*) AS n, count(*) FILTER (kind = 'rendezvous') AS r, count(*) "
    "FILTER (risk IN ('high', 'critical')) AS h FROM (SELECT mmsi_a AS mmsi, kind, risk FROM enc UNION ALL SELECT mmsi_b, kind, risk FROM enc) GROUP BY 1))"
)
add("rk04_encounter_factor", lambda s, d: V.encounter_factor(meetings(s, d)), f"WITH {MET}, {ENCOUNTER} SELECT * FROM ef")
add("rk05_geofence_factor", lambda s, d: V.geofence_factor(alerts(s, d)))
add("rk06_identity_factor", lambda s, d: V.identity_factor(identities(s, d)), f"WITH {IDENTITY} SELECT * FROM ident")


def flag_factor(vessels, scores):
    """The score of a flag; unknown flags are at 0.5."""
    pairs = [F.lit(x) for kv in sorted(scores.items()) for x in kv]
    return vessels.select("mmsi", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("flag")), F.lit(0.5)).alias("flag"))


def composite(s, d):
    seg, who = segments(s, d), identities(s, d)
    factors = {"flag": flag_factor(who, FLAG_RISK), "gap": V.gap_factor(D.tracks(s, d)), "behaviour": V.behaviour_factor(V.behaviour_summary(seg), seg), "encounter": V.encounter_factor(meetings(s, d)), "geofence": V.geofence_factor(alerts(s, d)), "identity": V.identity_factor(who)}
    return V.composite_risk(D.tracks(s, d).select("mmsi").distinct(), factors)


add("rk07_composite", composite)
add("rk08_fleet_summary", lambda s, d: composite(s, d).where("risk >= 10").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("avg_risk"), F.max("risk").alias("max_risk")))
add("gf01_geofence", lambda s, d: V.geofence_alerts(D.tracks(s, d), ZONES))
INSIDE_CIRCLE = f"{km_sql('lat', 'lon', '11.5', '22.0', 3440.065)} <= 45"
add("gf05_zone_states", lambda s, d: V.zone_states(D.tracks(s, d), ZONES), (
    f"WITH z AS (SELECT mmsi, ts, id, 'reserve' AS zone, ({INSIDE}) % 2 = 1 AS inside FROM tracks UNION ALL SELECT mmsi, ts, id, 'anchorage', "
    f"{INSIDE_CIRCLE} FROM tracks), v AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY mmsi, zone ORDER BY ts, id) AS visit FROM z), "
    f"l AS (SELECT *, min(CASE WHEN inside THEN ts END) OVER (PARTITION BY mmsi, zone, visit) AS since FROM v) SELECT mmsi, zone, inside, CASE WHEN inside "
    f"THEN since END AS since, ts AS seen FROM l QUALIFY row_number() OVER (PARTITION BY mmsi, zone ORDER BY ts DESC, id DESC) = 1"
))
add("al04_alert_summary", lambda s, d: alerts(s, d).groupBy("zone", "rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mmsi").alias("vessels"), F.max("ts").alias("newest")))
