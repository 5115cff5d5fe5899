"""Row queries, alerts, insights and implied edges with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.common import Scratch, table
from tidewright.operators import network as N
from tidewright.operators import olap as O
from tidewright.operators import records as R
from tidewright.operators import rows as X
from tidewright.operators import spatial as S
from tidewright.plans import olap as PO
from tidewright.plans.spatial import INSIDE, RING
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}


def add(name, run, views="", sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(views, sql)


add(
    "fp11_observations",
    lambda s, d: X.listed(D.events(s, d), source="src2", box=(-100, -50, 100, 50), limit=40, offset=10).drop("geometry"),
    "ev",
    "SELECT id, ts, event_type, source_name, props AS properties FROM ev WHERE source_name = 'src2' AND lon BETWEEN -100 AND 100 AND lat BETWEEN -50 AND 50 ORDER BY ts DESC, id LIMIT 40 OFFSET 10",
)
add("fp12_series_page", lambda s, d: X.newest(D.time_series(s, d), ["id", "ts", "code", "value"], code="2-HIGH"), "time_series", (
    "SELECT id, ts, code, value, (SELECT count(*) FROM time_series WHERE code = '2-HIGH') AS total FROM time_series WHERE code = '2-HIGH' ORDER BY ts DESC, "
    "id LIMIT 50"
))
add("fp12_event_page", lambda s, d: X.newest(D.events(s, d), ["id", "ts", "event_type", "impact"], source_name="src1"), "ev", (
    "SELECT id, ts, event_type, impact, (SELECT count(*) FROM ev WHERE source_name = 'src1') AS total FROM ev WHERE source_name = 'src1' ORDER BY ts DESC, "
    "id LIMIT 50"
))
# Line numbers of the stored lines come twice, so pages of them are compared by time.
add("fp12_flow_page", lambda s, d: X.newest(D.flows(s, d), ["ts"], flow_type="R"), "flows", "SELECT ts, (SELECT count(*) FROM flows WHERE flow_type = 'R') AS total FROM flows WHERE flow_type = 'R' ORDER BY ts DESC, id LIMIT 50")
add("fp12_assessment_page", lambda s, d: X.newest(D.assessments(s, d), ["ts"], assessor="F"), "assessments", "SELECT ts, (SELECT count(*) FROM assessments WHERE assessor = 'F') AS total FROM assessments WHERE assessor = 'F' ORDER BY ts DESC, id LIMIT 50")
add(
    "fp13_entity_detail",
    lambda s, d: X.detail(D.entities(s, d), D.relationships(s, d), D.assessments(s, d), "s7"),
    "entities relationships assessments",
    (
        "SELECT 'entity' AS part, unnest(['name', 'entity_type', 'country', 'sector']) AS key, unnest([name, entity_type, country, sector]) AS value FROM "
        "entities WHERE id = 's7' UNION ALL SELECT 'outgoing', relationship_type, dest_id FROM relationships WHERE source_id = 's7' UNION ALL SELECT "
        "'incoming', relationship_type, source_id FROM relationships WHERE dest_id = 's7' UNION ALL SELECT 'assessment', metric_code, CAST(round(avg(score), 4) "
        "AS VARCHAR) FROM assessments WHERE entity_id = 7 GROUP BY 2"
    ),
)
add(
    "ge07_box_tables",
    lambda s, d: X.box_tables({"entities": D.entities(s, d), "events": D.events(s, d), "tracks": D.tracks(s, d)}, -60, -30, 60, 30, "2024-01-01", "2024-12-31"),
    "entities ev tracks",
    (
        "SELECT 'entities' AS kind, id FROM entities WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30 UNION ALL SELECT 'events', CAST(id AS VARCHAR) "
        "FROM ev WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30 AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-31' UNION ALL SELECT "
        "'tracks', CAST(id AS VARCHAR) FROM tracks WHERE lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 30 AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP "
        "'2024-12-31'"
    ),
)
add(
    "ge08_radius_linked",
    lambda s, d: X.linked(S.around(D.entities(s, d), 0.0, 0.0, 3000.0).select("id"), {"relationships": (D.relationships(s, d), ["source_id", "dest_id"]), "flows": (D.flows(s, d), ["source_id", "dest_id"]), "orders": (table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("c")), ["c"])}),
    "entities relationships flows",
    (
        "WITH n AS (SELECT id FROM entities WHERE sqrt(lat * lat + lon * lon) <= 3000 / 111.32) SELECT id, (SELECT count(*) FROM relationships WHERE source_id "
        "= n.id) + (SELECT count(*) FROM relationships WHERE dest_id = n.id) AS relationships, (SELECT count(*) FROM flows WHERE source_id = n.id) + (SELECT "
        "count(*) FROM flows WHERE dest_id = n.id) AS flows, (SELECT count(*) FROM orders WHERE 'c' || o_custkey = n.id) AS orders FROM n"
    ),
)


def zones(s):
    square = [(21.0, 10.5), (21.5, 10.5), (21.5, 11.0), (21.0, 11.0)]
    return s.createDataFrame([("reserve", RING), ("square", square), ("line", square[:2])], "zone string, ring array<struct<x: double, y: double>>")


add("jn20_points_in_zone_table", lambda s, d: X.in_zones(D.tracks(s, d).select("id", "lat", "lon"), zones(s)).select("id", "zone"), "tracks", (
    f"SELECT id, 'reserve' AS zone FROM tracks WHERE ({INSIDE}) % 2 = 1 UNION ALL SELECT id, 'square' FROM tracks WHERE lat >= 10.5 AND lat < 11.0 AND lon "
    f">= 21.0 AND lon < 21.5"
))


def numbered(s, d):
    e, k = D.events(s, d), F.col("id")
    source = F.when(k % 3 == 0, "AIS-north").when(k % 3 == 1, "registry").otherwise("other")
    payload = F.when(k % 3 == 1, F.to_json(F.struct((k % 50).cast("string").alias("mmsi")))).otherwise("{}")
    return e.select("id", source.alias("source_name"), F.concat(F.lit("v-"), (k % 50).cast("string")).alias("identifier"), payload.alias("payload"))


add("jn13_vessel_identity", lambda s, d: X.identity_edges(numbered(s, d)), "ev", (
    "WITH n AS (SELECT id, id % 3 AS source, CAST(id % 50 AS VARCHAR) AS mmsi FROM ev WHERE id % 3 <> 2) SELECT a.id AS id_a, b.id AS id_b, a.mmsi FROM n a "
    "JOIN n b ON a.mmsi = b.mmsi AND a.id < b.id AND a.source <> b.source"
))
add(
    "jn21_feedback",
    lambda s, d: table(s, d, "documents").select("doc_id", F.col("n_chars")).join(table(s, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("avg_chars")),
    "",
    "SELECT quality, toxic, count(*) AS n, avg(n_chars) AS avg_chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
)
DAILY = "daily AS (SELECT code, date_trunc('day', ts) AS day, avg(value) AS value FROM time_series WHERE value IS NOT NULL GROUP BY 1, 2)"
add(
    "gr05_correlation_edges",
    lambda s, d: X.correlation_edges(O.lagged_correlation(O.daily_series(D.time_series(s, d)), (0,)), D.time_series(s, d)),
    "time_series",
    (
        f"WITH {DAILY}, c AS (SELECT a.code AS ca, b.code AS cb, abs(corr(a.value, b.value)) AS r FROM daily a JOIN daily b ON a.day = b.day AND a.code < b.code "
        f"GROUP BY 1, 2 HAVING count(*) >= 20), l AS (SELECT code, id FROM time_series QUALIFY row_number() OVER (PARTITION BY code ORDER BY ts DESC, id DESC) = "
        f"1) SELECT x.id AS source_id, y.id AS target_id, r AS strength FROM c JOIN l x ON ca = x.code JOIN l y ON cb = y.code"
    ),
)
add(
    "gr01_transform_edges",
    lambda s, d: X.transform_edges(D.relationships(s, d), D.time_series(s, d), D.events(s, d)),
    "relationships time_series ev",
    (
        "SELECT source_id, dest_id AS target_id, relationship_type AS edge_type FROM relationships UNION ALL SELECT DISTINCT country, code, 'HAS_SERIES' FROM "
        "time_series UNION ALL SELECT DISTINCT CAST(a.entity_id AS VARCHAR), CAST(b.entity_id AS VARCHAR), 'CO_OCCURS' FROM ev a JOIN ev b ON "
        "date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND CAST(a.entity_id AS VARCHAR) < CAST(b.entity_id AS VARCHAR)"
    ),
)


def marks(s, d):
    return D.events(s, d).where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, "closed").otherwise("acknowledged").alias("status"), "ts").withColumnRenamed("ts", "at")


add(
    "al03_alert_query",
    lambda s, d: X.acknowledged(O.zscore_scan(D.time_series(s, d), threshold=1.8).select("id", "code", "ts", "severity"), marks(s, d)).where("severity = 'MEDIUM' and code <> '5-LOW'").orderBy(F.desc("ts"), "id").limit(50),
    "time_series ev",
    (
        f"WITH {PO.SCAN}, a AS (SELECT id, code, ts, CASE WHEN abs(z_score) >= 5 THEN 'CRITICAL' WHEN abs(z_score) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS "
        f"severity FROM scan WHERE abs(z_score) >= 1.8) SELECT a.*, CASE WHEN a.id IN (SELECT id FROM ev WHERE id % 8 = 0) THEN 'closed' WHEN a.id IN (SELECT id "
        f"FROM ev WHERE id % 4 = 0) THEN 'acknowledged' ELSE 'open' END AS status FROM a WHERE severity = 'MEDIUM' AND code <> '5-LOW' ORDER BY ts DESC, id "
        f"LIMIT 50"
    ),
)


def scanned(s, d):
    ts = D.time_series(s, d)
    detectors = {"anomaly": lambda: O.zscore_scan(ts, threshold=1.8), "density": lambda: O.density_alerts(D.events(s, d)), "change point": lambda: O.cusum(O.daily_series(ts), sensitivity=0.002).withColumn("severity", F.lit("MEDIUM"))}
    return X.full_scan(detectors)[0]


add("al02_full_scan", scanned)
add("ca03_critic", lambda s, d: X.critic(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("round")).agg(F.max(F.col("l_quantity") / 50.0).cast("double").alias("evidence"), F.max(1 - F.col("l_discount")).cast("double").alias("logic"), F.max(1 - F.col("l_tax")).cast("double").alias("novelty"), F.max(F.col("l_discount") * 10).cast("double").alias("impact"))), "", (
    "WITH r AS (SELECT l_orderkey AS item, l_linenumber AS round, 0.35::DOUBLE * max(l_quantity / 50.0::DOUBLE) + 0.30::DOUBLE * max(1 - "
    "l_discount)::DOUBLE + 0.20::DOUBLE * max(1 - l_tax)::DOUBLE + 0.15::DOUBLE * max(l_discount * 10)::DOUBLE AS score FROM lineitem GROUP BY 1, 2) SELECT "
    "item, round, score, avg(score) OVER w AS mean, coalesce(abs(score - lag(score) OVER w) < 0.05, false) AS settled FROM r WINDOW w AS (PARTITION BY item "
    "ORDER BY round)"
))
add("ca04_best_thoughts", lambda s, d: X.best_thoughts(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("score")), table(s, d, "customer").where("c_custkey > 10").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 10).alias("parent_id")), 0.0, 25), "", (
    "WITH n AS (SELECT c_custkey AS id, c_acctbal::DOUBLE AS score FROM customer WHERE c_acctbal >= 0) SELECT id, score FROM n WHERE id <= 10 OR id // 10 "
    "IN (SELECT id FROM n) ORDER BY score DESC, id LIMIT 25"
))
add("vc06_embedding_rows", lambda s, d: X.embedding_rows(D.entities(s, d), D.time_series(s, d)).select("source_id", "source_type", "text", F.aggregate("vector", F.lit(0), lambda a, x: a + x).alias("words")), "entities time_series", (
    "WITH t AS (SELECT id AS source_id, 'entity' AS source_type, concat_ws(' | ', name, entity_type, country, sector) AS text FROM entities UNION ALL "
    "SELECT DISTINCT concat_ws(' | ', code, country, commodity), 'series', concat_ws(' | ', code, commodity, country) FROM time_series) SELECT source_id, "
    "source_type, text, CAST(len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS INTEGER) AS words FROM t"
))
add(
    "io12_stripped_text",
    lambda s, d: table(s, d, "pages").select("page_id", R.slug(F.col("url")).alias("slug"), R.html_stripped(F.col("html")).alias("text")),
    "",
    (
        r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, "
        r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS text FROM pages"
    ),
)
add(
    "ln01_lineage_nodes",
    lambda s, d: record_lineage(s, d),
    "",
    (
        "SELECT 'record' AS kind, o_orderstatus AS source, count(*) AS nodes, CAST(NULL AS BIGINT) AS edges FROM orders GROUP BY 2 UNION ALL SELECT 'promoted', "
        "o_orderstatus, count(DISTINCT (l_orderkey, l_linenumber)), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2"
    ),
)


def record_lineage(s, d):
    """Nodes of records and of what was made of them, with the edges between, by source."""
    o, li = table(s, d, "orders"), table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    records = o.groupBy(F.col("o_orderstatus").alias("source")).agg(F.count(F.lit(1)).alias("nodes")).select(F.lit("record").alias("kind"), "source", "nodes", F.lit(None).cast("long").alias("edges"))
    made = li.groupBy(F.col("o_orderstatus").alias("source")).agg(F.countDistinct("l_orderkey", "l_linenumber").alias("nodes"), F.count(F.lit(1)).alias("edges"))
    return records.unionByName(made.select(F.lit("promoted").alias("kind"), "source", "nodes", "edges"))


add(
    "ob10_briefing",
    lambda s, d: briefing(s, d),
    "tracks ev",
    (
        "SELECT 'vessels' AS part, 'all' AS name, count(DISTINCT mmsi) AS n FROM tracks UNION ALL SELECT 'fixes', 'all', count(*) FROM tracks UNION ALL SELECT "
        "'ship_type', CAST(mmsi % 5 AS VARCHAR), count(DISTINCT mmsi) FROM tracks GROUP BY 2 UNION ALL SELECT 'event_type', event_type, count(*) FROM ev GROUP "
        "BY 2 UNION ALL SELECT 'source', source_name, count(*) FROM ev GROUP BY 2 UNION ALL SELECT 'latest', event_type, count(*) FROM (SELECT * FROM ev ORDER "
        "BY ts DESC, id LIMIT 100) GROUP BY 2"
    ),
)


def briefing(s, d):
    """Vessels and fixes, vessels by type, observations by type and source, and the latest hundred by type."""
    t, e = D.tracks(s, d), D.events(s, d)
    one = lambda df, part, n: df.agg(n.alias("n")).select(F.lit(part).alias("part"), F.lit("all").alias("name"), "n")
    by = lambda df, part, c, n=None: df.groupBy(c.alias("name")).agg((n if n is not None else F.count(F.lit(1))).alias("n")).select(F.lit(part).alias("part"), "name", "n")
    parts = [one(t, "vessels", F.countDistinct("mmsi")), one(t, "fixes", F.count(F.lit(1))), by(t, "ship_type", (F.col("mmsi") % 5).cast("string"), F.countDistinct("mmsi")), by(e, "event_type", F.col("event_type")), by(e, "source", F.col("source_name")), by(e.orderBy(F.desc("ts"), "id").limit(100), "latest", F.col("event_type"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


add(
    "gr12_edge_statistics",
    lambda s, d: X.edge_statistics(D.relationships(s, d), D.entities(s, d)),
    "relationships entities",
    "SELECT 'total' AS part, 'all' AS name, count(*) AS n, round(avg(strength::DOUBLE), 4) AS avg_strength FROM relationships UNION ALL SELECT 'edge type', relationship_type, count(*), round(avg(strength::DOUBLE), 4) FROM relationships GROUP BY 2 "
    "UNION ALL SELECT 'source type', coalesce(entity_type, 'none'), count(*), round(avg(strength::DOUBLE), 4) FROM relationships LEFT JOIN entities ON source_id = id GROUP BY 2",
)


def scan(s, d):
    from tidewright.plans.network import vectors

    events = D.events(s, d)
    return X.correlation_scan(N.semantic_edges(vectors(s, d)), S.co_occurrence(events, 6.0, 28), O.lagged_correlation(O.daily_series(D.time_series(s, d))), S.cluster_summary(events, S.place_clusters(events, 200.0, 3)))


def tree(s, d):
    from tidewright.plans.knowledge import lineage

    edges = Scratch(s, "supply").save(D.relationships(s, d), "edges")
    return X.decision_tree(X.detail(D.entities(s, d), edges, D.assessments(s, d), "c7"), R.ancestry(lineage(s, d), "c7"), edges, N.communities(edges), "c7")


add("sy05_correlation_scan", scan)
add("ln05_decision_tree", tree)
