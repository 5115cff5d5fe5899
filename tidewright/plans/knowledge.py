"""Graph, vector, resolution, mapping and lineage queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.common import table
from tidewright.operators import graph as G
from tidewright.operators import records as R
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}


def add(name, run, views="", sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(views, sql)


def rel(s, d):
    return D.relationships(s, d)


def lineage(s, d):
    """Orders come from customers, lines from orders."""
    o = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("parent_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("child_id"))
    li = table(s, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent_id"), F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("child_id"))
    return o.unionByName(li)


BOTH = "e AS (SELECT source_id AS a, dest_id AS b FROM relationships UNION SELECT dest_id, source_id FROM relationships)"
WEIGHTED = (
    "w AS (SELECT a, b, count(*)::DOUBLE AS w FROM (SELECT source_id AS a, dest_id AS b FROM relationships UNION ALL SELECT dest_id, source_id FROM "
    "relationships) GROUP BY 1, 2), p AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM w)"
)
COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"
LINEAGE = "lin AS (SELECT 'c' || o_custkey AS parent_id, 'o' || o_orderkey AS child_id FROM orders UNION SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem)"

# Too many walks for SQL on a graph this dense: held against brute force on a small one in the tests.
add("rl02_components", lambda s, d: G.min_label_components(rel(s, d)))
add("gr11_bridges", lambda s, d: G.bridges(rel(s, d), "R", "A"), "relationships", (
    "WITH n AS ((SELECT source_id AS n FROM relationships WHERE relationship_type = 'R' UNION SELECT dest_id FROM relationships WHERE relationship_type = "
    "'R') INTERSECT (SELECT source_id FROM relationships WHERE relationship_type = 'A' UNION SELECT dest_id FROM relationships WHERE relationship_type = "
    "'A')) SELECT source_id, dest_id, relationship_type FROM relationships WHERE source_id IN (SELECT n FROM n) OR dest_id IN (SELECT n FROM n)"
))
add("gr14_pagerank", lambda s, d: G.pagerank(rel(s, d)))
add("gr15_degree_centrality", lambda s, d: (b := G.both_ways(rel(s, d))).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree")).crossJoin(F.broadcast(b.agg(F.countDistinct("a").alias("nodes")))).select("id", (F.col("degree").cast("double") / (F.col("nodes") - 1)).alias("centrality")), "relationships", f"WITH {BOTH} SELECT a AS id, count(*)::DOUBLE / ((SELECT count(DISTINCT a) FROM e) - 1) AS centrality FROM e GROUP BY 1")
add("gr21_structural_holes", lambda s, d: G.constraint(rel(s, d)), "relationships", "WITH " + WEIGHTED + (
    ", t AS (SELECT x.a, y.b, sum(x.p * y.p) AS via FROM p x JOIN p y ON x.b = y.a AND x.a <> y.b GROUP BY 1, 2) SELECT p.a AS id, sum(pow(p.p + "
    "coalesce(via, 0), 2)) AS \"constraint\" FROM p LEFT JOIN t ON p.a = t.a AND p.b = t.b GROUP BY 1"
))
add("vc02_similar", lambda s, d: G.similar_to(table(s, d, "embeddings"), 7), "", (
    f"SELECT v.vec_id, v.label, {COS.format('v.embedding', 'q.embedding')} AS similarity FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id = 7) q "
    f"WHERE v.vec_id <> 7 ORDER BY 3 DESC, 1 LIMIT 10"
))
add("vc07_index_statistics", lambda s, d: G.index_statistics(table(s, d, "embeddings")), "", "SELECT label, count(*) AS n, avg(len(embedding)) AS dims FROM embeddings GROUP BY 1")
add("er07_merge", lambda s, d: R.merged_ids(rel(s, d).select("source_id", "dest_id"), R.first_of_group(D.entities(s, d).where("entity_type = 'supplier'"), "identifier")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "relationships entities", (
    "WITH m AS (SELECT id, min(id) OVER (PARTITION BY identifier) AS keep_id FROM entities WHERE entity_type = 'supplier') SELECT coalesce(m.keep_id, "
    "source_id) AS source_id, count(*) AS n FROM relationships LEFT JOIN m ON source_id = m.id GROUP BY 1"
))
add("ca01_calibration", lambda s, d: R.calibration(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("confidence"), F.col("quality").alias("outcome"))), "", (
    "WITH x AS (SELECT least(n_chars / 4000.0::DOUBLE, 1.0) AS confidence, quality AS outcome FROM documents JOIN labels USING (doc_id)) SELECT "
    "CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bucket, count(*) AS n, avg(confidence) AS predicted, avg(outcome::DOUBLE) AS correct, "
    "avg(pow(confidence - outcome, 2)) AS brier, abs(avg(confidence) - avg(outcome::DOUBLE)) AS gap FROM x GROUP BY 1"
))
add("tr02_null_island", lambda s, d: R.without_null_island(D.events(s, d).select("id", F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(F.col("id") % 7 == 0, 0.0).otherwise(F.col("lon")).alias("lon"))), "ev", (
    "SELECT id, CASE WHEN id % 7 <> 0 AND NOT (lat = 0 AND lon = 0) THEN lat END AS lat, CASE WHEN id % 7 <> 0 AND NOT (lat = 0 AND lon = 0) THEN lon END "
    "AS lon FROM ev"
))
add("tr03_deterministic_id", lambda s, d: D.events(s, d).select("id", R.uuid5(F.concat("source_name", F.lit(":"), F.col("id").cast("string"))).alias("uuid")))
add("tr05_unpivot", lambda s, d: R.unpivoted(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]), "", (
    "SELECT l_orderkey, l_linenumber, 'l_quantity' AS code, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', "
    "l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"
))
add("tr12_upsert", lambda s, d: R.upsert(D.events(s, d).select("entity_id", "source_name", "ts", "id", "impact"), ["entity_id", "source_name"], [F.desc("ts"), F.desc("id")]), "ev", "SELECT entity_id, source_name, ts, id, impact FROM ev QUALIFY row_number() OVER (PARTITION BY entity_id, source_name ORDER BY ts DESC, id DESC) = 1")
add("ln02_ancestry", lambda s, d: R.ancestry(lineage(s, d), "l7-1"), "", (
    f"WITH RECURSIVE {LINEAGE}, up AS (SELECT parent_id, child_id, 0 AS depth FROM lin WHERE child_id = 'l7-1' UNION SELECT l.parent_id, l.child_id, "
    f"up.depth + 1 FROM lin l JOIN up ON l.child_id = up.parent_id WHERE up.depth < 9) SELECT parent_id, child_id, min(depth) AS depth FROM up GROUP BY 1, 2"
))
add("ln03_impact", lambda s, d: R.ancestry(lineage(s, d).select(F.col("child_id").alias("parent_id"), F.col("parent_id").alias("child_id")), "c7", 4), "", (
    f"WITH RECURSIVE {LINEAGE}, dn AS (SELECT child_id AS parent_id, parent_id AS child_id, 0 AS depth FROM lin WHERE parent_id = 'c7' UNION SELECT "
    f"l.child_id, l.parent_id, dn.depth + 1 FROM lin l JOIN dn ON l.parent_id = dn.parent_id WHERE dn.depth < 3) SELECT parent_id, child_id, min(depth) AS "
    f"depth FROM dn GROUP BY 1, 2"
))
add("ln04_coverage", lambda s, d: D.events(s, d).groupBy("source_name", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "ev", "SELECT source_name, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY 1, 2")
add("cx03_dms", lambda s, d: D.events(s, d).select("id", F.concat(F.lit("at "), (F.col("id") % 90).cast("string"), F.lit("-"), (F.col("id") % 60).cast("string"), F.lit(".5"), F.when(F.col("id") % 2 == 0, "N").otherwise("S")).alias("t")).select("id", R.dms(F.col("t")).alias("degrees")), "ev", "SELECT id, (id % 90 + (id % 60 + 0.5::DOUBLE) / 60) * CASE WHEN id % 2 = 0 THEN 1 ELSE -1 END AS degrees FROM ev")
add("cx06_longitude_360", lambda s, d: D.events(s, d).select("id", F.pmod("lon", F.lit(360.0)).alias("lon360")), "ev", "SELECT id, ((lon % 360) + 360) % 360 AS lon360 FROM ev")

DEG = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM relationships UNION ALL SELECT dest_id FROM relationships) GROUP BY id)"
TOP = f"{DEG}, top AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 200)"
add("gr02_synced_edges", lambda s, d: R.typed_edges(rel(s, d), {"R": "SUPPLIES", "A": "REGULATES"}), "relationships", (
    "SELECT source_id, dest_id, CASE relationship_type WHEN 'R' THEN 'SUPPLIES' WHEN 'A' THEN 'REGULATES' ELSE 'RELATES_TO' END AS edge_type, "
    "coalesce(strength, 1.0) AS strength FROM relationships"
))
add("gr10_subgraph", lambda s, d: G.induced(rel(s, d), D.entities(s, d).where("entity_type = 'supplier' or sector = 'ASIA'").select("id")), "relationships entities", (
    "WITH n AS (SELECT id FROM entities WHERE entity_type = 'supplier' OR sector = 'ASIA') SELECT source_id, dest_id, relationship_type FROM relationships "
    "WHERE source_id IN (SELECT id FROM n) AND dest_id IN (SELECT id FROM n)"
))
add("gr24_top_subgraph", lambda s, d: G.induced(rel(s, d), G.top_nodes(rel(s, d), 200)), "relationships", f"WITH {TOP} SELECT source_id, dest_id, relationship_type FROM relationships WHERE source_id IN (SELECT id FROM top) AND dest_id IN (SELECT id FROM top)")
add("gr22_cross_domain", lambda s, d: G.cross_domain(rel(s, d), D.entities(s, d)), "relationships entities", (
    "WITH e AS (SELECT source_id AS a, dest_id AS b FROM relationships UNION SELECT dest_id, source_id FROM relationships) SELECT a AS id, count(DISTINCT "
    "sector) AS domains, count(DISTINCT sector) * count(*) AS score FROM e JOIN entities n ON e.b = n.id GROUP BY 1 HAVING count(DISTINCT sector) > 1"
))
add("jn22_top_nodes", lambda s, d: D.entities(s, d).select("id", "name").join(G.top_nodes(rel(s, d), 200), "id"), "relationships entities", f"WITH {TOP} SELECT e.id, name FROM entities e JOIN top ON e.id = top.id")
add("er02_exact_identifier", lambda s, d: R.exact_pairs(D.entities(s, d).withColumn("entity_type", F.col("sector"))), "entities", (
    "SELECT a.id AS id_a, b.id AS id_b, 0.95::DOUBLE AS confidence FROM entities a JOIN entities b ON a.identifier = b.identifier AND a.sector = b.sector "
    "AND a.source_name < b.source_name"
))
add("ca05_truncation", lambda s, d: R.within_budget(table(s, d, "conversations"), "conv_id", "turn", "text", 2000), "", (
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn, text) AS used FROM "
    "conversations) WHERE used <= 2000"
))
add("cx11_quarter_of_decimal_year", lambda s, d: D.events(s, d).select("id", (2000 + F.col("quality")).alias("y")).select("id", R.quarter_month(F.col("y")).alias("month")), "ev", (
    "SELECT id, CASE WHEN (2000 + quality) - floor(2000 + quality) < 0.25 THEN 2 WHEN (2000 + quality) - floor(2000 + quality) < 0.5 THEN 5 WHEN (2000 + "
    "quality) - floor(2000 + quality) < 0.75 THEN 8 ELSE 11 END AS month FROM ev"
))
add("cx17_filled_histogram", lambda s, d: R.filled_days(D.events(s, d), 14), "ev", (
    "WITH last AS (SELECT max(CAST(ts AS DATE)) AS t FROM ev), days AS (SELECT t - CAST(i AS INTEGER) AS day FROM last, range(14) r(i)), kinds AS (SELECT "
    "DISTINCT event_type FROM ev) SELECT day, k.event_type, count(e.id) AS n FROM days CROSS JOIN kinds k LEFT JOIN ev e ON CAST(e.ts AS DATE) = day AND "
    "e.event_type = k.event_type GROUP BY 1, 2"
))
