"""Entity resolution, nearest neighbour and network queries with the SQL that checks them.

Resolution runs over two sources made of the customers: names are hexadecimal words, and the second source drops or
changes letters, so the share of matching blocks of each pair is known and no other names are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.common import Scratch, table
from tidewright.operators import graph as G
from tidewright.operators import network as N
from tidewright.operators import resolution as E
from tidewright.plans.knowledge import COS, lineage
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}


def add(name, run, views="", sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(views, sql)


def twins(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    h = F.md5(k.cast("string").cast("binary"))
    name = F.concat(F.substring(h, 1, 8), F.lit(" "), F.substring(h, 9, 6))
    other = F.when(k % 3 == 0, F.substring(name, 1, 14)).when(k % 3 == 1, F.concat(F.substring(name, 1, 13), F.lit("zz"))).otherwise(name)
    lat, lon = (k * 7919 % 1200) / F.lit(10.0) - 60, (k * 104729 % 3000) / F.lit(10.0) - 150
    refs = F.when(k % 4 == 0, F.create_map(F.lit("imo"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))

    def side(x, source, kind, n, shift):
        own = F.create_map(F.lit(f"from_{x}"), F.col("c_mktsegment"), F.lit("both"), F.lit(x))
        return table(s, d, "customer").select(F.concat(F.lit(x), k.cast("string")).alias("id"), F.lit(source).alias("source_name"), kind.alias("entity_type"), n.alias("name"), F.lit(None).cast("string").alias("identifier"), F.lit(None).cast("string").alias("country"), (lat + shift).alias("lat"), lon.alias("lon"), refs.alias("xrefs"), own.alias("payload"))

    return side("a", "crm", F.lit("company"), name, 0.0).unionByName(side("b", "erp", F.when(k % 2 == 0, "company").otherwise("organization"), other, 0.01))


RATIO = "CASE k % 3 WHEN 0 THEN 28.0::DOUBLE / 29 WHEN 1 THEN 26.0::DOUBLE / 30 ELSE 1.0 END"
PAIR = "'a' || k AS id_a, 'b' || k AS id_b, 'crm' AS source_a, 'erp' AS source_b"
K = "c AS (SELECT c_custkey AS k FROM customer)"
NAMES = f"SELECT k, {PAIR}, 'name' AS match, {RATIO} AS confidence FROM c WHERE NOT (k % 3 = 1 AND k % 2 = 1)"
REFS = f"SELECT k, {PAIR}, 'cross_ref_id' AS match, 0.97::DOUBLE AS confidence FROM c WHERE k % 4 = 0"
NEAR = f"SELECT k, {PAIR}, 'spatial_name' AS match, round(0.5 * ({RATIO}) + 0.5 * (1 - 0.01 / (5 / 111.0::DOUBLE)), 4) AS confidence FROM c WHERE k % 2 = 0"


def strategies(s, d, near=0.0):
    t = twins(s, d)
    return [E.identifier_pairs(t), E.cross_reference_pairs(t), E.name_pairs(t), E.spatial_pairs(t, wanted=near)]


FIRST = f"SELECT * FROM (SELECT *, 1 AS rank FROM ({REFS}) UNION ALL SELECT *, 2 FROM ({NAMES}) UNION ALL SELECT *, 3 FROM ({NEAR})) QUALIFY row_number() OVER (PARTITION BY k ORDER BY rank) = 1"
add("er01_duplicates", lambda s, d: E.duplicates(strategies(s, d)), "", f"WITH {K} SELECT id_a, id_b, source_a, source_b, match, confidence FROM ({FIRST})")
add("er03_cross_references", lambda s, d: E.cross_reference_pairs(twins(s, d)), "", f"WITH {K} SELECT id_a, id_b, source_a, source_b, match, confidence, 'imo=' || k AS cross_ref FROM ({REFS})")
add("er05_fuzzy_names", lambda s, d: E.name_pairs(twins(s, d)), "", f"WITH {K} SELECT id_a, id_b, source_a, source_b, match, confidence FROM ({NAMES})")
add("er06_spatial_duplicates", lambda s, d: E.spatial_pairs(twins(s, d)), "", f"WITH {K} SELECT id_a, id_b, source_a, source_b, match, confidence FROM ({NEAR})")
# Places come last in PRIORITY and are not raised: those that round to under 0.95 neither resolve nor take a pair from another.
add("er08_auto_resolved", lambda s, d: E.auto_resolved(E.duplicates(strategies(s, d, near=0.9499))), "", (
    f"WITH {K} SELECT id_a AS keep_id, id_b AS drop_id, match, CASE match WHEN 'cross_ref_id' THEN 1.0 ELSE confidence END AS confidence FROM ({FIRST}) "
    f"WHERE match = 'cross_ref_id' OR confidence >= 0.95"
))


def pairs(s, d):
    t = twins(s, d)
    side = lambda x: t.where(F.col("id").startswith(x)).select(F.substring("id", 2, 20).alias("k"), F.struct(*t.columns).alias(x))
    return side("a").join(side("b"), "k").drop("k")


SCORE = f"(CASE WHEN k % 4 = 0 THEN 0.4 ELSE 0 END + 0.3 * ({RATIO}) + 0.15) / (CASE WHEN k % 4 = 0 THEN 0.85 ELSE 0.45 END)"
add(
    "er09_equivalence",
    lambda s, d: E.equivalence(pairs(s, d)),
    "",
    (
        f"WITH {K}, m AS (SELECT *, {SCORE} AS mean FROM c), u AS (SELECT *, CASE WHEN k % 4 = 0 THEN least(1.0, mean * 1.15) ELSE mean END AS sure FROM m) "
        f"SELECT 'a' || k AS id_a, 'b' || k AS id_b, CASE WHEN k % 4 = 0 THEN 1.0 END AS cross_ref, {RATIO} AS named, CAST(NULL AS DOUBLE) AS taxonomic, 1.0 AS "
        f"spatial, round(CASE WHEN k % 2 = 0 THEN least(1.0, sure * 1.05) ELSE sure END, 4) AS confidence FROM u"
    ),
)
add(
    "er07_merged_entities",
    lambda s, d: E.merged(twins(s, d), E.cross_reference_pairs(twins(s, d)).select(F.col("id_a").alias("keep_id"), F.col("id_b").alias("drop_id"))).select("id", "status", "into", F.concat_ws(",", "provenance").alias("provenance"), F.concat_ws(",", F.sort_array(F.map_keys("payload"))).alias("keys"), F.col("payload")["both"].alias("both")),
    "",
    (
        "WITH c AS (SELECT c_custkey AS k FROM customer) SELECT 'a' || k AS id, 'active' AS status, CAST(NULL AS VARCHAR) AS into, CASE WHEN k % 4 = 0 THEN 'b' "
        "|| k ELSE '' END AS provenance, CASE WHEN k % 4 = 0 THEN 'both,from_a,from_b' ELSE 'both,from_a' END AS keys, 'a' AS both FROM c UNION ALL SELECT 'b' "
        "|| k, CASE WHEN k % 4 = 0 THEN 'merged' ELSE 'active' END, CASE WHEN k % 4 = 0 THEN 'a' || k END, '', 'both,from_b', 'b' FROM c"
    ),
)
KINDS = ", ".join(f"('{k}', '{v}')" for k, v in E.HIERARCHY.items())
add(
    "er10_compatible_types",
    lambda s, d: s.createDataFrame(E.compatible_pairs(), "type_a string, type_b string"),
    "",
    (
        f"WITH RECURSIVE h(kind, parent) AS (VALUES {KINDS}), up(kind, top) AS (SELECT kind, kind FROM h UNION SELECT 'entity', 'entity' UNION SELECT up.kind, "
        f"h.parent FROM up JOIN h ON up.top = h.kind) SELECT DISTINCT a.kind AS type_a, b.kind AS type_b FROM up a JOIN up b ON a.top = b.top WHERE a.kind <> "
        f"b.kind AND (a.top <> 'entity' OR a.kind = 'entity' OR b.kind = 'entity')"
    ),
)
CODES = {f"NATION_{i}": f"N{i}" for i in range(25)}


def countries(s, d):
    n = table(s, d, "nation")
    side = lambda x, name, code: n.select(F.concat(F.lit(x), F.col("n_nationkey").cast("string")).alias("id"), F.lit(x).alias("source_name"), F.lit("country").alias("entity_type"), name.alias("name"), code.alias("identifier"), F.lit(None).cast("string").alias("country"))
    return side("a", F.col("n_name"), F.lit("?")).unionByName(side("b", F.lit("a state"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))


add("er04_country_pairs", lambda s, d: E.country_pairs(countries(s, d), CODES, [frozenset("ab")]), "", (
    "SELECT 'a' || n_nationkey AS id_a, 'b' || n_nationkey AS id_b, 'a' AS source_a, 'b' AS source_b, 'country_normalization' AS match, 0.96::DOUBLE AS "
    "confidence FROM nation"
))


# Neighbours


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("kind"), F.col("embedding").cast("array<double>").alias("v"))


SIM = COS.format("a.embedding", "b.embedding")
add("jn16_lateral_knn", lambda s, d: N.nearest((v := vectors(s, d)).where("id % 20 = 0").select("id", "v"), v.select("id", "v"), 10, 0.0, lists=1).select("probe", "id", F.round("similarity", 6).alias("similarity")), "", (
    f"SELECT a.vec_id AS probe, b.vec_id AS id, round({SIM}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % "
    f"20 = 0 AND {SIM} >= 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.vec_id) <= 10"
))
add("gr04_semantic_edges", lambda s, d: N.semantic_edges(vectors(s, d)))
add("vc04_similar_pairs", lambda s, d: N.semantic_edges(vectors(s, d), 50, 0.7, 50))
add("vc01_search", lambda s, d: G.similar_to(table(s, d, "embeddings"), 3, 20, least=0.3), "", (
    f"SELECT * FROM (SELECT v.vec_id, v.label, {COS.format('v.embedding', 'q.embedding')} AS similarity FROM embeddings v, (SELECT * FROM embeddings WHERE "
    f"vec_id = 3) q WHERE v.vec_id <> 3) WHERE similarity >= 0.3 ORDER BY 3 DESC, 1 LIMIT 20"
))
add("vc03_cross_type", lambda s, d: G.similar_to(table(s, d, "embeddings"), 7, 10, True, least=0.25), "", (
    f"SELECT * FROM (SELECT v.vec_id, v.label, {COS.format('v.embedding', 'q.embedding')} AS similarity FROM embeddings v, (SELECT * FROM embeddings WHERE "
    f"vec_id = 7) q WHERE v.vec_id <> 7 AND v.label <> q.label) WHERE similarity >= 0.25 ORDER BY 3 DESC, 1 LIMIT 10"
))


# Graphs


def two_way(s, d):
    """Supplier to customer by relationship, and each customer back to one other supplier."""
    r = D.relationships(s, d).select("source_id", "dest_id", "relationship_type", F.col("strength").cast("double").alias("strength"))
    back = r.select(F.col("dest_id").alias("source_id"), F.concat(F.lit("s"), (F.substring("dest_id", 2, 20).cast("int") % 10 + 1).cast("string")).alias("dest_id"), F.lit("X").alias("relationship_type"), F.lit(0.5).alias("strength")).distinct()
    return r.unionByName(back)


TWO = (
    "e AS (SELECT DISTINCT * FROM (SELECT source_id, dest_id, relationship_type, strength::DOUBLE AS strength FROM relationships UNION ALL SELECT dest_id, "
    "'s' || (CAST(substr(dest_id, 2) AS INTEGER) % 10 + 1), 'X', 0.5 FROM relationships))"
)
add(
    "gr08_neighbours",
    lambda s, d: N.neighbour_edges(two_way(s, d), "s7", 3),
    "relationships",
    (
        f"WITH RECURSIVE {TWO}, walk AS (SELECT source_id, dest_id, relationship_type, strength, 1 AS depth FROM e WHERE source_id = 's7' OR dest_id = 's7' "
        f"UNION SELECT e.*, w.depth + 1 FROM walk w JOIN e ON (e.source_id = w.dest_id AND w.dest_id <> 's7') OR (e.dest_id = w.source_id AND w.source_id <> "
        f"'s7') WHERE w.depth < 3) SELECT source_id, dest_id, relationship_type, strength, min(depth) AS depth FROM walk GROUP BY ALL"
    ),
)
LIN = (
    "lin AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders UNION SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM "
    "lineitem UNION SELECT 'l' || l_orderkey || '-' || l_linenumber, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM "
    "lineitem)"
)


def product_paths(s, d):
    li = table(s, d, "lineitem")
    to_part = li.select(F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dest_id"))
    edges = lineage(s, d).select(F.col("parent_id").alias("source_id"), F.col("child_id").alias("dest_id")).unionByName(to_part)
    to_supplier = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dest_id"))
    return G.simple_paths(edges.unionByName(to_supplier), "c7", "s3", 5, 50)


add("gr09_simple_paths", product_paths, "", (
    f"WITH RECURSIVE {LIN}, p(path, tail, depth) AS (SELECT [a, b], b, 1 FROM lin WHERE a = 'c7' UNION ALL SELECT list_append(path, b), b, depth + 1 FROM p "
    f"JOIN lin ON a = tail WHERE depth < 5 AND tail <> 's3' AND NOT list_contains(path, b)) SELECT depth, array_to_string(path, '>') AS path FROM p WHERE "
    f"tail = 's3' ORDER BY 1, 2 LIMIT 50"
))
add(
    "gr13_entity_network",
    lambda s, d: N.entity_network(two_way(s, d).select("source_id", "dest_id", "relationship_type"), "s7", 3),
    "relationships",
    (
        f"WITH RECURSIVE {TWO}, x AS (SELECT DISTINCT source_id, dest_id, relationship_type FROM e), near AS (SELECT source_id AS a, dest_id AS b FROM x UNION "
        f"SELECT dest_id, source_id FROM x), walk(id, depth) AS (SELECT 's7', 0 UNION SELECT b, depth + 1 FROM walk JOIN near ON a = id WHERE depth < 2), "
        f"reached AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT DISTINCT x.*, r.depth + 1 AS depth FROM x JOIN reached r ON x.source_id = "
        f"r.id OR x.dest_id = r.id"
    ),
)
add("gr16_betweenness", lambda s, d: N.betweenness(D.relationships(s, d), 100))


def about(s, d):
    return D.entities(s, d).select("id", F.col("entity_type").alias("kind"), F.col("source_name").alias("source"))


def found(s, d):
    """Communities of the supply network, and its edges."""
    edges = Scratch(s, "supply").save(D.relationships(s, d), "edges")
    return edges, N.communities(edges)


add("gr17_communities", lambda s, d: found(s, d)[1])
add("gr18_bridge_nodes", lambda s, d: N.bridge_nodes(*found(s, d), about(s, d)))
add("gr19_graph_view", lambda s, d: N.graph_view(e := Scratch(s, "supply").save(D.relationships(s, d), "edges"), G.pagerank(e), None, about(s, d)))
add("gr20_community_summary", lambda s, d: N.community_summary(found(s, d)[1], about(s, d)))
add(
    "gr23_graph_summary",
    lambda s, d: G.graph_summary(lineage(s, d).select(F.col("parent_id").alias("source_id"), F.col("child_id").alias("dest_id"))),
    "",
    (
        "WITH o AS (SELECT o_custkey, o_orderkey FROM orders), li AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), n AS (SELECT (SELECT "
        "count(DISTINCT o_custkey) FROM o) AS c, (SELECT count(*) FROM (SELECT o_orderkey FROM o UNION SELECT l_orderkey FROM li)) AS k, (SELECT count(*) FROM "
        "li) AS l, (SELECT count(DISTINCT (o_custkey, o_orderkey)) FROM o) AS oe, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey FROM li WHERE l_orderkey "
        "NOT IN (SELECT o_orderkey FROM o))) AS lone) SELECT c + k + l AS nodes, oe + l AS edges, 2 * (oe + l)::DOUBLE / ((c + k + l) * (c + k + l - 1)) AS "
        "density, c + lone AS components FROM n"
    ),
)
