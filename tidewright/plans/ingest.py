"""Ingest and decoding queries with the SQL that checks them: texts in the odd formats are made of the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.common import table
from tidewright.sources import decoding as X
from tidewright.sources import domain as D
from tidewright.sources import ingest as I
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}


def add(name, run, views, sql):
    QUERIES[name] = run
    ORACLES[name] = with_views(views, sql)


def ad_hoc(s, d):
    I.attached(s, {"lineitem": f"{d}/lineitem.parquet", "nowhere": f"{d}/nowhere.parquet"}, "own")
    return I.sql(s, "SELECT l_returnflag, count(*) AS n FROM own_lineitem WHERE l_quantity > :least GROUP BY l_returnflag", {"least": 25})


add("io02_ad_hoc_sql", ad_hoc, "", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")


def observed(s, d):
    e = D.events(s, d)
    mmsi = F.when(F.col("id") % 3 == 0, F.col("entity_id").cast("string")).when(F.col("id") % 3 == 1, "unknown")
    value = F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 10 + 0.5)
    return I.observations(e.select("source_name", F.col("id").cast("string").alias("source_id"), F.col("ts").alias("timestamp"), mmsi.alias("mmsi"), "lat", "lon", value.alias("depth"), F.col("event_type").alias("what")))


OBSERVATION = """SELECT source_name, CAST(id AS VARCHAR) AS source_id, CAST(ts AS TIMESTAMP) AS timestamp, CAST(NULL AS VARCHAR) AS obs_type, CASE WHEN id % 3 = 0 THEN entity_id END AS mmsi, lat, lon, CAST(NULL AS DOUBLE) AS quality,
    CASE WHEN id % 4 = 0 THEN '{"what":"' || event_type || '"}' ELSE '{"depth":' || (id % 10) || '.5,"what":"' || event_type || '"}' END AS payload FROM ev"""
add("io14_observations", observed, "ev", OBSERVATION)
add(
    "io20_client_feed",
    lambda s, d: I.feed(D.events(s, d).withColumn("severity", F.when(F.col("impact") > 50, "high").otherwise("low")), (-50, -30, 50, 30), ["click", "view", "purchase"], ["high"]).select("id", "severity"),
    "ev",
    "SELECT id, 'high' AS severity FROM ev WHERE lon BETWEEN -50 AND 50 AND lat BETWEEN -30 AND 30 AND event_type IN ('click', 'view', 'purchase') AND impact > 50",
)


def centroids(s, d):
    e = D.entities(s, d)
    corner = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    ring = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 2.0), corner(0.0, 0.0))
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    multi = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
    text = F.when(F.col("source_name") == "crm", F.to_json(polygon)).otherwise(F.to_json(multi))
    lon, lat = X.geojson_centroid(text)
    return e.select("id", F.round(lon, 6).alias("clon"), F.round(lat, 6).alias("clat"))


add("cx01_ring_centroid", centroids, "entities", "SELECT id, round((lon + lon + 1 + lon + 1 + lon) / 4, 6) AS clon, round((lat + lat + lat + 2 + lat) / 4, 6) AS clat FROM entities")


def stat_rows(s, d):
    """Counts by nation and market segment as one JSON-stat text a region, decoded again."""
    c, nation = table(s, d, "customer"), table(s, d, "nation")
    seg = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    place = F.array_position(F.array(*map(F.lit, seg)), F.col("c_mktsegment")) - 1
    j = c.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    g = j.groupBy("n_regionkey", "n_nationkey", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    of = g.groupBy("n_regionkey").agg(F.sort_array(F.collect_set("n_name")).alias("names"), F.collect_list(F.struct("n_name", place.alias("p"), "n")).alias("cells"))
    index = lambda names: F.map_from_arrays(names, F.transform(names, lambda x: F.array_position(names, x) - 1))
    flat = F.map_from_entries(F.transform("cells", lambda x: F.struct(((F.array_position("names", x["n_name"]) - 1) * 5 + x["p"]).cast("string"), x["n"])))
    category = lambda c: F.struct(F.struct(c.alias("index")).alias("category"))
    dims = F.struct(category(index(F.col("names"))).alias("nation"), category(F.create_map(*[x for i, v in enumerate(seg) for x in (F.lit(v), F.lit(i))])).alias("segment"))
    text = F.to_json(F.struct(F.array(F.lit("nation"), F.lit("segment")).alias("id"), F.array(F.size("names"), F.lit(5)).alias("size"), flat.alias("value"), dims.alias("dimension")))
    return X.json_stat(of.select("n_regionkey", text.alias("text")), "text").select("n_regionkey", F.col("at")["nation"].alias("nation"), F.col("at")["segment"].alias("segment"), "value")


add("cx02_json_stat", stat_rows, "", "SELECT n_regionkey, n_name AS nation, c_mktsegment AS segment, count(*)::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")


def coordinates(s, d):
    deg, minute = F.floor(F.abs("lat")).cast("string"), (F.col("id") % 60).cast("string")
    text = F.when(F.col("id") % 3 == 0, F.round("lat", 1).cast("string")).when(F.col("id") % 3 == 1, F.concat(deg, F.lit("-"), minute, F.lit("-30 "), F.when(F.col("lat") < 0, "S").otherwise("N"))).otherwise("near the coast")
    return D.events(s, d).select("id", F.round(X.coordinate(text), 6).alias("at"))


add("cx04_coordinates", coordinates, "ev", (
    "SELECT id, round(CASE WHEN id % 3 = 0 THEN round(lat, 1) WHEN id % 3 = 1 THEN (floor(abs(lat)) + (id % 60) / 60.0 + 30 / 3600.0) * CASE WHEN lat < 0 "
    "THEN -1 ELSE 1 END END, 6) AS at FROM ev"
))


def positions(s, d):
    part = lambda c, minus, plus: F.concat(F.floor(F.abs(c)).cast("string"), F.lit("-"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(".5"), F.when(F.col(c) < 0, minus).otherwise(plus))
    lat, lon = X.position(F.concat(F.lit("Derelict adrift in "), part("lat", "S", "N"), F.lit(" "), part("lon", "W", "E"), F.lit(" and 10-00.0N 010-00.0E")))
    return D.events(s, d).select("id", F.round(lat, 6).alias("plat"), F.round(lon, 6).alias("plon"))


SIDE = "(floor(abs({0})) + (id % 60 + 0.5) / 60) * CASE WHEN {0} < 0 THEN -1 ELSE 1 END"
add("cx03_position_pairs", positions, "ev", f"SELECT id, round({SIDE.format('lat')}, 6) AS plat, round({SIDE.format('lon')}, 6) AS plon FROM ev")
add(
    "cx05_zulu_dates",
    lambda s, d: D.events(s, d).select("id", X.zulu(F.when(F.col("id") % 5 != 0, F.concat(F.lit("CANCEL "), F.date_format("ts", "ddHHmm"), F.lit("Z "), F.upper(F.date_format("ts", "MMM")), F.lit(" "), F.date_format("ts", "yyyy"), F.lit("."))).otherwise("no date")).alias("at")),
    "ev",
    "SELECT id, CASE WHEN id % 5 <> 0 THEN CAST(date_trunc('minute', ts) AS TIMESTAMP) END AS at FROM ev",
)
add("cx07_first_by_vessel", lambda s, d: X.keep_first(D.tracks(s, d).select("mmsi", "ts", "id", "sog"), "mmsi", ["ts", "id"]), "tracks", "SELECT mmsi, ts, id, sog FROM tracks QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts, id) = 1")
add(
    "cx09_score_means",
    lambda s, d: X.score_means(D.time_series(s, d).withColumns({"year": F.year("ts"), "value": (F.col("id") % 7).cast("double")}), ["country", "year"], "code", "value", {"urgent": "urgent", "low": "LOW"}),
    "time_series",
    (
        "SELECT country, year(ts) AS year, round(avg(id % 7), 2) AS overall, round(avg(id % 7) FILTER (code ILIKE '%urgent%'), 2) AS urgent, round(avg(id % 7) "
        "FILTER (code ILIKE '%low%'), 2) AS low FROM time_series GROUP BY ALL"
    ),
)
add(
    "cx10_missing_markers",
    lambda s, d: X.marked_numbers(D.events(s, d).select("id", F.when(F.col("id") % 3 == 0, " MM ").otherwise((F.col("id") % 9).cast("string")).alias("wave"), F.when(F.col("id") % 5 == 0, "MM").otherwise("2.5").alias("wind")), ["wave", "wind"]),
    "ev",
    (
        "SELECT id, CASE WHEN id % 3 <> 0 THEN (id % 9)::DOUBLE END AS wave, CASE WHEN id % 5 <> 0 THEN 2.5 END AS wind, '{' || concat_ws(',', CASE WHEN id % 3 "
        "<> 0 THEN '\"wave\":' || (id % 9) || '.0' END, CASE WHEN id % 5 <> 0 THEN '\"wind\":2.5' END) || '}' AS payload FROM ev"
    ),
)


def listed(s, d):
    e = D.entities(s, d)
    schema = F.when(F.col("source_name") == "scm", "Vessel").otherwise("Person")
    return e.select("id", schema.alias("schema"), F.col("name").alias("caption"), F.array("country", "sector").alias("names"), F.col("identifier").alias("imo"))


add("cx13_sanctions_search", lambda s, d: X.sanctioned(listed(s, d), "america").select("id"), "entities", "SELECT id FROM entities WHERE name ILIKE '%america%' OR country ILIKE '%america%' OR sector ILIKE '%america%' OR identifier ILIKE '%america%'")
add("cx13_sanctioned_vessels", lambda s, d: X.sanctioned(listed(s, d)).select("id", "caption"), "entities", "SELECT id, name AS caption FROM entities WHERE source_name = 'scm'")
REGIONS = {"nation_1": "north", "nation_12": "east", "ation_2": "south", "nation_21": "west", "nation_": "open sea"}
add(
    "cx14_keyword_region",
    lambda s, d: table(s, d, "nation").select("n_name", X.region_of(F.col("n_name"), REGIONS, "elsewhere").alias("region")),
    "",
    (
        "SELECT n_name, CASE WHEN n_name ILIKE '%nation_12%' THEN 'east' WHEN n_name ILIKE '%nation_21%' THEN 'west' WHEN n_name ILIKE '%nation_1%' THEN "
        "'north' WHEN n_name ILIKE '%ation_2%' THEN 'south' WHEN n_name ILIKE '%nation_%' THEN 'open sea' ELSE 'elsewhere' END AS region FROM nation"
    ),
)
add("cx15_vessel_lines", lambda s, d: X.vessel_lines(table(s, d, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 4 == 0, "a ship").otherwise("a car")).alias("line"))), "", "SELECT o_orderkey, o_orderpriority || ',a ship' AS line FROM orders WHERE o_orderkey % 4 = 0")
add("cx16_grid_plan", lambda s, d: X.grid_plan(s, 10.0, -5.0, 14.0, -4.2, 6), "", "SELECT i, j, 10 + i * (4.0 / 6) AS lon, -5 + j * (0.8 / 2) AS lat FROM range(6) a(i), range(2) b(j)")
