"""The domain tables (time series, entities, flows, events, ...) as projections of the stored tables.

``SQL`` has the same projections for the checking engine, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.common import table


def _lat(key):
    return (key * 7919 % 1200) / F.lit(10.0) - 60


def _lon(key):
    return (key * 104729 % 3000) / F.lit(10.0) - 150


def time_series(s: SparkSession, d: str) -> DataFrame:
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    return j.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("code"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("commodity"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("source_name"))


def entities(s: SparkSession, d: str) -> DataFrame:
    n, r = table(s, d, "nation"), table(s, d, "region")
    places = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))

    def side(name, p, kind, source):
        t = table(s, d, name)
        key = F.col(f"{p}_custkey" if p == "c" else f"{p}_suppkey")
        t = t.join(places, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        return t.select(F.concat(F.lit(p), key.cast("string")).alias("id"), kind.alias("entity_type"), F.col(f"{p}_name").alias("name"), F.col("n_nationkey").cast("string").alias("identifier"), F.col("n_name").alias("country"), F.col("r_name").alias("sector"), F.lit(source).alias("source_name"), _lat(key).alias("lat"), _lon(key).alias("lon"), F.col(f"{p}_acctbal").alias("balance"))

    return side("customer", "c", F.col("c_mktsegment"), "crm").unionByName(side("supplier", "s", F.lit("supplier"), "scm"))


def flows(s: SparkSession, d: str) -> DataFrame:
    li, o, p = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "part")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("flow_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dest_id"), F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("amount"), F.col("p_type").alias("commodity"), F.col("l_linestatus").alias("currency"))


def relationships(s: SparkSession, d: str) -> DataFrame:
    """One edge for each pair of supplier and customer and kind of return."""
    f = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = f.groupBy("l_suppkey", "o_custkey", "l_returnflag").agg(F.max("l_discount").alias("strength"))
    return g.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dest_id"), F.col("l_returnflag").alias("relationship_type"), "strength")


def events(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("event_id").alias("id"), "ts", "event_type", F.col("value").alias("impact"), F.col("user_id").alias("entity_id"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source_name"), _lat(F.col("event_id")).alias("lat"), _lon(F.col("event_id")).alias("lon"), (F.col("value") / 1000).alias("quality"), "props")


def assessments(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("metric_code"), F.col("l_linestatus").alias("assessor"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("score"))


def claims(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("claimant_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("target_value"), F.col("o_orderdate").alias("deadline"), (F.col("o_orderkey") % 121).cast("double").alias("progress"))


def tracks(s: SparkSession, d: str) -> DataFrame:
    """Vessel fixes five minutes apart, on slow walks, with a gap of three hours after each 23."""
    e = table(s, d, "events")
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = e.select("event_id", "user_id", "value", k.cast("long").alias("k"))
    return e.select(
        F.col("event_id").alias("id"),
        (F.lit(200000000).cast("long") + F.col("user_id") * 1000003 % 500000000).alias("mmsi"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("k") * 5 + F.floor(F.col("k") / 23) * 180).cast("int"))).alias("ts"),
        (10 + F.col("user_id") % 7 * 0.5 + F.col("k") % 50 * 0.02).cast("double").alias("lat"),
        (20 + F.col("user_id") % 11 * 0.5 + F.col("k") % 40 * 0.015).cast("double").alias("lon"),
        (F.col("value") % 15).alias("sog"),
        (F.col("event_id") * 37 % 360).cast("double").alias("cog"),
    )


SQL = {
    "time_series": (
        "SELECT o_orderkey AS id, o_orderpriority AS code, o_orderdate AS ts, o_totalprice AS value, o_orderstatus AS commodity, n_name AS country, "
        "c_mktsegment AS source_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    ),
    "entities": """SELECT 'c' || c_custkey AS id, c_mktsegment AS entity_type, c_name AS name, CAST(n_nationkey AS VARCHAR) AS identifier, n_name AS country, r_name AS sector, 'crm' AS source_name,
        (c_custkey * 7919 % 1200) / 10.0::DOUBLE - 60 AS lat, (c_custkey * 104729 % 3000) / 10.0::DOUBLE - 150 AS lon, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, CAST(n_nationkey AS VARCHAR), n_name, r_name, 'scm',
        (s_suppkey * 7919 % 1200) / 10.0::DOUBLE - 60, (s_suppkey * 104729 % 3000) / 10.0::DOUBLE - 150, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "flows": (
        "SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS flow_type, 's' || l_suppkey AS source_id, 'c' || o_custkey AS dest_id, l_shipdate AS ts, "
        "l_extendedprice AS amount, p_type AS commodity, l_linestatus AS currency FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = "
        "p_partkey"
    ),
    "relationships": (
        "SELECT 's' || l_suppkey AS source_id, 'c' || o_custkey AS dest_id, l_returnflag AS relationship_type, max(l_discount) AS strength FROM lineitem JOIN "
        "orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey, l_returnflag"
    ),
    "ev": (
        "SELECT event_id AS id, ts, event_type, value AS impact, user_id AS entity_id, 'src' || (user_id % 5) AS source_name, (event_id * 7919 % 1200) / "
        "10.0::DOUBLE - 60 AS lat, (event_id * 104729 % 3000) / 10.0::DOUBLE - 150 AS lon, value / 1000 AS quality, props FROM events"
    ),
    "assessments": "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS entity_id, l_returnflag AS metric_code, l_linestatus AS assessor, l_shipdate AS ts, l_quantity AS score FROM lineitem",
    "claims": (
        "SELECT o_orderkey AS id, o_custkey AS claimant_id, o_orderstatus AS status, o_totalprice AS target_value, o_orderdate AS deadline, CAST(o_orderkey % "
        "121 AS DOUBLE) AS progress FROM orders"
    ),
    "tracks": """SELECT event_id AS id, 200000000 + user_id * 1000003 % 500000000 AS mmsi, TIMESTAMP '2024-01-01' + to_minutes(CAST(k * 5 + (k // 23) * 180 AS INTEGER)) AS ts,
        10 + CAST(user_id % 7 AS DOUBLE) * 0.5 + CAST(k % 50 AS DOUBLE) * 0.02 AS lat, 20 + CAST(user_id % 11 AS DOUBLE) * 0.5 + CAST(k % 40 AS DOUBLE) * 0.015 AS lon, value % 15 AS sog, CAST(event_id * 37 % 360 AS DOUBLE) AS cog
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)""",
}


def with_views(names: str, sql: str) -> str:
    """``sql`` after the named views and whatever common table expressions it starts with."""
    sql = sql.strip()
    if not names:
        return sql
    start = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.startswith(w)), "")
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"{start or 'WITH '}{views}{', ' if start else ' '}{sql[len(start):]}"
