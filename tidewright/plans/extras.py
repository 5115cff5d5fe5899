"""Queries of the smaller operators with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.common import table
from tidewright.operators import extras as X
from tidewright.operators import olap as O
from tidewright.operators import spatial as S
from tidewright.operators import vessels as V
from tidewright.plans import olap as PO
from tidewright.plans import spatial as PS
from tidewright.plans import vessels as PV
from tidewright.sources import domain as D
from tidewright.sources.domain import with_views

QUERIES, ORACLES = {}, {}
#: Risk by flag, and event pairs with the longest time between them in seconds.
FLAG_RISK = {"PA": 0.6, "LR": 0.55, "RU": 0.8, "CN": 0.5, "NO": 0.1, "DE": 0.1, "GB": 0.1, "US": 0.15}
TEMPLATES = [("click", "purchase", 1800), ("view", "click", 600), ("error", "login", 3600), ("login", "view", 900)]


def add(name, run, views="", sql=None):
    QUERIES[name] = run
    if sql:
        ORACLES[name] = with_views(views, sql)


def flags(s, d):
    return D.tracks(s, d).select("mmsi").distinct().withColumn("flag", V.flag_of(F.col("mmsi"), PV.FLAGS))


FLAG_SQL = "fl AS (" + PV.ORACLES["bh16_flags"].split(") SELECT DISTINCT", 1)[1].join(["SELECT DISTINCT", ")"])
CCF = (
    f"m1 AS ({PO.MONTHLY.format(PO.A)}), m2 AS ({PO.MONTHLY.format(PO.B)}), za AS (SELECT row_number() OVER (ORDER BY period) AS rn, (avg_value - "
    f"avg(avg_value) OVER ()) / stddev_pop(avg_value) OVER () AS z, count(*) OVER () AS n FROM m1), zb AS (SELECT row_number() OVER (ORDER BY period) AS rn, "
    f"(avg_value - avg(avg_value) OVER ()) / stddev_pop(avg_value) OVER () AS z, count(*) OVER () AS n FROM m2)"
)

add("ts14_cross_correlation", lambda s, d: X.cross_correlation(O.monthly(D.time_series(s, d), PO.A), O.monthly(D.time_series(s, d), PO.B)), "time_series", (
    f"WITH {CCF} SELECT CAST(zb.rn - za.rn AS INTEGER) AS lag, sum(za.z * zb.z) / max(least(za.n, zb.n)) AS r FROM za JOIN zb ON abs(zb.rn - za.rn) <= 90 "
    f"GROUP BY 1"
))
add("bh07_current", lambda s, d: X.current_behaviour(V.classified(V.features(V.windows(D.tracks(s, d))))), "tracks", f"WITH {PV.FEAT} SELECT mmsi, behaviour, end_ts FROM kind QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY w DESC) = 1")
add("rk01_flag_factor", lambda s, d: X.flag_factor(flags(s, d), FLAG_RISK), "tracks", f"WITH {FLAG_SQL} SELECT mmsi, CASE flag " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FLAG_RISK.items()) + " ELSE 0.5 END::DOUBLE AS flag FROM fl")
add("sy03_templates", lambda s, d: X.template_counts(S.follow_counts(D.events(s, d), sorted({m for _, _, m in TEMPLATES})), s.createDataFrame(TEMPLATES, "type_a string, type_b string, max_s int")), "ev", "WITH t(type_a, type_b, max_s) AS (VALUES " + ", ".join(f"('{a}', '{b}', {m})" for a, b, m in TEMPLATES) + (
    f") SELECT type_a, type_b, max_s, count(*) AS n FROM {PS.FOLLOWS} JOIN t ON a.event_type = type_a AND b.event_type = type_b WHERE {PS.LAG} <= max_s "
    f"GROUP BY 1, 2, 3"
))
add("ca02_lifecycle", lambda s, d: X.lifecycle(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("confidence"), F.col("quality").alias("feedback"))), "", (
    "SELECT d.doc_id AS id, least(n_chars / 4000.0::DOUBLE, 1.0) AS confidence, CASE WHEN quality = 1 THEN 'confirmed' WHEN quality = 0 THEN 'rejected' "
    "WHEN least(n_chars / 4000.0::DOUBLE, 1.0) >= 0.6 THEN 'promoted' ELSE 'candidate' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = "
    "l.doc_id"
))
add("ca04_pruned", lambda s, d: X.pruned(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id")), 0.0).select("id", "parent_id"), "", "SELECT o_orderkey AS id, o_custkey AS parent_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
