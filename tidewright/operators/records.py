"""Entity resolution, calibration, record mapping, promotion and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewright.common import Scratch

#: The URL namespace of name-based UUIDs.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def without_null_island(df: DataFrame) -> DataFrame:
    origin = (F.col("lat") == 0) & (F.col("lon") == 0)
    return df.withColumns({c: F.when(~origin, F.col(c)) for c in ("lat", "lon")})


def merged_ids(edges: DataFrame, same: DataFrame) -> DataFrame:
    """Edges with merged ids (``same``: drop_id → keep_id) put in place of those dropped."""
    for c in ("source_id", "dest_id"):
        edges = edges.join(same.select(F.col("drop_id").alias(c), F.col("keep_id").alias("__keep")), c, "left").withColumn(c, F.coalesce("__keep", c)).drop("__keep")
    return edges


def calibration(scored: DataFrame, buckets: int = 10) -> DataFrame:
    """Per equal bucket of confidence (the last is closed): how sure, how often right, the gap and the Brier score."""
    b = F.least(F.floor(F.col("confidence") * buckets), F.lit(buckets - 1)).cast("int")
    g = scored.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("predicted"), F.avg(F.col("outcome").cast("double")).alias("correct"), F.avg(F.pow(F.col("confidence") - F.col("outcome"), 2)).alias("brier"))
    return g.withColumn("gap", F.abs(F.col("predicted") - F.col("correct")))


def upsert(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def unpivoted(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "code", "value").where("value is not null")


def html_stripped(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"[\x20\x09-\x0D]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def dms(text: Column) -> Column:
    """ddd-mm.m with a hemisphere letter, as degrees; null if there is none."""
    at = lambda i: F.nullif(F.regexp_extract(text, r"(\d{1,3})-(\d{1,2}(?:\.\d+)?)([NSEW])", i), F.lit(""))
    return (at(1).cast("double") + at(2).cast("double") / 60) * F.when(at(3).isin("S", "W"), -1).otherwise(1)


def ancestry(edges: DataFrame, start: str, depth: int = 10) -> DataFrame:
    """Edges on the way up from ``start`` (child → parent), each with its least depth: a frontier a round, stored, so that a round
    reads the edges once, and none is walked where nothing new is above."""
    scratch = Scratch(edges.sparkSession, "ancestry")
    e = edges.select("parent_id", "child_id")
    front, out = e.where(F.col("child_id") == start), None
    for d in range(depth):
        front = scratch.save(front.distinct().withColumn("depth", F.lit(d)), f"depth-{d}")
        out = front if out is None else out.unionByName(front)
        if d + 1 == depth or front.isEmpty():
            break
        up = e.join(front.select(F.col("parent_id").alias("child_id")).distinct(), "child_id").select("parent_id", "child_id")
        front = up.join(out.select("parent_id", "child_id"), ["parent_id", "child_id"], "left_anti")
    return out.groupBy("parent_id", "child_id").agg(F.min("depth").alias("depth"))


def first_of_group(e: DataFrame, key: str) -> DataFrame:
    """drop_id → keep_id: every id of a group to the smallest of it."""
    least = e.groupBy(key).agg(F.min("id").alias("keep_id"))
    return e.select(F.col("id").alias("drop_id"), key).join(least, key).select("drop_id", "keep_id")


def exact_pairs(e: DataFrame, confidence: float = 0.95) -> DataFrame:
    a, b = (e.select("identifier", "entity_type", F.col("id").alias(f"id_{x}"), F.col("source_name").alias(f"source_{x}")) for x in "ab")
    return a.join(b, ["identifier", "entity_type"]).where("source_a < source_b").select("id_a", "id_b", F.lit(confidence).alias("confidence"))


def typed_edges(r: DataFrame, types: dict[str, str]) -> DataFrame:
    """Relationship kinds as edge types; others are RELATES_TO, and a missing strength is 1."""
    key = F.upper(F.regexp_replace(F.trim("relationship_type"), r"[\s-]+", "_"))
    kind = F.lit("RELATES_TO")
    for k, v in types.items():
        kind = F.when(key == k, v).otherwise(kind)
    return r.select("source_id", "dest_id", kind.alias("edge_type"), F.coalesce("strength", F.lit(1.0)).alias("strength"))


def within_budget(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The longest run of rows from the start of each group whose texts fit a number of bytes."""
    used = F.sum(F.octet_length(F.coalesce(text, F.lit("")))).over(W.partitionBy(group).orderBy(order, text).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget).select(group, order)


def quarter_month(year: Column) -> Column:
    part = year - F.floor(year)
    return F.when(part < 0.25, 2).when(part < 0.5, 5).when(part < 0.75, 8).otherwise(11)


def filled_days(events: DataFrame, days: int) -> DataFrame:
    """Counts by day and type over the last days of the table, with zeros where there are none."""
    last = events.agg(F.max(F.to_date("ts")).alias("t")).select(F.explode(F.sequence(F.date_sub("t", days - 1), F.col("t"))).alias("day"))
    grid = last.crossJoin(F.broadcast(events.select("event_type").distinct()))
    n = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"))


RECORD = T.StructType([T.StructField("source_name", T.StringType()), T.StructField("source_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("payload", T.StringType())])
