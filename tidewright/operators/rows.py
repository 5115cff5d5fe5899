"""Row queries over the domain tables, alerts, insights and the edges that rows imply."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def listed(df: DataFrame, kind: str | None = None, source: str | None = None, start: str | None = None, end: str | None = None, box: tuple[float, float, float, float] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Observations newest first, with their point as GeoJSON and their properties; every filter is optional."""
    for c, v in (("event_type", kind), ("source_name", source)):
        df = df if v is None else df.where(F.col(c) == v)
    df = df if start is None else df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    df = df if end is None else df.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if box:
        df = df.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return df.orderBy(F.desc("ts"), "id").offset(offset).limit(limit).select("id", "ts", "event_type", "source_name", point.alias("geometry"), F.col("props").alias("properties"))


def newest(df: DataFrame, columns: list[str], limit: int = 50, **equal) -> DataFrame:
    """Rows newest first, with optional filters, and how many there are in all."""
    for c, v in equal.items():
        df = df if v is None else df.where(F.col(c) == v)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(F.desc("ts"), "id").limit(limit).select(*columns).crossJoin(total)


def detail(entities: DataFrame, relationships: DataFrame, assessments: DataFrame, entity: str) -> DataFrame:
    """One entity with the relationships on either side and its assessments, as rows of (part, key, value)."""
    own = entities.where(F.col("id") == entity)
    facts = own.select(F.lit("entity").alias("part"), F.explode(F.create_map(*[x for c in ("name", "entity_type", "country", "sector") for x in (F.lit(c), F.col(c))])).alias("key", "value"))
    out = relationships.where(F.col("source_id") == entity).select(F.lit("outgoing").alias("part"), F.col("relationship_type").alias("key"), F.col("dest_id").alias("value"))
    back = relationships.where(F.col("dest_id") == entity).select(F.lit("incoming").alias("part"), F.col("relationship_type").alias("key"), F.col("source_id").alias("value"))
    marks = assessments.where(F.concat(F.lit("s"), F.col("entity_id").cast("string")) == entity).groupBy("metric_code").agg(F.round(F.avg("score"), 4).cast("string").alias("value"))
    return facts.unionByName(out).unionByName(back).unionByName(marks.select(F.lit("assessment").alias("part"), F.col("metric_code").alias("key"), "value"))


def box_tables(tables: dict[str, DataFrame], west: float, south: float, east: float, north: float, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """(kind, id) of the rows of several tables in a box and, where they have one, in a time; each up to ``limit``."""
    out = None
    for kind, df in tables.items():
        part = df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
        if "ts" in df.columns:
            part = part if start is None else part.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
            part = part if end is None else part.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
        part = part.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        part = part if limit is None else part.orderBy("id").limit(limit)
        out = part if out is None else out.unionByName(part)
    return out


def linked(near: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Entities (id) with the number of rows of each table that point to them from any of its columns."""
    for name, (df, columns) in tables.items():
        ends = df.select(F.explode(F.array(*columns)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias(name))
        near = near.join(ends, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return near


def in_zones(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Points in the zones of a table (zone, ring: array of (x, y)): its boxes first, then ray casting. The zones are
    reference data, sent whole."""
    x, y = (lambda v: v["x"], lambda v: v["y"])
    z = zones.where(F.size("ring") >= 3).select("zone", "ring", *[f(F.transform("ring", g)).alias(n) for n, f, g in (("w", F.array_min, x), ("e", F.array_max, x), ("s", F.array_min, y), ("n", F.array_max, y))])
    met = points.join(F.broadcast(z), F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    after = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    crosses = F.zip_with("ring", after, lambda a, b: ((a["y"] > F.col("lat")) != (b["y"] > F.col("lat"))) & (F.col("lon") < (b["x"] - a["x"]) * (F.col("lat") - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return met.where(F.size(F.filter(crosses, lambda c: c)) % 2 == 1).select(*points.columns, "zone")


def vessel_number(source: Column, identifier: Column, payload: Column) -> Column:
    """The MMSI in a payload, else, for AIS sources, the second part of the identifier."""
    return F.coalesce(F.nullif(F.get_json_object(payload, "$.mmsi"), F.lit("")), F.when(source.startswith("AIS"), F.nullif(F.split_part(identifier, F.lit("-"), F.lit(2)), F.lit(""))))


def identity_edges(e: DataFrame, block: int = 2000) -> DataFrame:
    """Pairs of rows (id, source_name, identifier, payload) of different sources with one MMSI.

    The rows of an MMSI are dealt into blocks of some ``block`` ids, by source. Two blocks of different sources make a cell,
    which is all pairs of theirs: none is made to be dropped, and a busy MMSI is many cells."""
    n = e.select("id", "source_name", vessel_number(F.col("source_name"), F.col("identifier"), F.col("payload")).alias("mmsi")).where("mmsi is not null and source_name is not null and id is not null")
    often = n.groupBy("mmsi").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count_distinct("source_name").alias("sources")).where("sources > 1").drop("sources")
    held = n.join(often, "mmsi").groupBy("mmsi", "source_name", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own")).agg(F.collect_list("id").alias("ids"))
    spark = e.sparkSession
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = held.select("mmsi", F.col("own").alias("i"), other.alias("j"), F.col("source_name").alias("source_a"), F.col("ids").alias("ids_a"))
    b = held.select("mmsi", other.alias("i"), F.col("own").alias("j"), F.col("source_name").alias("source_b"), F.col("ids").alias("ids_b"))
    # A number of parts that is asked for is kept: a cell is few bytes, but much work.
    a, b = (x.repartition(parts, "mmsi", "i", "j") for x in (a, b))
    cells = a.join(b.hint("merge"), ["mmsi", "i", "j"]).where("source_a < source_b")
    pairs = cells.select("mmsi", F.explode("ids_a").alias("x"), "ids_b").select("mmsi", "x", F.explode("ids_b").alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "mmsi")


def correlation_edges(correlations: DataFrame, series: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges between the latest series rows (id, code, ts) of codes that correlate (code_a, code_b, r), as strong as |r|."""
    last = series.groupBy("code").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    c = correlations.where((F.col("code_a") != F.col("code_b")) & (F.abs("r") >= least))
    c = c.join(last.select(F.col("code").alias("code_a"), F.col("id").alias("source_id")), "code_a").join(last.select(F.col("code").alias("code_b"), F.col("id").alias("target_id")), "code_b")
    return c.groupBy("source_id", "target_id").agg(F.max(F.abs("r")).alias("strength"))


def met_pairs(seen: DataFrame, sparse: float = 0.125) -> DataFrame:
    """source_id < target_id: the pairs of ids that were seen at one time (at: long, id: string), each pair once.

    Where the pairs of all times are many next to the pairs of all ids, ids are dealt into blocks and a task has two blocks with
    the times of each id: it marks the pairs met in a table of bits, so no pair is made twice or shuffled. Otherwise few pairs
    come twice, and they are made time by time."""
    e = seen.where("at is not null and id is not null").distinct()
    spark = seen.sparkSession
    n = e.agg(F.count_distinct("id")).collect()[0][0]
    candidates = e.groupBy("at").agg(F.pow(F.count(F.lit(1)), F.lit(2)).alias("n")).agg(F.sum("n")).collect()[0][0] or 0
    if candidates < sparse * n * n:
        met = e.select("at", F.col("id").alias("source_id")).join(e.select("at", F.col("id").alias("target_id")), "at").where("source_id < target_id")
        return met.select("source_id", "target_id").distinct()
    blocks = max(1, -(-n // min(6000, max(500, n // 10))))
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)
    one = e.groupBy("id").agg(F.sort_array(F.collect_list("at")).alias("times")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")
    dealt = dealt.repartition(parts, "i", "j").sortWithinPartitions("i", "j")

    def cell(key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values("id", ignore_index=True)
        # Numbers of rows stand in for ids: they have the same order.
        sides = [np.flatnonzero(rows["own"].to_numpy() == k) for k in key]
        at = []
        for side in sides:
            lists = rows["times"].iloc[side]
            tall = pd.DataFrame({"at": np.concatenate([*lists, np.empty(0, np.int64)]), "place": np.repeat(np.arange(len(side)), lists.map(len).to_numpy(np.int64))})
            at.append({k: g.to_numpy() for k, g in tall.groupby("at")["place"]})
        met = np.zeros((len(sides[0]), len(sides[1])), bool)
        for k in at[0].keys() & at[1].keys():
            met[np.ix_(at[0][k], at[1][k])] = True
        if key[0] == key[1]:
            met = np.triu(met, 1)
        ids, step = rows["id"].to_numpy(), max(1, 200_000 // max(1, len(sides[1])))
        for first in range(0, len(met), step):
            x, y = np.nonzero(met[first : first + step])
            if len(x):
                x, y = sides[0][x + first], sides[1][y]
                yield pd.DataFrame({"source_id": ids[np.minimum(x, y)], "target_id": ids[np.maximum(x, y)]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for key, rows in batch.groupby(["i", "j"]):
                if key != at and held:
                    yield from cell(at, pd.concat(held, ignore_index=True))
                    held = []
                at = key
                held.append(rows)
        if held:
            yield from cell(at, pd.concat(held, ignore_index=True))

    return dealt.mapInPandas(cells, "source_id string, target_id string")


def transform_edges(relationships: DataFrame, series: DataFrame, events: DataFrame) -> DataFrame:
    """Edges that a batch implies: its relationships, entities to their series, and entities met in one event batch (hour)."""
    own = relationships.select("source_id", F.col("dest_id").alias("target_id"), F.col("relationship_type").alias("edge_type"))
    has = series.select(F.col("country").alias("source_id"), F.col("code").alias("target_id"), F.lit("HAS_SERIES").alias("edge_type")).distinct()
    hour = F.unix_seconds(F.date_trunc("hour", "ts").cast("timestamp"))
    met = met_pairs(events.select(hour.alias("at"), F.col("entity_id").cast("string").alias("id")))
    return own.unionByName(has).unionByName(met.select("source_id", "target_id", F.lit("CO_OCCURS").alias("edge_type")))


def backfilled(builders: dict) -> dict[str, int | str]:
    """Runs edge builders one after the other, each written or failed for itself; rows or the failure of each."""
    out: dict[str, int | str] = {}
    for name, build in builders.items():
        try:
            out[name] = build()
        except Exception as bad:  # noqa: BLE001
            out[name] = f"failed: {bad}"
    return out


def acknowledged(alerts: DataFrame, marks: DataFrame) -> DataFrame:
    """Alerts with the status of the last mark (id, status, at) set on them; new ones are open."""
    last = marks.groupBy("id").agg(F.max_by("status", "at").alias("marked"))
    return alerts.join(last, "id", "left").withColumn("status", F.coalesce("marked", F.lit("open"))).drop("marked")


def full_scan(detectors: dict) -> tuple[DataFrame | None, dict[str, str]]:
    """The alerts (detector, severity, n) of all detectors that run; one that fails is reported and stops no other."""
    out, failed = None, {}
    for name, detect in detectors.items():
        try:
            part = detect().groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("detector"), "severity", "n")
            out = part if out is None else out.unionByName(part)
        except Exception as bad:  # noqa: BLE001
            failed[name] = str(bad)
    return out, failed


def critic(reviews: DataFrame) -> DataFrame:
    """Of reviews (item, round, and four scores): the weighted score, the mean of an item's rounds so far, and whether the score
    has settled: it moved by under 0.05 since the round before."""
    score = 0.35 * F.col("evidence") + 0.30 * F.col("logic") + 0.20 * F.col("novelty") + 0.15 * F.col("impact")
    order = W.partitionBy("item").orderBy("round")
    r = reviews.select("item", "round", score.alias("score"))
    return r.withColumns({"mean": F.avg("score").over(order), "settled": F.coalesce(F.abs(F.col("score") - F.lag("score").over(order)) < 0.05, F.lit(False))})


def best_thoughts(nodes: DataFrame, children: DataFrame, least: float, k: int) -> DataFrame:
    """Of the nodes (id, score) that stay and whose parent (child id, parent_id) stays or that have none, the ``k`` best."""
    stay = nodes.where(F.col("score") >= least)
    parent = stay.join(children.select("id", "parent_id"), "id", "left")
    kept = parent.join(stay.select(F.col("id").alias("parent_id"), F.lit(True).alias("held")), "parent_id", "left").where("parent_id is null or held")
    return kept.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def embedding_rows(entities: DataFrame, series: DataFrame, buckets: int = 64) -> DataFrame:
    """Texts of entities and series by template, one a (source_id, source_type), with the counts of their words by hashed bucket."""
    text = lambda *c: F.concat_ws(" | ", *c)
    e = entities.select(F.col("id").cast("string").alias("source_id"), F.lit("entity").alias("source_type"), text("name", "entity_type", "country", "sector").alias("text"))
    s = series.groupBy("code", "country", "commodity").agg(F.count(F.lit(1)).alias("n")).select(text("code", "country", "commodity").alias("source_id"), F.lit("series").alias("source_type"), F.concat_ws(" | ", "code", "commodity", "country").alias("text"))
    one = e.unionByName(s).dropDuplicates(["source_id", "source_type"])
    words = F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))
    return one.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.size(F.filter(place, lambda p: p == i))))


def edge_statistics(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges in all, by edge type and by the type of the node they start from, with the mean strength to 4 places."""
    by = lambda df, part, c: df.groupBy(c.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("strength").cast("double")), 4).alias("avg_strength")).select(F.lit(part).alias("part"), "name", "n", "avg_strength")
    typed = edges.join(entities.select(F.col("id").alias("source_id"), "entity_type"), "source_id", "left")
    return by(edges, "total", F.lit("all")).unionByName(by(edges, "edge type", F.col("relationship_type"))).unionByName(by(typed, "source type", F.coalesce("entity_type", F.lit("none"))))


def correlation_scan(semantic: DataFrame, spatial: DataFrame, temporal: DataFrame, clusters: DataFrame, top: int = 3) -> DataFrame:
    """All findings (kind, key, confidence), the surest first: like texts, places shared (sure at ten meetings), the ``top``
    lags of each pair of series, and clusters (sure at five members)."""
    key = lambda *c: F.concat_ws("~", *[F.col(x).cast("string") for x in c])
    lag = W.partitionBy("code_a", "code_b").orderBy(F.desc(F.abs("r")), "lag")
    best = temporal.where("r is not null and not isnan(r)").withColumn("rank", F.row_number().over(lag)).where(F.col("rank") <= top)
    parts = [
        semantic.select(F.lit("semantic").alias("kind"), key("source_id", "target_id").alias("key"), F.col("strength").cast("double").alias("confidence")),
        spatial.select(F.lit("spatial").alias("kind"), key("source_a", "source_b", "type_a", "type_b").alias("key"), F.least(F.lit(1.0), F.col("n") / 10).alias("confidence")),
        best.select(F.lit("temporal").alias("kind"), key("code_a", "code_b", "lag").alias("key"), F.abs("r").alias("confidence")),
        clusters.select(F.lit("cluster").alias("kind"), key("cluster").alias("key"), F.least(F.lit(1.0), F.col("size") / 5).alias("confidence")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.orderBy(F.desc("confidence"), "kind", "key")


def decision_tree(facts: DataFrame, ancestors: DataFrame, edges: DataFrame, community: DataFrame, entity: str, top: int = 50) -> DataFrame:
    """What is known of one entity as rows (part, key, value): its detail, its ancestry with the depth, its ``top`` strongest
    edges and its community."""
    lines = ancestors.select(F.lit("ancestry").alias("part"), F.concat_ws(">", "parent_id", "child_id").alias("key"), F.col("depth").cast("string").alias("value"))
    own = edges.where((F.col("source_id") == entity) | (F.col("dest_id") == entity)).orderBy(F.desc("strength"), "source_id", "dest_id", "relationship_type").limit(top)
    strong = own.select(F.lit("edge").alias("part"), F.concat_ws(">", "source_id", "dest_id", "relationship_type").alias("key"), F.col("strength").cast("string").alias("value"))
    group = community.where(F.col("node") == entity).select(F.lit("community").alias("part"), F.col("node").alias("key"), F.col("community").cast("string").alias("value"))
    return facts.unionByName(lines).unionByName(strong).unionByName(group)
