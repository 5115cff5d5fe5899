"""Graph traversal and centrality over edge tables. Loops write each round to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.common import Scratch, spread_join
from tidewright.operators.components import connected_components


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def min_label_components(edges: DataFrame, hops: int = 10) -> DataFrame:
    """id → the smallest id within ``hops`` steps. One aggregation and join a step."""
    scratch = Scratch(edges.sparkSession, "labels")
    e = scratch.save(both_ways(edges), "edges")
    labels = scratch.save(e.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")), "labels-0")
    for i in range(1, hops + 1):
        near = e.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("other"))
        new = scratch.save(labels.join(near, "id", "left").select("id", F.least("label", "other").alias("label")), f"labels-{i}")
        if not new.join(labels.withColumnRenamed("label", "old"), "id").where("label <> old").limit(1).count():
            break
        labels = new
    return new


def neighbourhood(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """Nodes by their distance from ``start`` over undirected edges: a frontier met with the edges, less what was seen."""
    scratch = Scratch(edges.sparkSession, "walk")
    e = scratch.save(both_ways(edges), "edges")
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1).select(F.col("id").alias("a"))
        fresh = e.join(front, "a").select(F.col("b").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = scratch.save(seen.unionByName(fresh), f"seen-{d}")
    return seen


def simple_paths(edges: DataFrame, start: str, goal: str, depth: int = 5, limit: int = 50) -> DataFrame:
    """Directed paths without repeated nodes, shortest first, of at most ``depth`` (up to 10) steps. Longer ones are not
    walked once ``limit`` shorter ones are found, and nodes from which the goal is out of reach are not entered."""
    if not 1 <= depth <= 10:
        raise ValueError("depth must be from 1 to 10")
    scratch = Scratch(edges.sparkSession, "paths")
    e = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).distinct()
    e = scratch.save(e, "edges")
    # Steps that are left to the goal, found from its end: a node is worth entering only if they fit.
    left = edges.sparkSession.createDataFrame([(goal, 0)], "b string, left int")
    for d in range(1, depth):
        front = left.where(F.col("left") == d - 1).select("b")
        fresh = e.join(front, "b").select(F.col("a").alias("b")).distinct().join(left.select("b"), "b", "left_anti").withColumn("left", F.lit(d))
        left = scratch.save(left.unionByName(fresh), f"left-{d}")
    e = e.join(left, "b")
    paths, found, many = e.where((F.col("a") == start) & (F.col("left") <= depth - 1)).select(F.array("a", "b").alias("path")), None, 0
    for d in range(1, depth + 1):
        paths = scratch.save(paths, f"paths-{d}")
        hit = paths.where(F.element_at("path", -1) == goal).select("path", F.lit(d).alias("depth"))
        found, many = hit if found is None else found.unionByName(hit), many + hit.count()
        if many >= limit:
            break
        on = paths.where(F.element_at("path", -1) != goal).withColumn("a", F.element_at("path", -1))
        paths = on.join(e.where(F.col("left") <= depth - d - 1), "a").where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
    return found.orderBy("depth", "path").limit(limit).select("depth", F.array_join("path", ">").alias("path"))


def bridges(edges: DataFrame, kind_a: str, kind_b: str) -> DataFrame:
    """Edges that touch a node which has edges of both kinds."""
    ends = lambda k: (x := edges.where(F.col("relationship_type") == k)).select(F.col("source_id").alias("n")).union(x.select("dest_id"))
    n = ends(kind_a).intersect(ends(kind_b))
    cols = ["source_id", "dest_id", "relationship_type"]
    out = edges.join(n.withColumnRenamed("n", "source_id"), "source_id", "left_semi").select(cols)
    return out.union(edges.join(n.withColumnRenamed("n", "dest_id"), "dest_id", "left_semi").select(cols)).distinct()


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Of the undirected graph, weighted by the number of edges between two nodes."""
    scratch = Scratch(edges.sparkSession, "pagerank")
    e = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).where("a <> b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    e = scratch.save(e.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy("a"))), "edges")
    nodes = scratch.save(e.select(F.col("a").alias("id")).distinct(), "nodes")
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        into = e.join(rank.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        new = scratch.save(nodes.join(into, "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("sum", F.lit(0.0))).alias("rank")), f"rank-{i}")
        moved = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = new
        if moved < n * tolerance:
            break
    return rank


def constraint(edges: DataFrame) -> DataFrame:
    """Burt's constraint of every node, over edges weighted by their number.

    What goes through a third node counts only where the two ends are neighbours, so only triangles are sought, not all
    paths of two edges. Edges point to the node of more neighbours: no node has many more than the root of the number
    of edges to point to, whatever its neighbours in all."""
    scratch = Scratch(edges.sparkSession, "constraint")
    e = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).where("a <> b")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    e = scratch.save(e, "edges")
    nodes = scratch.save(e.groupBy("a").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("w")).alias("squares")), "nodes")
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    side = lambda x: nodes.select(F.col("a").alias(x), F.col("all").alias(f"all_{x}"), F.col("n").alias(f"n_{x}"), F.col("n").alias("weight"))
    up = spread_join(spread_join(e, side("a"), "a", "weight", rows), side("b"), "b", "weight", rows)
    up = up.where(F.struct("n_a", "a") < F.struct("n_b", "b")).select("a", "b", (F.col("w") / F.col("all_a")).alias("to"), (F.col("w") / F.col("all_b")).alias("back"))
    up = scratch.save(up, "up")
    # u, v and x, in the order of their numbers of neighbours; uv is the share of u that goes to v. Most nodes of a graph
    # of two sides have edges of one direction only: the others are found before edges are met.
    middle = scratch.save(up.select(F.col("b").alias("v")).distinct().intersect(up.select(F.col("a").alias("v")).distinct()), "middle")
    first = up.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("to").alias("uv"), F.col("back").alias("vu")).join(middle, "v", "left_semi")
    second = up.select(F.col("a").alias("v"), F.col("b").alias("x"), F.col("to").alias("vx"), F.col("back").alias("xv")).join(middle, "v", "left_semi")
    third = up.select(F.col("a").alias("u"), F.col("b").alias("x"), F.col("to").alias("ux"), F.col("back").alias("xu"))
    three = first.join(second, "v").join(third, ["u", "x"])
    ways = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(a + b).alias("p"), (F.col(a + c) * F.col(c + b)).alias("via")) for a, b, c in ("uvx", "vux", "vxu", "xvu", "uxv", "xuv")])
    through = three.select(F.explode(ways).alias("x")).select("x.*").groupBy("a", "b").agg(F.first("p").alias("p"), F.sum("via").alias("via"))
    more = through.groupBy("a").agg(F.sum((2 * F.col("p") + F.col("via")) * F.col("via")).alias("more"))
    return nodes.join(more, "a", "left").select(F.col("a").alias("id"), (F.col("squares") / (F.col("all") * F.col("all")) + F.coalesce("more", F.lit(0.0))).alias("constraint"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges (each pair once), density and the number of connected parts."""
    scratch = Scratch(edges.sparkSession, "summary")
    e = scratch.save(both_ways(edges), "edges")
    roots = connected_components(e.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    # A part's root has no row of its own there.
    parts = roots.agg(F.countDistinct("root").alias("components"))
    g = e.agg(F.countDistinct("a").alias("nodes"), (F.count(F.lit(1)) / 2).cast("long").alias("edges"))
    return g.withColumn("density", 2 * F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0))).crossJoin(parts)


def top_nodes(edges: DataFrame, n: int) -> DataFrame:
    ends = edges.select(F.explode(F.array("source_id", "dest_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ends.orderBy(F.desc("degree"), "id").limit(n).select("id")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    for c in ("source_id", "dest_id"):
        edges = edges.join(nodes.withColumnRenamed("id", c), c, "left_semi")
    return edges.select("source_id", "dest_id", "relationship_type")


def cross_domain(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes whose neighbours are of more than one sector, scored by sectors times neighbours."""
    b = both_ways(edges).join(entities.select(F.col("id").alias("b"), "sector"), "b")
    g = b.groupBy(F.col("a").alias("id")).agg(F.countDistinct("sector").alias("domains"), F.count(F.lit(1)).alias("n"))
    return g.where("domains > 1").select("id", "domains", (F.col("domains") * F.col("n")).alias("score"))


# Vectors


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def similar_to(vectors: DataFrame, item: int, k: int = 10, other_label: bool = False, least: float | None = None) -> DataFrame:
    """The ``k`` nearest by cosine to one row, itself left out, and those below ``least``."""
    one = F.broadcast(vectors.where(F.col("vec_id") == item).select(F.col("embedding").alias("q"), F.col("label").alias("q_label")).limit(1))
    v = vectors.where(F.col("vec_id") != item).crossJoin(one)
    v = v.where("label <> q_label") if other_label else v
    v = v.select("vec_id", "label", cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    v = v if least is None else v.where(F.col("similarity") >= least)
    return v.orderBy(F.desc("similarity"), "vec_id").limit(k)


def index_statistics(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("embedding")).alias("dims"))
