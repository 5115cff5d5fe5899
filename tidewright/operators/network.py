"""Nearest neighbours, semantic edges, communities and betweenness.

``nearest`` is a search by inverted lists: centres are fitted on a bounded sample, every vector is indexed in the list of
its nearest centre, and each probe looks into its ``probes`` nearest lists. Lists are cut into parts of bounded size, so no
list, however crowded, is one task; a probe's best of all parts are brought together at the end. Recall depends on
``probes`` and is measured by the tests (at least 0.9); with ``probes`` equal to the number of lists it is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.common import Scratch, spread_join
from tidewright.operators.components import settled_parts

#: Edges of a connected part, counted both ways, that a worker holds to walk over it (some 14 bytes each while it reads them).
MOST_EDGES = 50_000_000


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def centres(vectors: DataFrame, column: str, lists: int, sample: int = 4096, rounds: int = 8) -> np.ndarray:
    """Directions of ``lists`` groups of a bounded sample (those of the smallest hash), by spherical k-means."""
    rows = vectors.select(column).where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(sample).collect()
    x = unit(np.array([r[0] for r in rows], float)) if rows else np.zeros((0, 1))
    at = x[:: max(1, len(x) // max(lists, 1))][:lists].copy()
    for _ in range(rounds if len(x) else 0):
        own = (x @ at.T).argmax(1)
        for k in range(len(at)):
            if (own == k).any():
                at[k] = x[own == k].mean(0)
        at = unit(at)
    return at


def _listed(df: DataFrame, column: str, at: np.ndarray, n: int) -> DataFrame:
    """The rows with ``lists``: the numbers of their ``n`` nearest centres."""

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        x = unit(np.array(v.tolist(), float)) if len(v) else np.zeros((0, at.shape[1]))
        return pd.Series(list(np.argsort(-(x @ at.T), axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.withColumn("lists", near(column))


def nearest(probes: DataFrame, base: DataFrame, k: int = 10, least: float | None = None, lists: int | None = None, look: int = 8, part_rows: int = 20_000) -> DataFrame:
    """For each probe (id, v) its ``k`` nearest of ``base`` (id, v) by cosine, itself left out: probe, id, similarity.

    If both have a number ``kind``, the ``k`` nearest of each kind with a greater number than the probe's.
    """
    spark, kinds = base.sparkSession, "kind" in base.columns
    scratch = Scratch(spark, "nearest")
    schema = "probe long, id long, kind long, similarity double"
    kind = F.col("kind").cast("long") if kinds else F.lit(0).cast("long")
    asked_kind = F.col("kind").cast("long") if kinds else F.lit(-1).cast("long")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "probe long, id long, similarity double")
    lists = lists or max(1, min(1024, int(n**0.5 / 2)))
    at = centres(base, "v", lists)
    own = scratch.save(_listed(base.where("v is not null"), "v", at, 1).select("id", kind.alias("kind"), "v", F.col("lists")[0].alias("list")), "base")
    sizes = own.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    held = own.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    asked = _listed(probes.where("v is not null"), "v", at, min(look, len(at))).select("id", asked_kind.alias("kind"), "v", F.explode("lists").alias("list"))
    asked = asked.join(F.broadcast(sizes), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    bound = -2.0 if least is None else least

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"probe": [], "id": [], "kind": [], "similarity": []}).astype({"probe": "int64", "id": "int64", "kind": "int64"})]
        groups = [(c, x["id"].to_numpy(), unit(np.array(x["v"].tolist(), float))) for c, x in b.groupby("kind")] if len(q) else []
        for i in range(0, len(q), 512):
            some = q.iloc[i : i + 512]
            who, of, x = some["id"].to_numpy(), some["kind"].to_numpy(), unit(np.array(some["v"].tolist(), float))
            for c, ids, y in groups:
                s = x @ y.T
                s[(who[:, None] == ids[None, :]) | (of >= c)[:, None]] = -np.inf
                top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
                found = pd.DataFrame({"probe": np.repeat(who, top.shape[1]), "id": ids[top].ravel(), "kind": c, "similarity": np.take_along_axis(s, top, 1).ravel()})
                out.append(found[found["similarity"] >= bound])
        return pd.concat(out)

    found = asked.groupBy("list", "part").cogroup(held.groupBy("list", "part")).applyInPandas(best, schema)
    rank = F.row_number().over(W.partitionBy("probe", "kind").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "id", "similarity")


def semantic_edges(vectors: DataFrame, k: int = 10, least: float = 0.5, limit: int | None = 5000, **search) -> DataFrame:
    """Edges between items (id, kind, v) of different kinds: of each two kinds the smaller one probes the larger, all in one search."""
    order = vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.row_number().over(W.orderBy("n", "kind")).alias("number"))
    numbered = Scratch(vectors.sparkSession, "semantic").save(vectors.join(F.broadcast(order), "kind").select("id", F.col("number").alias("kind"), "v"), "vectors")
    out = nearest(numbered, numbered, k, least, **search)
    edges = out.groupBy(F.least("probe", "id").alias("source_id"), F.greatest("probe", "id").alias("target_id")).agg(F.round(F.max("similarity"), 4).alias("strength"))
    return edges.orderBy(F.desc("strength"), "source_id", "target_id").limit(limit) if limit else edges


# Graphs


def weighted(edges: DataFrame) -> DataFrame:
    """a, b, w both ways: the number of edges between two nodes, loops left out."""
    e = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))


def weighed_once(edges: DataFrame) -> DataFrame:
    """a < b, w: the number of edges between two nodes, each pair once, loops left out."""
    e = edges.where("source_id <> dest_id").select(F.least("source_id", "dest_id").alias("a"), F.greatest("source_id", "dest_id").alias("b"))
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))


def parted(once: DataFrame, scratch: Scratch) -> DataFrame:
    """id, n (edges), root, place of the nodes of edges (a, b, w), each given once: nodes of one connected part have the same root
    and are numbered by ``place``."""
    place = F.row_number().over(W.partitionBy("root").orderBy("id")).cast("int") - 1
    return scratch.save(settled_parts(once, scratch).withColumn("place", place), "nodes")


def placed(once: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """root, a, b, w: the edges by the places of their ends."""
    rows = nodes.agg(F.sum("n")).first()[0] or 0
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("root").alias(f"root_{x}"), F.col("place").alias(f"place_{x}"), "n")
    met = spread_join(spread_join(once, side("a"), "a", "n", rows), side("b").drop("root_b"), "b", "n", rows)
    return scratch.save(met.select(F.col("root_a").alias("root"), F.col("place_a").alias("a"), F.col("place_b").alias("b"), "w"), "once")


def communities(edges: DataFrame, rounds: int = 12, levels: int = 6, resolution: float = 1.0, held: int = 6_000_000) -> DataFrame:
    """node, community: parallel Louvain. In a round, half the nodes (by hash) may move to the neighbouring community
    with the greatest gain in modularity; once none moves, communities become the nodes of the next level. Communities are
    numbered by size, the largest 0, then by their smallest node.

    No community reaches over two connected parts, so a part of up to ``held`` edges, counted both ways, is settled within
    one task, which weighs its pairs itself; rounds over larger ones are joins. Edges are read twice: pass stored ones."""
    scratch = Scratch(edges.sparkSession, "louvain")
    g = edges.where("source_id <> dest_id").select(F.least("source_id", "dest_id").alias("a"), F.greatest("source_id", "dest_id").alias("b"))
    nodes = scratch.save(settled_parts(g, scratch), "nodes")
    parts = scratch.save(nodes.groupBy("root").agg(F.sum("n").alias("edges")), "parts")
    total = float(parts.agg(F.sum("edges")).first()[0] or 0)
    far = parts.where(F.col("edges") > held).limit(1).count()
    mine = nodes.join(parts.where(F.col("edges") <= held).select("root"), "root") if far else nodes

    def settle(key: tuple, e: pa.Table) -> pa.Table:
        # Nodes are numbered in order of their names, so that nothing hangs on the order of the edges.
        names = pa.chunked_array([*e["a"].chunks, *e["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(names.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        a, b = np.split(place[names.indices.to_numpy()], 2)
        pair, w = np.unique(a * len(order) + b, return_counts=True)
        of = _louvain(*np.divmod(pair, len(order)), w.astype(float), total, rounds, levels, resolution)
        return pa.table({"node": names.dictionary.take(pa.array(order)), "community": pa.array([key[0].as_py()] * len(of), pa.string()), "label": of})

    ends = mine.select(F.col("id").alias("a"), F.col("root"), "n")
    settled = spread_join(g, ends, "a", "n", int(total)).groupBy("root").applyInArrow(settle, "node string, community string, label long")
    whole = scratch.save(settled, "settled")
    if far:
        rest = scratch.save(weighed_once(edges).join(mine.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b", F.col("w").cast("double").alias("w")), "rest")
        rest = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        whole = whole.unionByName(_joined_louvain(scratch.save(rest, "level-0"), total, rounds, levels, resolution, scratch).withColumn("label", F.lit(-1).cast("long")))
    sizes = whole.groupBy("community", "label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"))
    ranks = sizes.select("community", "label", (F.row_number().over(W.orderBy(F.desc("size"), "first")) - 1).alias("rank"))
    return whole.join(ranks, ["community", "label"]).select("node", F.col("rank").alias("community"))


def _louvain(a: np.ndarray, b: np.ndarray, w: np.ndarray, total: float, rounds: int, levels: int, resolution: float) -> np.ndarray:
    """A community for each node from 0 on, of edges given once; ``total`` is the weight of all edges of the graph, both ways."""
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    whole = np.arange(int(a.max()) + 1)
    for _ in range(levels):
        n = int(a.max()) + 1
        k, c, idle, changed = np.bincount(a, w, n), np.arange(n), 0, False
        apart = a != b
        x, y, v = a[apart], b[apart], w[apart]
        for r in range(1, rounds + 1):
            if not len(x):
                break
            key = x * n + c[y]
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            node, there = np.divmod(key[at], n)
            own = there == c[node]
            value = np.add.reduceat(v[order], at) - resolution * k[node] * (np.bincount(c, k, n)[there] - np.where(own, k[node], 0.0)) / total
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            best = np.maximum.reduceat(value, first)
            who, stay = node[first], np.zeros(n)
            stay[node[own]] = value[own]
            spread = np.repeat(best, np.diff(np.concatenate((first, [len(node)]))))
            top = np.flatnonzero(value == spread)
            to = np.full(n, -1)
            to[node[top][::-1]] = there[top][::-1]
            # Of two rounds each node is free in one. Of two nodes alone, one stays: they would change places.
            mixed = (who.astype(np.uint64) + np.uint64((r + 1) // 2 * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            free = (((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)) + np.uint64(r)) % np.uint64(2) == 0
            alone = np.bincount(c, minlength=n) == 1
            free &= ~(alone[c[who]] & alone[to[who]] & (to[who] > c[who]))
            go = who[free & (best > stay[who] + 1e-9)]
            c[go] = to[go]
            changed, idle = changed or bool(len(go)), 0 if len(go) else idle + 1
            if idle == 3:
                break
        if not changed:
            break
        c = np.unique(c, return_inverse=True)[1].ravel()
        whole = c[whole]
        n = int(c.max()) + 1
        key, at = np.unique(c[a] * n + c[b], return_inverse=True)
        (a, b), w = np.divmod(key, n), np.bincount(at.ravel(), w)
    return whole


def _joined_louvain(graph: DataFrame, total: float, rounds: int, levels: int, resolution: float, scratch: Scratch) -> DataFrame:
    """node, community (a node of it) of edges (a, b, w) both ways, by joins: for parts that fit no task."""
    whole = scratch.save(graph.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct(), "whole-0")
    for level in range(1, levels + 1):
        degree = scratch.save(graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("n")), f"degree-{level}")
        rows = graph.count()
        of = scratch.save(degree.select("node", "k", "n", F.col("node").alias("c")), f"of-{level}-0")
        changed, idle = False, 0
        for r in range(1, rounds + 1):
            size = of.groupBy("c").agg(F.sum("k").alias("total"))
            near = spread_join(graph.where("a <> b"), of.select(F.col("node").alias("b"), "c", "n"), "b", "n", rows).groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("to"))
            mine = of.select("node", "k", F.col("c").alias("own"))
            gain = near.join(mine, "node").join(size, "c")
            value = F.col("to") - resolution * F.col("k") * (F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / total
            ranked = gain.select("node", "c", "own", value.alias("value"))
            best = ranked.groupBy("node").agg(F.max_by(F.struct("c", "value"), F.struct("value", F.col("c") == F.col("own"))).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("value"))).alias("stay"))
            free = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
            moved = best.where(free & (F.col("best.value") > F.coalesce("stay", F.lit(0.0)) + 1e-9)).select("node", F.col("best.c").alias("to"))
            new = scratch.save(of.join(moved, "node", "left").select("node", "k", "n", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("went")), f"of-{level}-{r}")
            went = new.where("went").limit(1).count()
            of, changed, idle = new.drop("went"), changed or bool(went), 0 if went else idle + 1
            if idle == 2:
                break
        if not changed:
            break
        whole = scratch.save(whole.join(of.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")), f"whole-{level}")
        names = of.select("node", "c", "n")
        there = spread_join(graph, names.select(F.col("node").alias("a"), F.col("c").alias("ca"), "n"), "a", "n", rows)
        there = spread_join(there, names.select(F.col("node").alias("b"), F.col("c").alias("cb"), "n"), "b", "n", rows)
        graph = scratch.save(there.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), f"level-{level}")
    return whole


def modularity(edges: DataFrame, of: DataFrame) -> float:
    g = weighted(edges)
    a, b = of.select(F.col("node").alias("a"), F.col("community").alias("ca")), of.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    total = g.agg(F.sum("w")).first()[0]
    inside = g.join(a, "a").join(b, "b").where("ca = cb").agg(F.sum("w")).first()[0] or 0.0
    squares = g.join(a, "a").groupBy("ca").agg(F.sum("w").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - squares / total**2


def community_summary(of: DataFrame, about: DataFrame) -> DataFrame:
    """Per community its size, kinds with their counts, its ten most frequent sources and first twenty members."""
    j = of.join(about.select(F.col("id").alias("node"), "kind", "source"), "node", "left")
    base = j.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    first = j.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("node"))).where("r <= 20").groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))
    kinds = j.groupBy("community", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("community").agg(F.sort_array(F.collect_list(F.concat_ws("=", "kind", "n"))).alias("kinds"))
    sources = j.groupBy("community", "source").agg(F.count(F.lit(1)).alias("n"))
    top = sources.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "source"))).where("r <= 10").groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]).alias("sources"))
    return base.join(kinds, "community").join(top, "community", "left").join(first, "community")


def bridge_nodes(edges: DataFrame, of: DataFrame, about: DataFrame, limit: int = 200) -> DataFrame:
    """Nodes whose neighbours are of several communities or kinds, by communities times kinds times degree."""
    e = edges.select(F.col("source_id").alias("a"), F.col("dest_id").alias("b")).where("a <> b")
    # Dealt by the neighbour once, for both telling pairs apart and joining what is known of it.
    near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).repartition("b").distinct()
    who = of.select(F.col("node").alias("b"), "community").join(about.select(F.col("id").alias("b"), "kind"), "b", "left")
    near = near.join(who.hint("merge"), "b")
    near = near.groupBy("a", "community", "kind").agg(F.count(F.lit(1)).alias("n"))
    g = near.groupBy(F.col("a").alias("id")).agg(F.countDistinct("community").alias("communities"), F.greatest(F.countDistinct("kind"), F.lit(1)).alias("kinds"), F.sum("n").alias("degree"))
    g = g.where("communities > 1 or kinds > 1").withColumn("score", F.col("communities") * F.col("kinds") * F.col("degree"))
    return g.orderBy(F.desc("score"), "id").limit(limit)


def graph_view(edges: DataFrame, rank: DataFrame, of: DataFrame | None, about: DataFrame, n: int = 200, kind: str | None = None, community: int | None = None) -> DataFrame:
    """The edges among the ``n`` nodes of the highest rank, of a kind or community if asked. Communities ``of`` nodes have no part
    in a view of all, and need not be given for it."""
    nodes = rank.join(about.select("id", "kind"), "id", "left")
    if kind is not None:
        nodes = nodes.where(F.col("kind") == kind)
    if community is not None:
        nodes = nodes.join(of.where(F.col("community") == community).select(F.col("node").alias("id")), "id", "left_semi")
    top = nodes.orderBy(F.desc(F.round("rank", 12)), "id").limit(n).select("id")
    for c in ("source_id", "dest_id"):
        edges = edges.join(F.broadcast(top.withColumnRenamed("id", c)), c, "left_semi")
    return edges.select("source_id", "dest_id", "relationship_type")


def betweenness(edges: DataFrame, pivots: int = 500, seed: int = 42, walks: int = 16) -> DataFrame:
    """id, betweenness (of an undirected graph, weights as distances, normalised) from the shortest paths of all nodes, or of
    ``pivots`` of them, those of the smallest hash, scaled to all. A task holds one connected part of the graph and walks
    from up to ``walks`` pivots over it; a part of over MOST_EDGES edges is an error. Nothing comes to the driver."""
    scratch = Scratch(edges.sparkSession, "between")
    g = scratch.save(weighed_once(edges), "graph")
    nodes = parted(g, scratch)
    n = nodes.count()
    most = nodes.groupBy("root").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_EDGES:
        raise ValueError(f"a connected part of the graph has {most} edges counted both ways, more than {MOST_EDGES}")
    chosen = nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots).select("root", "place")
    part = F.floor((F.row_number().over(W.partitionBy("root").orderBy("place")) - 1) / walks).cast("int")
    chosen = scratch.save(chosen.withColumn("part", part), "pivots")
    parts = chosen.groupBy("root").agg((F.max("part") + 1).alias("parts"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, e in batch.groupby("root"):
                w = e["w"].to_numpy()
                yield pd.DataFrame({"root": [root], "parts": e["parts"].iloc[:1].to_numpy(), "a": [e["a"].to_numpy(np.int32).tobytes()], "b": [e["b"].to_numpy(np.int32).tobytes()], "w": [w.astype(np.min_scalar_type(w.max())).tobytes()]})

    # Parts without a pivot are not walked. Edges travel in blocks, as a part goes to several tasks.
    dealt = placed(g, nodes, scratch).join(F.broadcast(parts), "root").select("root", "parts", "a", "b", "w").mapInPandas(packed, "root string, parts int, a binary, b binary, w binary")
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def walk(key: tuple, own: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        blocks = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(w, f"u{4 * len(w) // len(a)}")) for a, b, w in zip(e["a"], e["b"], e["w"], strict=True)]
        size = max((int(x.max()) for a, b, _ in blocks for x in (a, b)), default=0) + 1
        start, to, w = _lists(blocks, size)
        out = np.zeros(size)
        for s in own["place"]:
            out += _dependencies(int(s), size, start, to, w)
        hit = np.flatnonzero(out)
        return pd.DataFrame({"root": key[0], "place": hit.astype(np.int32), "d": out[hit]})

    count = min(pivots, n)
    scale = n / max(count, 1) / max((n - 1) * (n - 2), 1)
    sums = chosen.groupBy("root", "part").cogroup(dealt.groupBy("root", "part")).applyInPandas(walk, "root string, place int, d double")
    sums = sums.groupBy("root", "place").agg((F.sum("d") * scale).alias("betweenness"))
    return nodes.join(sums, ["root", "place"], "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _lists(blocks: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, to, w: the neighbours of node i and the weights of its edges from ``start[i]`` on, of blocks of edges (a, b, w)."""
    degree = np.zeros(size, np.int64)
    for a, b, _ in blocks:
        degree += np.bincount(a, minlength=size) + np.bincount(b, minlength=size)
    start = np.concatenate(([0], np.cumsum(degree)))
    free, wide = start[:-1].copy(), max((w.dtype.itemsize for *_, w in blocks), default=1)
    to, weight = np.empty(start[-1], np.int32), np.empty(start[-1], f"u{wide}")
    for a, b, w in blocks:
        for x, y in ((a, b), (b, a)):
            order = np.argsort(x, kind="stable")
            x, many = x[order], np.bincount(x, minlength=size)
            at = free[x] + np.arange(len(x)) - (np.cumsum(many) - many)[x]
            to[at], weight[at] = y[order], w[order]
            free += many
    return start, to, weight


def _from(v: np.ndarray, start: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """node, edge of all edges of the nodes ``v``, some ``most`` at a time."""
    degree = start[v + 1] - start[v]
    ends, i = np.cumsum(degree), 0
    while i < len(v):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        some = degree[i:j]
        yield np.repeat(v[i:j], some), np.repeat(start[v[i:j]] - (np.cumsum(some) - some), some) + np.arange(some.sum())
        i = j


def _dependencies(s: int, n: int, start: np.ndarray, to: np.ndarray, w: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Of each node, how much the shortest paths from ``s`` depend on it. Nodes of one distance are settled at once, their edges
    looked at ``most`` at a time; the way back looks at them again, so that none has to be kept."""
    distance, paths, done = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool)
    distance[s], paths[s] = 0.0, 1.0
    open_, waiting, settled = [0.0], {0.0: [np.array([s])]}, []
    while open_:
        d = heapq.heappop(open_)
        v = np.unique(np.concatenate(waiting.pop(d)))
        v = v[(distance[v] == d) & ~done[v]]
        if not len(v):
            continue
        settled.append((d, v))
        for frm, e in _from(v, start, most):
            u, by = to[e], w[e]
            before = done[u] & (distance[u] + by == d)
            if before.any():
                np.add.at(paths, frm[before], paths[u[before]])
            nearer = d + by < distance[u]
            u, by = u[nearer], by[nearer]
            np.minimum.at(distance, u, d + by)
            u = np.unique(u)
            for x in np.unique(distance[u]):
                if x not in waiting:
                    waiting[x] = []
                    heapq.heappush(open_, x)
                waiting[x].append(u[distance[u] == x])
        done[v] = True
    out = np.zeros(n)
    for d, v in reversed(settled):
        for frm, e in _from(v, start, most):
            u = to[e]
            before = distance[u] + w[e] == d
            frm, u = frm[before], u[before]
            np.add.at(out, u, paths[u] / paths[frm] * (1 + out[frm]))
    out[s] = 0.0
    return out


def entity_network(edges: DataFrame, start: str, depth: int = 3) -> DataFrame:
    """Edges met on a walk in width from ``start``: each level's edges of the nodes found last, as often as they are met."""
    scratch = Scratch(edges.sparkSession, "network")
    cols = ["source_id", "dest_id", "relationship_type"]
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, depth int")
    out = None
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1).select("id")
        fwd = edges.join(front.withColumnRenamed("id", "source_id"), "source_id").select(*cols, F.col("dest_id").alias("next"))
        back = edges.join(front.withColumnRenamed("id", "dest_id"), "dest_id").select(*cols, F.col("source_id").alias("next"))
        # An edge between two nodes of one level is met from both and counts once a level.
        level = scratch.save(fwd.unionByName(back).withColumn("depth", F.lit(d)), f"level-{d}")
        fresh = level.select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = scratch.save(seen.unionByName(fresh), f"seen-{d}")
        part = level.select(*cols, "depth").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def neighbour_edges(edges: DataFrame, start: str, depth: int = 2) -> DataFrame:
    """Edges out of or into ``start``, then those out of an edge's target or into its source, up to ``depth`` steps and never
    on through ``start``; each with its least depth."""
    scratch = Scratch(edges.sparkSession, "neighbours")
    e = scratch.save(edges.select("source_id", "dest_id", "relationship_type", "strength").distinct(), "edges")
    heads = tails = edges.sparkSession.createDataFrame([(start,)], "id string")
    out = None
    for d in range(1, depth + 1):
        after = e.join(heads.withColumnRenamed("id", "source_id"), "source_id").select(e.columns)
        before = e.join(tails.withColumnRenamed("id", "dest_id"), "dest_id").select(e.columns)
        level = scratch.save(after.unionByName(before).distinct().withColumn("depth", F.lit(d)), f"level-{d}")
        heads, tails = (level.where(F.col(c) != start).select(F.col(c).alias("id")).distinct() for c in ("dest_id", "source_id"))
        out = level if out is None else out.unionByName(level)
    return out.groupBy("source_id", "dest_id", "relationship_type", "strength").agg(F.min("depth").alias("depth"))
