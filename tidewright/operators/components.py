"""Connected components of an edge table by alternating large-star and small-star steps.

Each step rewrites every edge towards the smallest known neighbour with one aggregation and one join, so a
component of any size is spread over all tasks; the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.common import Scratch, spread_join


def _nearest(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Per node u its smallest neighbour m and its degree, stored; and the number of edges."""
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), name)
    return least, least.agg(F.sum("n")).first()[0] or 0


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)``, undirected, any orderable type → ``(node, root)`` with the smallest node of each component.

    Nulls and self-loops are ignored; repeated edges count once; an empty table gives an empty result. Nodes
    without an edge to another node are absent: the caller keeps them as their own root. The result reads a
    table in the shared folder, which lives until the caller drops the scratch. Edges that are not settled after
    ``max_rounds`` (more than any path takes that fits in a cluster) are an error, never a partial result.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e, "edges-0")
    seen = None
    for i in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, n = _nearest(both, scratch, "least")
        if not n:
            break
        large = spread_join(both, least, "u", "n", n).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("self"))
        large = scratch.save(large.select("u", "v").distinct(), "large")
        least, n = _nearest(large, scratch, "least-small")
        small = spread_join(large, least, "u", "n", n).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = scratch.save(small.where("u <> v").distinct(), f"edges-{i}")
        scratch.drop(f"edges-{i - 1}", "least", "large", "least-small")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components were not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label``, in which each node points to the first of its part, once ends ``i`` and ``j`` of edges are of one part."""
    x, y = label[i], label[j]
    while (apart := x != y).any():
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(label, high, low)
        while ((on := label[label]) != label).any():
            label = on
        x, y = label[low], label[high]
    return label


def settled_parts(edges: DataFrame, scratch: Scratch, rows: int = 500_000, most: int = 4_000_000) -> DataFrame:
    """id, n (its edges), root of the nodes of edges (a, b: strings), each given once: nodes of one connected part have one root,
    which is any node of it.

    A task reads its edges as they are stored and keeps the parts that they make, so each node comes out once a task and not
    once an edge; one that holds over ``most`` nodes hands them out and begins anew. What tasks have of one node joins their
    parts, and only these links, few next to the edges, are settled by rounds."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, label, n, held, size = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def met() -> tuple:
            u, v = (pa.concat_arrays([b.column(k).cast(pa.string()) for b in held]) for k in (0, 1))
            every = pa.concat_arrays([names, u, v]).dictionary_encode()
            code, count = every.indices.to_numpy(), len(every.dictionary)
            i, j = code[len(names) : len(names) + len(u)], code[len(names) + len(u) :]
            grown = np.concatenate([label, np.arange(len(label), count)])
            seen = np.bincount(i, minlength=count) + np.bincount(j, minlength=count)
            seen[: len(n)] += n
            return every.dictionary, _joined(grown, i, j), seen

        def out() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(names), 100_000):
                some = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([names[some], names.take(pa.array(label[some])), pa.array(n[some])], ["id", "label", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                names, label, n = met()
                held, size = [], 0
                if len(names) > most:
                    yield from out()
                    names, label, n = names[:0], label[:0], n[:0]
        if held:
            names, label, n = met()
        yield from out()

    tall = edges.select("a", "b").coalesce(edges.sparkSession.sparkContext.defaultParallelism).mapInArrow(parts, "id string, label string, n long")
    one = scratch.save(tall.groupBy("id").agg(F.sum("n").alias("n"), F.min("label").alias("label"), F.collect_set("label").alias("labels")), "labels")
    links = one.select("label", F.explode("labels").alias("other")).where("label <> other").distinct()
    roots = connected_components(links.select(F.col("label").alias("u"), F.col("other").alias("v")), Scratch(edges.sparkSession, "links"))
    return one.join(roots.withColumnRenamed("node", "label"), "label", "left").select("id", "n", F.coalesce("root", "label").alias("root"))
