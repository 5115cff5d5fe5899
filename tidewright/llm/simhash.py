"""SimHash near-duplicate classes by the generalised pigeonhole principle.

A document's fingerprint has bit b set when more than half of its word-shingle hashes (XXH64, seed 42) have it.
Distinct fingerprints within ``radius`` bits are linked, and the classes are the connected components.

Search: the 64 bits are dealt into ``radius + 1`` partitions so that bits which agree over the corpus stand
together. If thresholds T_i sum to radius - partitions + 1, two fingerprints within ``radius`` differ by at most
T_i bits in some partition i (T_i = -1 skips it). A dynamic program picks the T_i of the least estimated cost:
probes made, plus candidate pairs, counted exactly for T = 0 over the whole corpus and carried to larger T by the
bits' rates of difference. Each fingerprint probes the keys within T_i of its own; candidates are verified.

A key with more than ``crowd`` fingerprints does not emit its pairs: x and y differ by at most 2 bits exactly if
some z lies within 1 bit of both, so its members and probers send themselves to their 65 neighbours z, where at
most 65 distinct fingerprints can meet. That finds the same links with work linear in the crowd.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a
shingle hash as one sequence; repeated rows share a class, and a null doc_id gets the class id of the others (null
if there are none); long texts are hashed whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.common import Scratch, spread_join
from tidewright.operators.components import connected_components

BITS = 64
CROWD = 128
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    words = text.lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones, spans, total = np.zeros(BITS, np.int64), list(zip(starts[:n].tolist(), last.tolist(), strict=True)), 0
    for i in range(0, n, 65536):  # bounds the memory that a long text takes
        part = spans[i : i + 65536]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) and the columns to carry."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x or b"", shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry])

    schema = ", ".join(["doc_id long", "fp long", *[f"`{c}` {t}" for c, t in rows.dtypes if c in carry]])
    return rows.mapInArrow(run, schema)


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, for each pair of bits, how many have both: sums of 64 by 64, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(x, axis=1, bitorder="little").astype(np.float64)
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().astype(np.int64), n], pa.int64())], ["cell", "n"])

    cells = np.zeros(BITS * BITS + 1)
    for cell, n in fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits into ``parts`` lists of even length, each grown by the bit that agrees most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds of -1 upwards that sum to ``total``; ``costs[i][t + 1]`` is the cost of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t in range(-1, len(row) - 1):
                at = cost + row[t + 1]
                if s + t not in new or at < new[s + t][0]:
                    new[s + t] = (at, [*chosen, t])
        best = new
    return best[total][1]


def estimated_costs(n: int, both: np.ndarray, groups: list[list[int]], equal_pairs: list[float], radius: int) -> list[list[float]]:
    p = np.diag(both) / max(n, 1)
    rows = []
    for group, pairs in zip(groups, equal_pairs, strict=True):
        dist = np.array([1.0])
        for b in group:
            d = min(max(2 * p[b] * (1 - p[b]), 1e-6), 1 - 1e-6)
            dist = np.convolve(dist, [1 - d, d])
        within, probes, row = np.cumsum(dist), 0.0, [0.0]
        for t in range(radius + 1):
            probes += np.prod([(len(group) - i) / (i + 1) for i in range(t)]) if t else 1.0
            row.append(n * probes + pairs * within[min(t, len(group))] / within[0])
        rows.append(row)
    return rows


def _mask(bits: list[int] | tuple[int, ...]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _key(masks: list[int]) -> list[Column]:
    return [F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)]


def links(fps: DataFrame, n: int, both: np.ndarray, scratch: Scratch, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect all fingerprints within ``radius`` bits of each other."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2: the way for crowded keys holds up to 2 bits")
    groups = correlated_partitions(n, both, radius + 1)
    masks = [_mask(g) for g in groups]
    keyed = fps.select("fp", F.explode(F.array(*_key(masks))).alias("k")).select("k.part", "k.key", "fp")
    sizes = scratch.save(keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    equal = dict.fromkeys(range(radius + 1), 0.0) | {r[0]: float(r[1]) for r in sizes.groupBy("part").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).collect()}
    thresholds = allocate(estimated_costs(n, both, groups, [equal[i] for i in range(radius + 1)], radius), 0)
    probes = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseXOR(F.lit(_mask(flip)).cast("long")).bitwiseAND(F.lit(masks[i]).cast("long")).alias("key"))
        for i, t in enumerate(thresholds)
        for k in range(t + 1)
        for flip in combinations(groups[i], k)
    ]
    used = [i for i, t in enumerate(thresholds) if t >= 0]
    index = keyed.where(F.col("part").isin(used))
    probe = fps.select("fp", F.explode(F.array(*probes)).alias("k")).select("k.part", "k.key", "fp")
    many = sizes.where(F.col("n") > crowd).select("part", "key")
    some = sizes.where((F.col("n") <= crowd) & ((F.col("n") > 1) if max(thresholds) <= 0 else F.lit(True))).select("part", "key")
    # Keys of at most `crowd` rows cannot be hot, so a plain join spreads evenly once the others are gone.
    few = index.join(some, ["part", "key"]).withColumnRenamed("fp", "v")
    pairs = probe.join(few, ["part", "key"]).where((F.col("fp") > F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= radius)).select(F.col("fp").alias("u"), "v")
    crowded = probe.join(many, ["part", "key"], "left_semi").select("fp").distinct()
    near = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_mask([b])).cast("long")) for b in range(BITS)]]
    if radius < 2:
        met = crowded.select("fp", F.explode(F.array(*near)).alias("z")).join(crowded.select(F.col("fp").alias("z")), "z").select(F.col("fp").alias("u"), F.col("z").alias("v")) if radius else crowded.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    else:
        stars = crowded.select("fp", F.explode(F.array(*near)).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        met = stars.select(F.array_min("all").alias("v"), F.explode("all").alias("u")).where("u <> v").select("u", "v")
    return scratch.save(pairs.unionByName(met).distinct(), "links")


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 2, crowd: int = CROWD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, fp (signed 64 bits), component_id, root (a fingerprint of the class), and ``carry``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, shingle, carry), "marked")
    fps = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fps")
    n, both = bit_moments(fps)
    roots = connected_components(links(fps.select("fp"), n, both, scratch, radius, crowd), Scratch(docs.sparkSession, "simhash-parts"))
    of = scratch.save(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "of")
    ids = scratch.save(of.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("parts")), "ids")
    named = scratch.save(spread_join(of, ids, "root", "parts", n).select("fp", "n", "component_id", "root"), "named")
    total = fps.agg(F.sum("n")).first()[0] or 0
    return spread_join(marked, named, "fp", "n", total).select("doc_id", "fp", "component_id", "root", *carry)
