"""Near copies by SimHash fingerprints, and by the Jaccard similarity of word shingles where fingerprints fall short.

Two texts are linked if their fingerprints (of shingles of ``shingle`` words, as in ``simhash``) differ by at most two bits,
found by that module's search. As two bits miss most edited copies, texts are linked by similarity as well, by a lossless
self-join by prefix, length and position; the classes are those of all links together.

A text's set holds 64-bit hashes of its runs of ``shingle`` words, each made of the words' own (XXH64). Sets of similarity
``least`` or more are linked, and the classes are the connected components. Any fixed order of the shingles gives a lossless prefix filter: of two such
sets x and y with |x| <= |y|, one of the first |x| - ceil(2t/(1+t) |x|) + 1 of x is among the first
|y| - ceil(t |y|) + 1 of y. The order puts shingles that a sample of the texts has often last, so that prefixes hold
rare ones; shingles that prove crowded in the prefixes of all texts are put last as well, and prefixes taken again. The
order decides the cost only, never the result. Pairs that meet are first bounded by sketches: the shingles of a set are
counted in ``SLOTS`` slots, and two sets share no more than the smaller counts add up to. What the bound leaves is verified
on the texts.

A shingle with more than ``crowd`` sets in whose prefixes it stands does not emit all its pairs at once: its sets
are first compared with one of them. Then only sets outside the shingle's largest class so far meet the others, as
pairs within one class add nothing. A crowd of near copies takes linear work so; one of unlike texts does not.

Defined results: texts without words are one class; fewer words than a shingle are one sequence; repeated rows
share a class; long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.common import Scratch, col, spread_join
from tidewright.llm.packing import SLICE, byte_slices
from tidewright.llm.simhash import bit_moments, fingerprint
from tidewright.llm.simhash import links as fingerprint_links
from tidewright.operators.components import connected_components

CROWD = 64
SEED, MIX = 42, np.uint64(0x9E3779B97F4A7C15)
#: Texts in the sample, and the most shingles that are put last.
SAMPLE, LAST = 4000, 50_000
#: Slots of a sketch, of one byte each.
SLOTS = 256
#: Sets whose rows are looked up by a broadcast.
FEW_ENDS = 200_000


def shingle_sets(texts: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, sorted. Each distinct word of a slice of texts is hashed once, A-Z
    lower-cased (on bytes, ``lower`` knows ASCII only)."""
    out: list[np.ndarray] = []
    for at, n in byte_slices(texts, SLICE):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(at, n).cast(pa.large_string()), ""))
        flat, owner = split.flatten(), np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())
        real = pc.greater(pc.binary_length(flat), 0)
        coded, owner = flat.filter(real).dictionary_encode(), owner[real.to_numpy(zero_copy_only=False)]
        digest = xxhash.xxh64_intdigest
        each = np.fromiter((digest(w.lower(), SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        runs = _mixed(each, shingle)
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out.append(np.unique(runs[i : j - shingle + 1]) if j - i >= shingle else _mixed(each[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return out


def _mixed(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = (out ^ words[j : j + size]) * MIX
        out ^= out >> np.uint64(29)
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared) if len(x) or len(y) else 1.0


def sketch(found: np.ndarray) -> bytes:
    """How many shingles each slot holds; 255 stands for that many and more."""
    return np.minimum(np.bincount((found >> np.uint64(40)).astype(np.int64) % SLOTS, minlength=SLOTS), 255).astype(np.uint8).tobytes()


def at_most_shared(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """For rows of sketches, a bound on the shingles that the sets share. Slots full on both sides bound nothing."""
    shared = np.minimum(x, y).astype(np.int64)
    full = (shared == 255).any(1)
    return np.where(full, np.minimum(size_x, size_y), shared.sum(1))


def prefix(found: np.ndarray, often: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The shingles by which a set meets others no larger, and how many of them meet others no smaller."""
    if not len(found):
        return found, 0
    rank = np.zeros(len(found), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        rank = np.where(often[at] == found, counts[at], 0)
    need = lambda share: len(found) - math.ceil(share * len(found) - 1e-9) + 1
    return found[np.lexsort((found, rank))][: need(least)], need(2 * least / (1 + least))


def _often(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several texts of a sample have, sorted, with the number of these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in shingle_sets(batch.column(0), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    every = max(1, n // SAMPLE)
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(every)) == 0)
    some = some.limit(2 * SAMPLE).mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = some.orderBy(F.desc("n"), "h").limit(LAST).collect()
    h, c = np.array([r.h for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _marked(rows: DataFrame, often: np.ndarray, counts: np.ndarray, shingle: int, least: float) -> DataFrame:
    """Per row doc_id, r1, r2, the set's own hash, its size, its prefix, how much of that is for larger sets, its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(3), shingle)
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            first = [prefix(s, often, counts, least) for s in sets]
            columns = [pa.array(own), pa.array([len(s) for s in sets], pa.int32()), pa.array([p.view(np.int64) for p, _ in first], pa.list_(pa.int64())), pa.array([k for _, k in first], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "r1", "r2", "s", "size", "prefix", "own", "sketch"])

    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, s long, size int, prefix array<long>, own int, sketch binary")


def _by_fingerprint(rows: DataFrame, shingle: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) of sets whose texts have fingerprints at most two bits apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in shingle_sets(batch.column(0), shingle)], np.uint64)
            fps = [fingerprint(x or b"", shingle) for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64))], ["s", "fp"])

    marked = scratch.save(rows.select("text").mapInArrow(run, "s long, fp long").distinct(), "fingerprints")
    one = scratch.save(marked.groupBy("fp").agg(F.min("s").alias("one"), F.count(F.lit(1)).alias("n")), "fps")
    n, both = bit_moments(one)
    near = fingerprint_links(one.select("fp"), n, both, scratch)
    side = lambda x: one.select(F.col("fp").alias(x), F.col("one").alias(f"{x}_s"))
    across = near.join(side("u"), "u").join(side("v"), "v").select("u_s", "v_s")
    alike = spread_join(marked, one, "fp", "n", marked.count()).select("s", "one")
    ends = across.unionByName(alike.toDF("u_s", "v_s")).where("u_s <> v_s")
    return scratch.save(ends.select(F.least("u_s", "v_s").alias("u"), F.greatest("u_s", "v_s").alias("v")).distinct(), "by-fingerprint")


def _met(small: DataFrame, large: DataFrame, least: float, where: str = "true") -> DataFrame:
    """Pairs of sets that meet at a shingle; each side has key, s, size, pos, own."""
    a = small.where("pos < own").select("key", *[F.col(c).alias(f"{c}_a") for c in small.columns if c != "key"])
    b = large.select("key", *[F.col(c).alias(f"{c}_b") for c in large.columns if c != "key"])
    met = a.join(b, "key").where("size_a < size_b or (size_a = size_b and s_a < s_b)").where(where)
    met = met.where(F.col("size_a") >= least * F.col("size_b") - 1e-9)
    shared = 1 + F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) - 1
    return met.where(shared >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6).select(F.col("s_a").alias("u"), F.col("s_b").alias("v"))


def _bounded(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sketches allow a similarity of ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
            n, m = (batch.column(i).to_numpy() for i in (4, 5))
            may = at_most_shared(x, y, n, m) >= least / (1 + least) * (n + m) - 1e-6
            yield batch.select([0, 1]).filter(pa.array(may, pa.bool_()))

    side = lambda x: sets.select(F.col("s").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("size").cast("long").alias(f"size_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", "sketch_u", "sketch_v", "size_u", "size_v").mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, shingle: int, least: float, scratch: Scratch, name: str) -> DataFrame:
    pairs = scratch.save(_bounded(scratch.save(pairs.distinct(), f"{name}-met"), sets, least), f"{name}-bounded")
    scratch.drop(f"{name}-met")
    ends = scratch.save(pairs.select(F.explode(F.array("u", "v")).alias("s")).distinct().join(sets.select("s", "best.r1", "best.r2"), "s"), f"{name}-ends")
    # So few rows go to the texts; more meet them in a join that may spill.
    ends = F.broadcast(ends) if ends.count() <= FEW_ENDS else ends
    texts = scratch.save(rows.select("r1", "r2", "text").join(ends, ["r1", "r2"]).dropDuplicates(["s"]).select("s", "text"), f"{name}-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Each text of the batch is cut up once, however many pairs it is in.
            u, v = (batch.column(i).to_numpy() for i in (0, 1))
            names, first = np.unique(np.concatenate([u, v]), return_index=True)
            texts = pa.chunked_array([batch.column(2), batch.column(3)]).take(pa.array(first)).combine_chunks()
            sets = dict(zip(names.tolist(), shingle_sets(texts, shingle), strict=True))
            alike = [similarity(sets[a], sets[b]) >= least - 1e-9 for a, b in zip(u.tolist(), v.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(texts.select(F.col("s").alias("u"), F.col("text").alias("text_u")), "u").join(texts.select(F.col("s").alias("v"), F.col("text").alias("text_v")), "v")
    return scratch.save(both.select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long"), f"{name}-links")


def _roots(sets: DataFrame, links: DataFrame) -> DataFrame:
    of = connected_components(links, Scratch(sets.sparkSession, "near-parts"))
    return sets.join(of.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))


def _entries(rows: DataFrame, often: np.ndarray, counts: np.ndarray, shingle: int, least: float, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct sets, their prefixes as rows, and the shingles at which some set meets larger ones, with their sets."""
    marked = _marked(rows, often, counts, shingle, least)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("best")
    sets = scratch.save(marked.groupBy("s").agg(best, *[F.first(c).alias(c) for c in ("size", "prefix", "own", "sketch")]), "sets")
    entries = sets.select("s", "size", "own", F.posexplode("prefix").alias("pos", "key"))
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pos") < F.col("own")).cast("int")).alias("small")).where("n > 1 and small > 0").drop("small")
    return sets, entries, scratch.save(keys, "keys")


def near_copy_sets(rows: DataFrame, shingle: int = 5, least: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """``rows`` (doc_id, r1, r2, text) to s (a set), best (its row with the smallest doc_id) and root (its class)."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    scratch = Scratch(rows.sparkSession, "near")
    total = rows.count()
    often, counts = _often(rows, total, shingle)
    tall = _marked(rows, often, counts, shingle, least).select(F.explode("prefix").alias("key"))
    hot = tall.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).orderBy(F.desc("n"), "key").limit(LAST).collect()
    if hot:
        # Crowded shingles that the sample missed go last too, and prefixes are taken anew: what stays crowded are sets
        # that have nothing rarer.
        scale = max(1, total // SAMPLE)
        seen = dict(zip(often.tolist(), (counts * scale).tolist(), strict=True))
        for r in hot:
            h = r.key % 2**64
            seen[h] = max(seen.get(h, 0), r.n)
        often = np.array(sorted(seen), np.uint64)
        counts = np.array([seen[h] for h in often.tolist()], np.int64)
    sets, entries, keys = _entries(rows, often, counts, shingle, least, scratch)
    held = scratch.save(entries.join(keys, "key"), "held")
    few, many = held.where(F.col("n") <= crowd).drop("n"), held.where(F.col("n") > crowd).drop("n")
    stars = many.join(many.groupBy("key").agg(F.min(F.struct("s", "size")).alias("one")), "key").where("s <> one.s")
    stars = stars.where(F.least("size", "one.size") >= least * F.greatest("size", "one.size") - 1e-9).select(F.least("s", "one.s").alias("u"), F.greatest("s", "one.s").alias("v"))
    links = _verified(_met(few, few, least).unionByName(stars), sets, rows, shingle, least, scratch, "first").unionByName(_by_fingerprint(rows, shingle, scratch))
    out = scratch.save(_roots(sets.select("s", "best"), links), "roots-1")
    if many.limit(1).count():
        rooted = scratch.save(many.join(out.select("s", "root"), "s"), "crowded")
        main = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("main"))
        rest = scratch.save(rooted.join(main, "key").where("root <> main").drop("main"), "rest")
        more = _met(rest, rooted, least, "root_a <> root_b").unionByName(_met(rooted, rest, least, "root_a <> root_b"))
        more = _verified(more, sets, rows, shingle, least, scratch, "second")
        if more.limit(1).count():
            out = scratch.save(_roots(sets.select("s", "best"), links.unionByName(more)), "roots-2")
    return out


def near_dedup(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each class, with the columns of ``docs``: that of the smallest doc_id, or if none has one, any.

    Rows of one doc_id in one class leave one row. Rows are named by two hashes of doc_id and text.
    """
    text, doc = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = [F.xxhash64(doc, text).alias("r1"), F.xxhash64(F.lit("row"), doc, text).alias("r2")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, F.col("text").cast("string").alias("text"))
    first = near_copy_sets(rows, shingle, least).groupBy("root").agg(F.min("best").alias("b"))
    first = Scratch(docs.sparkSession, "near").save(first.select("b.r1", "b.r2"), "first")
    own = docs.select(F.struct(*map(col, docs.columns)).alias("own"), *key)
    return own.join(first.hint("merge"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"]).select("own.*")
