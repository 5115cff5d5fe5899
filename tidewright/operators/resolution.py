"""Entity resolution: pairs of entities from different sources that may be one thing, their merge, and type compatibility.

Entities are (id, source_name, entity_type, name, identifier, country, lat, lon, xrefs: map of id system to value).
Names compare by the share of matching blocks (twice the matched characters over both lengths) of their normal forms.

``name_pairs`` loses no pair: short texts of a ratio of at least t are equal once a few characters are left out of each;
longer ones share so many of their two-character pieces that, under any fixed order of pieces, one of a text's first
ones is among the other's first ones. The order puts rare pieces first. Names are compared once each, and all pairs of entities of like names are given.

Defined results: null names match nothing; ties between strategies go to the first in ``PRIORITY``; repeated rows of
an id count once; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import combinations, combinations_with_replacement
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from tidewright.common import Scratch
from tidewright.functions.geo import haversine

#: A type's parent; those without one hang on the root.
ROOT = "entity"
HIERARCHY = {
    "biodiversity_entity": ROOT, "species_observation": "biodiversity_entity", "taxon": "biodiversity_entity", "fish_stock": "biodiversity_entity", "ecosystem": "biodiversity_entity",
    "geographic_entity": ROOT, "country": "geographic_entity", "region": "geographic_entity", "marine_protected_area": "geographic_entity", "eez": "geographic_entity",
    "infrastructure_entity": ROOT, "infrastructure": "infrastructure_entity", "port": "infrastructure_entity", "platform": "infrastructure_entity",
    "organizational_entity": ROOT, "organization": "organizational_entity", "company": "organizational_entity", "project": ROOT, "contract": ROOT,
    "geological_feature": ROOT, "hydrothermal_vent": "geological_feature", "seamount": "geological_feature",
}
#: Strategies in the order in which they claim a pair.
PRIORITY = ("identifier", "cross_ref_id", "name", "country_normalization", "spatial_name")


def above(kind: str, parents: dict[str, str]) -> set[str]:
    out = set()
    while kind in parents and (kind := parents[kind]) not in out:
        out.add(kind)
    return out


def compatible(a: str, b: str, parents: dict[str, str] = HIERARCHY) -> bool:
    """Equal, one above the other, or below a common type that is not the root."""
    up_a, up_b = above(a, parents) | {a}, above(b, parents) | {b}
    return a == b or a in up_b or b in up_a or bool((up_a & up_b) - {ROOT})


def compatible_pairs(parents: dict[str, str] = HIERARCHY) -> list[tuple[str, str]]:
    """All ordered pairs of different compatible types: a list as short as the hierarchy."""
    kinds = sorted({*parents, *parents.values()})
    return [(x, y) for a, b in combinations(kinds, 2) if compatible(a, b, parents) for x, y in ((a, b), (b, a))]


def normal(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+", " "))


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _letters(names: np.ndarray, sizes: np.ndarray, pad: int) -> np.ndarray:
    """One row of code points a name, filled up with ``pad``."""
    width = max(1, int(sizes.max()))
    at = np.ascontiguousarray(names.astype(f"U{width}")).view(np.uint32).reshape(len(names), width).copy()
    at[np.arange(width) >= sizes[:, None]] = pad
    return at


def _matched_characters(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many characters stand in difflib's matching blocks, for each row of two tables of code points at most 64 wide.
    Bit j of word i says that a block of the length at hand may end at place i of one name and place j of the other."""
    word = np.dtype(next(f"u{n // 8}" for n in (8, 16, 32, 64) if b.shape[1] <= n))
    wide = np.pad(b, ((0, 0), (0, word.itemsize * 8 - b.shape[1])), constant_values=0xFFFFFFFF)
    equal = np.packbits(a[:, :, None] == wide[:, None, :], axis=2, bitorder="little").view(word)[:, :, 0]
    bits = np.array([(1 << n) - 1 for n in range(word.itemsize * 8 + 1)], word)
    total, places = np.zeros(len(a), np.int64), np.arange(a.shape[1])
    row, a0, a1, b0, b1 = np.arange(len(a)), np.zeros(len(a), np.int64), size_a, np.zeros(len(a), np.int64), size_b
    while len(row):
        inside = (places >= a0[:, None]) & (places < a1[:, None])
        one = np.where(inside, equal[row] & (bits[b1] & ~bits[b0])[:, None], word.type(0))
        size, end_a, end_b = (np.zeros(len(row), np.int64) for _ in range(3))
        alive, ends, n = np.arange(len(row)), one, 0
        while True:
            some = ends.any(axis=1)
            alive, ends, n = alive[some], ends[some], n + 1
            if not len(alive):
                break
            # Of the longest blocks the first in one name counts, then the first in the other.
            first = (ends != 0).argmax(axis=1)
            lowest = ends[np.arange(len(ends)), first]
            size[alive], end_a[alive], end_b[alive] = n, first + 1, np.searchsorted(bits, lowest & (~lowest + word.type(1)), "left")
            longer = np.zeros_like(ends)
            longer[:, 1:] = (ends[:, :-1] << word.type(1)) & one[alive][:, 1:]
            ends = longer
        np.add.at(total, row, size)
        left = (size > 0) & (end_a - size > a0) & (end_b - size > b0)
        right = (size > 0) & (end_a < a1) & (end_b < b1)
        parts = ((row[left], a0[left], (end_a - size)[left], b0[left], (end_b - size)[left]), (row[right], end_a[right], a1[right], end_b[right], b1[right]))
        row, a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*parts, strict=True))
    return total


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of each pair: names of up to 64 characters are compared many at a time."""
    out = np.ones(len(a))
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    a, b = np.array(a, object), np.array(b, object)
    longest, unlike = np.maximum(size_a, size_b), a != b
    for low, high in ((0, 16), (16, 32), (32, 64)):
        at = np.flatnonzero(unlike & (longest > low) & (longest <= high))
        for i in np.array_split(at, len(at) // 4096 + 1):
            if len(i):
                m = _matched_characters(_letters(a[i], size_a[i], 0xFFFFFFFE), _letters(b[i], size_b[i], 0xFFFFFFFF), size_a[i], size_b[i])
                out[i] = 2.0 * m / (size_a[i] + size_b[i])
    for i in np.flatnonzero(unlike & (longest > 64)):
        out[i] = ratio(a[i], b[i])
    return out


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios([x or "" for x in a], [x or "" for x in b]))


def _pieces(names: DataFrame, least: float) -> DataFrame:
    """key, piece, all: the first pieces of each name under the order that puts rare ones first, and all of them."""
    n = F.length("key")
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring("key", i, 2))
    numbered = F.transform(two, lambda x, i: F.concat(x, F.size(F.filter(F.slice(two, 1, i), lambda y: y == x)).cast("string")))
    tall = names.select("key", F.explode(numbered).alias("piece"))
    often = tall.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    lists = tall.join(often, "piece").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("all"))
    # Blocks are parted by at least one unmatched character, so m matched ones in b blocks share m - b pieces.
    shared = F.ceil(n * (1 + least / (2 - least)) * (1.5 * least - 1) - 1 - 1e-9).cast("int")
    first = F.when(shared >= 1, F.slice("all", 1, F.greatest(F.size("all") - shared + 1, F.lit(1))))
    # Names too short to share a piece for certain all meet under one more piece, which the others have as well.
    short = shared < 1
    every = F.transform(F.coalesce(first, F.col("all")), lambda x: x["piece"])
    whole = F.transform("all", lambda x: x["piece"]).alias("all")
    return lists.select("key", whole, F.explode(F.when(short, F.concat(every, F.array(F.lit("")))).otherwise(F.concat(every, F.when(n <= 8, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))))).alias("piece"))


def _met_by_pieces(names: DataFrame, least: float) -> DataFrame:
    """Pairs of keys that share as many pieces as a ratio of ``least`` asks for."""
    p = _pieces(names, least)
    a, b = (p.select("piece", F.col("key").alias(f"key_{x}"), F.col("all").alias(f"all_{x}")) for x in "ab")
    size = least / (2 - least)
    met = a.join(b, "piece").where("key_a < key_b").where((F.length("key_a") >= size * F.length("key_b") - 1e-9) & (F.length("key_b") >= size * F.length("key_a") - 1e-9))
    met = met.dropDuplicates(["key_a", "key_b"])
    # The same count of shared pieces, now for the two lengths there are, leaves few pairs to compare letter by letter.
    enough = (F.length("key_a") + F.length("key_b")) * (1.5 * least - 1) - 1 - 1e-9
    return met.where(F.size(F.array_intersect("all_a", "all_b")) >= enough).select("key_a", "key_b")


def _matched(n: int, m: int, least: float) -> int:
    """How many characters names of ``n`` and ``m`` must match for a ratio of ``least``."""
    return ceil(least * (n + m) / 2 - 1e-9)


def _met_by_rests(names: DataFrame, wanted: dict[int, list[int]], buckets: int = 12) -> DataFrame:
    """Pairs of keys that are alike once characters are left out: for a length, ``wanted`` has the lengths of what may be left.
    Rests meet by a hash of 64 bits, so a few pairs may come that share none. They are no rows of their own: those of one of
    ``buckets`` parts of all hashes travel in blocks and meet in one task."""

    def dealt(h: np.ndarray, number: np.ndarray) -> pd.DataFrame:
        bucket = (h % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        h, number = h[order].view(np.int64), number[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        held = [i for i in range(buckets) if ends[i] < ends[i + 1]]
        cut = lambda x: [x[ends[i] : ends[i + 1]].tobytes() for i in held]
        return pd.DataFrame({"bucket": np.array(held, np.int32), "rests": cut(h), "numbers": cut(number)})

    def rests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby(batch["key"].str.len()):
                for m in wanted.get(n, ()):
                    keep = np.array(list(combinations(range(n), m)), np.int64).reshape(-1, m)
                    made = [few(part.iloc[i : i + 500], n, m, keep) for i in range(0, len(part), 500)]
                    yield dealt(*(np.concatenate(x) for x in zip(*made, strict=True)))

    def few(part: pd.DataFrame, n: int, m: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """So few names at a time that their rests stay in the cache."""
        letters = np.frombuffer("".join(part["key"]).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(part), n)
        h = np.full((len(part), len(keep)), m, np.uint64)
        for c in range(m):
            h = (h ^ letters[:, keep[:, c]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.ravel(), np.repeat(part["number"].to_numpy(), len(keep))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(rest, number) for batch in batches for rest, number in zip(batch["rests"], batch["numbers"], strict=True)]
        rest, number = (np.frombuffer(b"".join(x[i] for x in held), np.int64) for i in (0, 1))
        del held
        order = np.argsort(rest, kind="stable")
        rest, number = rest[order], number[order]
        # Names that share a rest are next to each other: those one place apart, then two, until no run is as long.
        apart, at = 1, np.flatnonzero(rest[:-1] == rest[1:])
        while len(at):
            x, y = number[at], number[at + apart]
            met = pd.DataFrame({"x": np.minimum(x, y), "y": np.maximum(x, y)})
            yield met[met["x"] < met["y"]].drop_duplicates()
            apart += 1
            at = at[at + apart < len(rest)]
            at = at[rest[at] == rest[at + apart]]

    scratch = Scratch(names.sparkSession, "rests")
    numbered = scratch.save(names.where(F.length("key").isin(list(wanted))).select("key", F.monotonically_increasing_id().alias("number")), "names")
    tall = numbered.repartition(numbered.sparkSession.sparkContext.defaultParallelism * 2).mapInPandas(rests, "bucket int, rests binary, numbers binary")
    met = tall.repartition(buckets, "bucket").mapInPandas(pairs, "x long, y long").distinct()
    side = lambda x, n: numbered.select(F.col("key").alias(f"key_{x}"), F.col("number").alias(n))
    met = met.join(side("a", "x"), "x").join(side("b", "y"), "y")
    return met.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))


def like_names(names: DataFrame, least: float, most: int = 600) -> DataFrame:
    """Pairs (key_a < key_b) of the distinct keys with a ratio of at least ``least``.

    Matched characters stand in the same order in both names, so alike names of given lengths have a common rest of known
    length. Pairs of lengths that leave at most ``most`` rests to a name meet by these, which are rare in any alphabet;
    names of the other pairs of lengths meet by their pieces."""
    if not 2 / 3 < least <= 1:
        raise ValueError("least must be above 2/3 and at most 1: below, names of like length need not share a piece")
    names = Scratch(names.sparkSession, "names").save(names.select("key").distinct(), "names")
    often = {r[0]: r[1] for r in names.groupBy(F.length("key").alias("n")).agg(F.count(F.lit(1))).collect()}
    sizes = sorted(often)
    wanted, rest = {n: set() for n in sizes}, set()
    # The cheapest pairs of lengths first: each length may make ``most`` rests in all.
    meets = [(n, m, _matched(n, m, least)) for n, m in combinations_with_replacement(sizes, 2) if _matched(n, m, least) <= n]
    made = lambda n: sum(comb(n, x) for x in wanted[n])
    for n, m, both in sorted(meets, key=lambda x: comb(x[1], x[2])):
        if all(both in wanted[x] or made(x) + comb(x, both) <= most for x in (n, m)):
            wanted[n].add(both)
            wanted[m].add(both)
        else:
            rest |= {n, m}
    buckets = max(12, sum(often[n] * made(n) for n in sizes) // 500_000)
    met = _met_by_rests(names, {n: sorted(x) for n, x in wanted.items() if x}, buckets)
    if rest:
        met = met.unionByName(_met_by_pieces(names.where(F.length("key").isin(sorted(rest))), least)).distinct()
    return met.withColumn("ratio", name_ratio("key_a", "key_b")).where(F.col("ratio") >= least)


def _oriented(pairs: DataFrame, rest: list[str | Column]) -> DataFrame:
    """Pairs with the smaller id first."""
    swap = F.col("id_a") > F.col("id_b")
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), F.when(swap, F.col("source_b")).otherwise(F.col("source_a")).alias("source_a"), F.when(swap, F.col("source_a")).otherwise(F.col("source_b")).alias("source_b"), *rest)


def in_group(a: str, b: str, groups: list[frozenset[str]]) -> Column:
    """Whether two sources are in one group of sources that speak of the same things."""
    return F.expr("false") if not groups else F.coalesce(*[F.when(F.col(a).isin(sorted(g)) & F.col(b).isin(sorted(g)), True) for g in groups], F.lit(False))


def name_pairs(e: DataFrame, least: float = 0.85, parents: dict[str, str] = HIERARCHY, groups: list[frozenset[str]] = (), block: int = 2000) -> DataFrame:
    """All pairs of like names across sources: of one type from ``least``, of compatible types from min(0.92, least + 0.05).
    Sources of one group raise a likeness of over 0.7 by a twentieth before it is held against these.

    Names are compared once each. The ids of a name of one type in one source are dealt into blocks of some ``block``; two
    blocks of like names and different sources are all pairs of theirs, so the pairs of a busy name are made in many tasks."""
    one = e.select("id", "source_name", "entity_type", normal(F.col("name")).alias("key")).where("key <> ''").dropDuplicates(["id"])
    kind = ["key", "entity_type", "source_name"]
    blocks = F.ceil(F.count(F.lit(1)).over(W.partitionBy(*kind)) / block).cast("int")
    held = one.withColumn("blocks", blocks).groupBy(*kind, F.pmod(F.xxhash64("id"), F.col("blocks")).alias("own")).agg(F.collect_list("id").alias("ids"))
    # What is raised may be less alike.
    alike = like_names(one, min(least, max(0.7, least / 1.05 - 1e-9)) if groups else least)
    same = one.select("key").distinct().select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1.0).alias("ratio"))
    both = alike.unionByName(alike.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "ratio")).unionByName(same)
    side = lambda x: held.select(*[F.col(c).alias(f"{n}_{x}") for c, n in (("key", "key"), ("entity_type", "type"), ("source_name", "source"), ("own", "own"), ("ids", "ids"))])
    met = both.join(side("a"), "key_a").join(side("b"), "key_b").where("source_a < source_b")
    raised = F.when(in_group("source_a", "source_b", groups) & (F.col("ratio") > 0.7), F.least(F.lit(1.0), F.col("ratio") * 1.05)).otherwise(F.col("ratio"))
    met = met.withColumn("confidence", raised)
    across = F.concat_ws("|", "type_a", "type_b").isin([f"{a}|{b}" for a, b in compatible_pairs(parents)]) & (F.col("confidence") >= min(0.92, least + 0.05))
    met = met.where(((F.col("type_a") == F.col("type_b")) & (F.col("confidence") >= least)) | across)
    parts = max(2 * e.sparkSession.sparkContext.defaultParallelism, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartition(parts, "key_a", "key_b", "own_a", "own_b").select("source_a", "source_b", "confidence", F.explode("ids_a").alias("id_a"), "ids_b")
    return _oriented(met.withColumn("id_b", F.explode("ids_b")), [F.lit("name").alias("match"), "confidence"])


def _kinds_fit(parents: dict[str, str]) -> Column:
    return (F.col("type_a") == F.col("type_b")) | F.concat_ws("|", "type_a", "type_b").isin([f"{a}|{b}" for a, b in compatible_pairs(parents)])


def _sides(e: DataFrame, keys: list[str], more: list[str]) -> tuple[DataFrame, DataFrame]:
    cols = {"id": "id", "source_name": "source", "entity_type": "type", **{c: c for c in more}}
    return tuple(e.select(*keys, *[F.col(c).alias(f"{n}_{x}") for c, n in cols.items()]) for x in "ab")


def identifier_pairs(e: DataFrame) -> DataFrame:
    a, b = _sides(e.where("identifier is not null"), ["identifier"], [])
    met = a.join(b, "identifier").where("id_a < id_b and source_a <> source_b and type_a = type_b")
    return met.select("id_a", "id_b", "source_a", "source_b", F.lit("identifier").alias("match"), F.lit(0.95).alias("confidence"))


def cross_reference_pairs(e: DataFrame, parents: dict[str, str] = HIERARCHY) -> DataFrame:
    """Pairs across sources that share a value of some id system; surer if their names are alike too."""
    tall = e.select("id", "source_name", "entity_type", "name", F.explode("xrefs").alias("system", "value")).where("trim(value) <> ''")
    a, b = _sides(tall.withColumns({"value": F.trim("value"), "name": normal(F.col("name"))}), ["system", "value"], ["name"])
    met = a.join(b, ["system", "value"]).where("id_a < id_b and source_a <> source_b").where(_kinds_fit(parents))
    alike = F.col("name_a").isNotNull() & F.col("name_b").isNotNull() & (name_ratio("name_a", "name_b") > 0.8)
    scored = met.select("id_a", "id_b", "source_a", "source_b", F.concat_ws("=", "system", "value").alias("cross_ref"), F.when(alike, 0.97).otherwise(0.92).alias("confidence"))
    best = scored.groupBy("id_a", "id_b", "source_a", "source_b").agg(F.max("confidence").alias("confidence"), F.min("cross_ref").alias("cross_ref"))
    return best.select("id_a", "id_b", "source_a", "source_b", F.lit("cross_ref_id").alias("match"), "confidence", "cross_ref")


def country_code(codes: dict[str, str], *texts: Column) -> Column:
    """The code of the first text that is a code itself or a known name, whatever the case."""
    table = F.create_map(*[F.lit(x) for k, v in sorted({**{v.lower(): v for v in codes.values()}, **{k.lower(): v for k, v in codes.items()}}.items()) for x in (k, v)])
    return F.coalesce(*[F.try_element_at(table, F.lower(F.trim(t))) for t in texts])


def country_pairs(e: DataFrame, codes: dict[str, str], groups: list[frozenset[str]] = (), kind: str = "country") -> DataFrame:
    of = e.where(F.col("entity_type") == kind).withColumn("code", country_code(codes, F.col("identifier"), F.col("name"), F.col("country"))).where("code is not null")
    a, b = _sides(of, ["code"], [])
    met = a.join(b, "code").where("id_a < id_b and source_a <> source_b")
    return met.select("id_a", "id_b", "source_a", "source_b", F.lit("country_normalization").alias("match"), F.when(in_group("source_a", "source_b", groups), 0.96).otherwise(0.93).alias("confidence"))


def spatial_pairs(e: DataFrame, km: float = 5.0, least: float = 0.6, wanted: float = 0.0) -> DataFrame:
    """Pairs of one type across sources, near each other and alike in name, half and half. Blocked by cells. Of these only
    pairs of a confidence of ``wanted`` may be asked for: names too far apart for that are then not compared."""
    least = max(least, wanted)
    size = km / 111.0
    at = e.where("lat is not null and lon is not null").withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.floor(F.col("lon") / size)})
    cols = lambda x: [F.col("id").alias(f"id_{x}"), F.col("source_name").alias(f"source_{x}"), normal(F.col("name")).alias(f"name_{x}"), F.col("lat").alias(f"lat_{x}"), F.col("lon").alias(f"lon_{x}")]
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    b = at.select("entity_type", *cols("b"), "cy", "cx", near.alias("dy")).select("*", near.alias("dx")).withColumns({"cy": F.col("cy") + F.col("dy"), "cx": F.col("cx") + F.col("dx")}).drop("dy", "dx")
    met = at.select("entity_type", *cols("a"), "cy", "cx").join(b, ["entity_type", "cy", "cx"]).where("source_a < source_b")
    distance = F.sqrt(F.pow(F.col("lat_a") - F.col("lat_b"), 2) + F.pow(F.col("lon_a") - F.col("lon_b"), 2))
    met = met.withColumn("place", F.greatest(1 - distance / size, F.lit(0.0))).where((distance <= size) & (F.col("place") >= 2 * least - 1))
    met = met.withColumn("alike", name_ratio("name_a", "name_b"))
    both = met.withColumn("confidence", F.round(0.5 * F.col("alike") + 0.5 * F.col("place"), 4)).where(0.5 * F.col("alike") + 0.5 * F.col("place") >= least)
    return _oriented(both, [F.lit("spatial_name").alias("match"), "confidence"])


def duplicates(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """The strategies' pairs, each pair once, as its first strategy has it; the surest first."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("match"))
    every = parts[0].select("id_a", "id_b", "source_a", "source_b", "match", "confidence")
    for p in parts[1:]:
        every = every.unionByName(p.select(every.columns))
    one = every.groupBy("id_a", "id_b").agg(F.min_by(F.struct("source_a", "source_b", "match", "confidence"), F.struct(rank, -F.col("confidence"))).alias("x")).select("id_a", "id_b", "x.*")
    return one.orderBy(F.desc("confidence"), "id_a", "id_b").limit(limit) if limit else one


def auto_resolved(pairs: DataFrame, least: float = 0.95, groups: list[frozenset[str]] = ()) -> DataFrame:
    """Pairs sure enough to merge once kinds of matches and source groups have raised them; ``drop_id`` goes into ``keep_id``."""
    boost = F.when(F.col("match") == "cross_ref_id", 0.03).when(F.col("match") == "country_normalization", 0.02).otherwise(0.0) + F.when(in_group("source_a", "source_b", groups), 0.02).otherwise(0.0)
    raised = pairs.withColumn("confidence", F.when(boost > 0, F.least(F.lit(1.0), F.round(F.col("confidence") + boost, 4))).otherwise(F.col("confidence")))
    return raised.where(F.col("confidence") >= least).select(F.col("id_a").alias("keep_id"), F.col("id_b").alias("drop_id"), "match", "confidence")


def equivalence(pairs: DataFrame, km: float = 5.0, parents: dict[str, str] = HIERARCHY) -> DataFrame:
    """Of pairs of rows a and b (structs of an entity): the weighted mean of what speaks for their being one."""
    a, b = (lambda c, x=x: F.col(f"{x}.{c}") for x in "ab")
    pairs = pairs.where(~F.col("a.source_name").eqNullSafe(F.col("b.source_name")))
    pairs = pairs.withColumns({"type_a": a("entity_type"), "type_b": b("entity_type")}).where(_kinds_fit(parents) | F.col("type_a").isNull() | F.col("type_b").isNull())
    shared = F.exists(F.map_keys(a("xrefs")), lambda k: F.coalesce(F.try_element_at(a("xrefs"), k) == F.try_element_at(b("xrefs"), k), F.lit(False)))
    alike = name_ratio(normal(a("name")), normal(b("name")))
    binomial = lambda n, i: F.lower(F.nullif(F.regexp_extract(F.trim(n), r"^([A-Z][a-z]+)\s+([a-z]+)", i), F.lit("")))
    genus = binomial(a("name"), 1) == binomial(b("name"), 1)
    distance = haversine(a("lat"), a("lon"), b("lat"), b("lon"), 6371.0)
    scores = {
        "cross_ref": F.when(F.coalesce(shared, F.lit(False)), 1.0),
        "named": F.when(alike > 0.5, alike),
        "taxonomic": F.when(genus & (binomial(a("name"), 2) == binomial(b("name"), 2)), 1.0).when(genus, 0.5),
        "spatial": F.when(distance <= km, 1.0).when(distance < 5 * km, 1 - (distance - km) / (4 * km)),
    }
    weights = {"cross_ref": 0.40, "named": 0.30, "taxonomic": 0.15, "spatial": 0.15}
    s = pairs.withColumns(scores)
    total = sum(F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in weights.items())
    mean = sum(F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()) / F.nullif(total, F.lit(0.0))
    sure = F.when(F.col("cross_ref").isNotNull() & (F.col("named") > 0.8), F.least(F.lit(1.0), mean * 1.15)).otherwise(mean)
    sure = F.when(F.col("type_a") == F.col("type_b"), F.least(F.lit(1.0), sure * 1.05)).otherwise(sure)
    return s.select(a("id").alias("id_a"), b("id").alias("id_b"), *weights, F.round(sure, 4).alias("confidence")).where(sure > 0.3)


def merged(entities: DataFrame, same: DataFrame) -> DataFrame:
    """Entities (id, name, payload: map, ...) after merges (keep_id, drop_id): what is kept takes over the payload keys it
    lacks, and lists where they came from; what went has the status merged."""
    gone = same.select(F.col("drop_id").alias("id"), "keep_id").dropDuplicates(["id"])
    by_id = lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)
    dropped = entities.join(gone, "id").groupBy("keep_id").agg(F.array_sort(F.collect_list(F.struct("id", "payload")), by_id).alias("parts"))
    none = F.create_map().cast("map<string,string>")
    taken = F.aggregate("parts", none, lambda m, p: F.map_concat(m, F.map_filter(F.coalesce(p["payload"], none), lambda k, _: ~F.map_contains_key(m, k))))
    kept = entities.join(dropped.withColumnRenamed("keep_id", "id"), "id", "left").join(gone.withColumnRenamed("keep_id", "into"), "id", "left")
    own = F.coalesce("payload", none)
    payload = F.when(F.col("parts").isNull(), F.col("payload")).otherwise(F.map_concat(own, F.map_filter(taken, lambda k, _: ~F.map_contains_key(own, k))))
    return kept.select(*[c for c in entities.columns if c not in ("payload", "status")], payload.alias("payload"), F.when(F.col("into").isNotNull(), "merged").otherwise("active").alias("status"), "into", F.coalesce(F.transform("parts", lambda p: p["id"]), F.array().cast("array<string>")).alias("provenance"))


# What is left at the end of a chain of merges is found by the caller: pairs here go from a dropped id to the id kept.
def first_kept(pairs: DataFrame) -> DataFrame:
    """Of merges that share ids, one a dropped id: into the smallest id it was paired with."""
    w = W.partitionBy("drop_id").orderBy("keep_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
