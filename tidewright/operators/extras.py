"""Smaller operators that build on the others: voyages, identity and flag risk, templates, lifecycles, mappers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.vessels import seconds


def cross_correlation(a: DataFrame, b: DataFrame, most: int = 90) -> DataFrame:
    """Of two series (period, avg_value) by the distance in rows: products of z values a lag apart, over n."""

    def z(s: DataFrame, name: str) -> DataFrame:
        all_ = W.partitionBy()
        v = F.col("avg_value")
        return s.select(F.row_number().over(W.orderBy("period")).alias(f"rn_{name}"), ((v - F.avg(v).over(all_)) / F.nullif(F.stddev_pop(v).over(all_), F.lit(0.0))).alias(name), F.count(F.lit(1)).over(all_).alias(f"n_{name}"))

    x = z(a, "za").withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("rn_zb", F.col("rn_za") + F.col("lag"))
    return x.join(z(b, "zb"), "rn_zb").groupBy("lag").agg((F.sum(F.col("za") * F.col("zb")) / F.max(F.least("n_za", "n_zb"))).alias("r"))


def voyage_summary(v: DataFrame) -> DataFrame:
    return v.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("hours"), F.countDistinct("mmsi").alias("vessels"))


def current_behaviour(classified: DataFrame) -> DataFrame:
    last = classified.groupBy("mmsi").agg(F.max(F.struct("w", "behaviour", "end_ts")).alias("x"))
    return last.select("mmsi", "x.behaviour", "x.end_ts")


def flag_factor(flags: DataFrame, scores: dict[str, float]) -> DataFrame:
    """The score of a flag; unknown flags are at 0.5."""
    pairs = [x for k, v in sorted(scores.items()) for x in (F.lit(k), F.lit(v))]
    return flags.select("mmsi", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("flag")), F.lit(0.5)).alias("flag"))


def template_counts(counts: DataFrame, templates: DataFrame) -> DataFrame:
    """How often each (type_a, type_b, max_s) is seen, of the counts of followers (span_s, type_a, type_b, n) within each max_s."""
    p = counts.select("type_a", "type_b", F.col("span_s").alias("max_s"), "n")
    return p.join(F.broadcast(templates), ["type_a", "type_b", "max_s"]).select("type_a", "type_b", "max_s", "n")


def lifecycle(scored: DataFrame, promote: float = 0.6) -> DataFrame:
    """Status by confidence, then by feedback where there is any."""
    by_score = F.when(F.col("confidence") >= promote, "promoted").otherwise("candidate")
    return scored.select("id", "confidence", F.when(F.col("feedback") == 1, "confirmed").when(F.col("feedback") == 0, "rejected").otherwise(by_score).alias("status"))


def pruned(nodes: DataFrame, children: DataFrame, least: float) -> DataFrame:
    """Children whose parent's score is high enough; others are orphans and go."""
    return children.join(nodes.where(F.col("score") >= least).select(F.col("id").alias("parent_id")), "parent_id", "left_semi")


def compatible_types(parents: dict[str, str]) -> list[tuple[str, str]]:
    """Pairs of types that are equal, one above the other, or share an ancestor that is no root."""

    def line(t: str) -> list[str]:
        out = [t]
        while out[-1] in parents:
            out.append(parents[out[-1]])
        return out

    types = sorted({*parents, *parents.values()})
    ok = lambda a, b: a in line(b) or b in line(a) or any(x in parents for x in set(line(a)) & set(line(b)))
    return [(a, b) for a in types for b in types if ok(a, b)]
