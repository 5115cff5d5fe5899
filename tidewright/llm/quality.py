"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Each text gives counts and from them a vector of transformed statistics (FEATURES). Documents that pass the base
rules are grouped by language and source, and each group's centre and scatter are those of the ``coverage`` share
of its rows with the least covariance determinant. The search begins from several starts: medians and quartile
ranges, all rows, and random small subsets. A concentration step takes the rows nearest in Mahalanobis distance and
estimates again, which does not raise the determinant. After two steps the start with the least determinant is kept, and
steps go on until no group's determinant falls. The estimate is made consistent for normal data, reweighted
once, and rows beyond the chi-squared quantile ``keep`` are rejected.

All of it is DataFrame functions. Text is read once; steps run over the stored vectors. A step adds up counts,
sums and products by group and bin of distance with map-side aggregation, so no group is ever brought together:
a group of a third of all rows costs each task a few hundred rows of sums. Of the last bin that a share needs, each
row counts in part, so every start is judged on the same number of rows and results do not depend on the order of
rows. The factor of a scatter (Cholesky) and its inverse are written out as expressions, group by group.

Defined results: a null text has no words, and fails the base rules; a null language or source is a value like any
other; groups of fewer than ``min_rows`` rows, too few for a scatter of their own, are pooled by language, then over
all; a statistic that hardly varies has at least the spread in FEATURES; repeated rows and ties are judged
alike; long texts are read whole; an empty table gives no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.common import Scratch, col, spread_join

BLANKS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
#: Statistic, and the least standard deviation that is believed.
FEATURES = {"size": 0.8, "word_length": 0.06, "symbols": 0.25, "capitals": 0.2, "same_lines": 0.3, "repeats": 0.24}
P = len(FEATURES)
BIN, BINS = 0.05, 400
BROADCAST_GROUPS = 10_000
#: Random starts, the rows of each (about), and the fall of a log determinant that ends the steps.
RANDOM_STARTS, SUBSET, SETTLED = 2, 5 * P, 1e-4


def chi2_quantile(p: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))
        low, high = (x, high) if below < p else (low, x)
    return low


def consistency(share: float, p: int = P) -> float:
    """What a scatter of the nearest ``share`` of normal rows must be multiplied by."""
    x = chi2_quantile(share, p)
    return share / (1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2 + 1)))


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __n_lines, __n_capitals."""
    t = F.coalesce(F.col(text), F.lit(""))
    size = lambda c: F.size(c).cast("long")
    df = df.withColumns({"__trimmed": F.btrim(t, F.lit(BLANKS)), "__lines": F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")})
    df = df.withColumns(
        {
            "__words": F.when(F.col("__trimmed") != "", F.split("__trimmed", SPACE)).otherwise(F.array().cast("array<string>")),
            "__word_chars": F.length(F.regexp_replace("__trimmed", SPACE, "")).cast("long"),
            "__n_symbols": F.length(F.regexp_replace("__trimmed", r"[^#*$%&|<>]+", "")).cast("long"),
            "__n_capitals": F.length(F.regexp_replace("__trimmed", r"[^A-Z]+", "")).cast("long"),
            "__n_lines": size("__lines"),
            "__n_dup_lines": size("__lines") - size(F.array_distinct("__lines")),
        }
    ).drop("__trimmed", "__lines")
    word = F.col("__words")
    windows = F.when(F.size(word) > 2, F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2])))
    df = df.withColumns({"__n_words": size("__words"), "__windows": windows}).drop("__words")
    # Only texts in which some window comes again are sorted.
    again = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumn("__sorted", F.when(again, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__windows")
    s = F.col("__sorted")
    same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))
    places = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return df.withColumn("__n_repeat_words", F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(places))).cast("long")).drop("__sorted")


def base_failed() -> Column:
    return (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))


def vector() -> dict[str, Column]:
    words, chars = F.greatest("__n_words", F.lit(1)), F.greatest("__word_chars", F.lit(1))
    return {
        "size": F.log1p("__n_words"),
        "word_length": F.log(chars / words),
        "symbols": F.log1p(100 * F.col("__n_symbols") / chars),
        "capitals": F.log1p(20 * F.col("__n_capitals") / chars),
        "same_lines": F.log1p(10 * F.col("__n_dup_lines") / F.greatest("__n_lines", F.lit(1))),
        "repeats": F.log1p(10 * F.col("__n_repeat_words") / words),
    }


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _with_factor(groups: DataFrame, scale: float) -> DataFrame:
    """Per group and start, from m0.. and c0_0.. (covariances): the log determinant of the scaled, floored scatter, and
    the inverse w0_0.. of its Cholesky factor l0_0.., both lower triangles."""
    floors = list(FEATURES.values())

    def rest(i: int, j: int) -> Column:
        c = scale * F.col(f"c{i}_{j}")
        if i == j:
            c = F.greatest(c, F.lit(floors[i] ** 2)) + F.lit(1e-6)
        for k in range(j):
            c = c - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        return c

    for j in range(P):
        # Raising a variance to its floor keeps a scatter positive; the last guard is against rounding.
        groups = groups.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1e-9))))
        groups = groups.withColumns({f"l{i}_{j}": rest(i, j) / F.col(f"l{j}_{j}") for i in range(j + 1, P)}) if j < P - 1 else groups
    for i in range(P):
        unit = {j: sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j + 1, i)), F.col(f"l{i}_{j}") * F.col(f"w{j}_{j}")) for j in range(i)}
        groups = groups.withColumns({f"w{i}_{j}": -c / F.col(f"l{i}_{i}") for j, c in unit.items()} | {f"w{i}_{i}": 1 / F.col(f"l{i}_{i}")})
    det = sum((2 * F.log(f"l{i}_{i}") for i in range(1, P)), 2 * F.log("l0_0"))
    return groups.select("group", "start", "rows", det.alias("det"), *[f"m{i}" for i in range(P)], *[f"w{i}_{j}" for i, j in _pairs()])


def _with_distance(rows: DataFrame, params: DataFrame, few: bool, total: int) -> DataFrame:
    """A row for each of the row's group's starts, with ``start`` and __d, the Mahalanobis distance."""
    shape = [c for c in params.columns if c not in ("group", "rows", "det")]
    # One row a group, so that the join never multiplies the rows of a hot group in one task.
    groups = params.groupBy("group").agg(F.collect_list(F.struct(*shape)).alias("__starts"), F.max("rows").alias("rows"))
    df = rows.join(F.broadcast(groups.drop("rows")), "group", "left") if few else spread_join(rows, groups, "group", "rows", total, "left")
    df = df.select(*rows.columns, F.explode_outer("__starts").alias("__s")).select(*rows.columns, "__s.*")
    # Each term stands once: Spark writes the distance out in every filter on it, and a chain of substitutions, each with
    # all those before it, grew past what it compiles (64 KB a method).
    off = [F.col(name) - F.col(f"m{i}") for i, name in enumerate(FEATURES)]
    z = [sum((F.col(f"w{i}_{k}") * off[k] for k in range(1, i + 1)), F.col(f"w{i}_0") * off[0]) for i in range(P)]
    square = sum((F.pow(x, F.lit(2.0)) for x in z[1:]), F.pow(z[0], F.lit(2.0)))
    return df.select(*rows.columns, "start", F.sqrt(square).alias("__d"))


def _sums() -> list[Column]:
    names = list(FEATURES)
    return [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in _pairs()]


def _moments(sums: DataFrame) -> DataFrame:
    """Means and covariances from n and the sums."""
    means = sums.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(P)})
    return means.withColumns({f"c{i}_{j}": F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _pairs()})


def _estimate(rows: DataFrame, share: float | None = None, within: float | None = None) -> DataFrame:
    """Means and covariances by group and start of the nearest ``share`` of the rows, or of the bins of distance ``within``."""
    binned = rows.withColumn("bin", F.least(F.floor(F.col("__d") / BIN), F.lit(BINS)).cast("int"))
    by_bin = binned.groupBy("group", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *_sums())
    group = W.partitionBy("group", "start")
    by_bin = by_bin.withColumns({"rows": F.sum("n").over(group), "before": F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    part = F.greatest(F.least((share * F.col("rows") - F.col("before")) / F.col("n"), F.lit(1.0)), F.lit(0.0)) if share else (F.col("bin") * BIN < within).cast("double")
    weighed = by_bin.withColumn("part", part).where("part > 0")
    total = weighed.groupBy("group", "start").agg(F.max("rows").alias("rows"), *[F.sum(F.col("part") * F.col(c)).alias(c) for c in by_bin.columns if c == "n" or c[0] in "sq" and c[1].isdigit()])
    return _moments(total)


def _quartiles(rows: DataFrame) -> DataFrame:
    """Medians, and squared quartile ranges as variances, from bins of 0.01 of each statistic."""
    tall = rows.select("group", F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.floor(F.col(n) * 100).cast("int").alias("bin")) for i, n in enumerate(FEATURES)])).alias("x")).select("group", "x.*")
    bins = tall.groupBy("group", "of", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("group", "of")
    bins = bins.withColumns({"rows": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bin"))})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bin") / 100 + 0.005))
    stats = bins.groupBy("group", "of").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"), F.max("rows").alias("rows"))
    pick = lambda i, c: F.max(F.when(F.col("of") == i, c))
    spread = (F.col("high") - F.col("low")) / 1.349
    wide = stats.groupBy("group").agg(*[pick(i, F.col("mid")).alias(f"m{i}") for i in range(P)], *[pick(i, spread * spread).alias(f"c{i}_{i}") for i in range(P)], F.max("rows").alias("rows"))
    return wide.withColumns({f"c{i}_{j}": F.lit(0.0) for i, j in _pairs() if i != j} | {"start": F.lit(0)})


def _starts(rows: DataFrame) -> DataFrame:
    """The starts of every group: 0 its medians, 1 all its rows, 2 and on the rows that a hash of the vector picks."""
    among = F.greatest(F.floor(F.col("group_rows") / SUBSET), F.lit(1))
    picked = [F.when(F.pmod(F.xxhash64(F.lit(k), *FEATURES), among) == 0, F.lit(k)) for k in range(2, 2 + RANDOM_STARTS)]
    chosen = rows.select("group", *FEATURES, "group_rows", F.explode(F.array_compact(F.array(F.lit(1), *picked))).alias("start"))
    moments = _moments(chosen.groupBy("group", "start").agg(F.max("group_rows").alias("rows"), F.count(F.lit(1)).alias("n"), *_sums()))
    shape = ["group", "start", "rows", *[f"m{i}" for i in range(P)], *[f"c{i}_{j}" for i, j in _pairs()]]
    return _quartiles(rows).select(*shape).unionByName(moments.select(*shape))


def _least(passed: DataFrame, coverage: float, steps: int, few: bool, total: int, scratch: Scratch) -> DataFrame:
    """Per group the factor of the least determinant found: two steps from every start, then the best one's until none falls."""
    params = scratch.save(_with_factor(_starts(passed), 1.0), "params-0")
    for step in range(1, 3):
        params = scratch.save(_with_factor(_estimate(_with_distance(passed, params, few, total), share=coverage), consistency(coverage)), f"params-{step}")
    names = params.columns
    params = params.groupBy("group").agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("p")).select("p.*")
    for step in range(3, steps + 1):
        if step == 3:
            params = scratch.save(params, "best-2")
        new = _with_factor(_estimate(_with_distance(passed, params, few, total), share=coverage), consistency(coverage))
        old = params.select("group", F.struct(*names).alias("old"))
        fell = F.col("det") < F.col("old.det") - SETTLED
        both = new.select("group", F.struct(*names).alias("new"), "det").join(old, "group").select(F.when(fell, F.col("new")).otherwise(F.col("old")).alias("p"), fell.alias("fell"))
        params = scratch.save(both.select("p.*", "fell"), f"best-{step}")
        moved = params.where("fell").limit(1).count()
        params = params.drop("fell")
        if not moved:
            break
    return params


def _grouped(stored: DataFrame, min_rows: int, scratch: Scratch) -> tuple[DataFrame, int, bool]:
    """Rows with ``group`` and ``group_rows``, its rows that passed the base rules; the number of all of those; if groups are few."""
    sizes = stored.where("not __base_failed").groupBy("lang", "both").agg(F.count(F.lit(1)).alias("rows"))
    small = F.sum(F.when(F.col("rows") < min_rows, F.col("rows"))).over(W.partitionBy("lang"))
    sizes = sizes.withColumn("group", F.when(F.col("rows") >= min_rows, F.col("both")).when(small >= min_rows, F.col("lang")).otherwise(F.lit("all")))
    sizes = scratch.save(sizes.select("both", "group", "rows", F.sum("rows").over(W.partitionBy("group")).alias("group_rows")), "groups")
    count, total = sizes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    few = count <= BROADCAST_GROUPS
    if few:
        return stored.join(F.broadcast(sizes.drop("rows")), "both", "left"), total or 0, few
    return spread_join(stored, sizes, "both", "rows", total, "left"), total, few


COUNTS = ["__n_words", "__word_chars", "__n_symbols", "__n_dup_lines", "__n_repeat_words"]


def _judged(docs: DataFrame, carry: list[str], coverage: float, steps: int, keep: float, min_rows: int) -> DataFrame:
    """__own (the ``carry`` columns as one), COUNTS, __base_failed, __distance and __kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    null = F.lit("null")
    lang, source = F.coalesce(F.concat(F.lit("="), F.col("lang")), null), F.coalesce(F.concat(F.lit("="), F.col("source")), null)
    own = docs.select(F.struct(*map(col, carry)).alias("__own"), F.col("text").alias("__text"), F.to_json(F.array(lang)).alias("lang"), F.to_json(F.array(lang, source)).alias("both"))
    rows = with_counts(own, "__text").withColumn("__base_failed", base_failed())
    stored = scratch.save(rows.select("__own", "lang", "both", *COUNTS, "__base_failed", *[c.alias(n) for n, c in vector().items()]), "rows")
    judged, total, few = _grouped(stored, min_rows, scratch)
    passed = scratch.save(judged.where("not __base_failed").select("group", "group_rows", *FEATURES), "vectors")
    params = _least(passed, coverage, steps, few, total, scratch)
    inner = _estimate(_with_distance(passed, params, few, total), within=math.sqrt(chi2_quantile(0.975, P)))
    params = scratch.save(_with_factor(inner, consistency(0.975)), "params")
    out = _with_distance(judged, params, few, total)
    kept = ~F.col("__base_failed") & F.coalesce(F.col("__d") <= math.sqrt(chi2_quantile(keep, P)), F.lit(True))
    return out.select("__own", *COUNTS, "__base_failed", F.col("__d").alias("__distance"), kept.alias("__kept"))


def quality_rules(docs: DataFrame, carry: list[str] | None = None, coverage: float = 0.75, steps: int = 30, keep: float = 1 - 1e-9, min_rows: int = 5 * P) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all by default), COUNTS, __base_failed, __distance and __kept."""
    return _judged(docs, docs.columns if carry is None else carry, coverage, steps, keep, min_rows).select("__own.*", *COUNTS, "__base_failed", "__distance", "__kept")


def keep_good(docs: DataFrame, coverage: float = 0.75, steps: int = 30, keep: float = 1 - 1e-9, min_rows: int = 5 * P) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    return _judged(docs, docs.columns, coverage, steps, keep, min_rows).where("__kept").select("__own.*")
