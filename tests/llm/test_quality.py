"""Quality rules against a plain calculation of the counts and, in numpy, of the same robust estimate."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidewright.common import Scratch
from tidewright.llm import quality as Q
from tidewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, same = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            same += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), same, len(covered))


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def vector(text, c):
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in text.split("\n"))
    caps = len(re.findall("[A-Z]", text))
    return [np.log1p(c[0]), np.log(c[1] / c[0]), np.log1p(100 * c[2] / c[1]), np.log1p(20 * caps / c[1]), np.log1p(10 * c[3] / max(lines, 1)), np.log1p(10 * c[4] / c[0])]


def distances(x, coverage=0.75):
    """By another road: exact subsets of the nearest rows, many random starts, the least determinant."""
    floor = np.array(list(Q.FEATURES.values()))
    rng = np.random.default_rng(3)

    def estimate(rows, scale):
        cov = np.cov(rows.T, bias=True) * scale
        cov[np.diag_indices(6)] = np.maximum(np.diag(cov), floor**2) + 1e-6
        return rows.mean(0), cov

    def d(mean, cov):
        diff = x - mean
        return np.sqrt(np.einsum("ij,ij->i", diff, np.linalg.solve(cov, diff.T).T))

    best, h = None, int(np.ceil(coverage * len(x)))
    for start in range(30):
        mean, cov = estimate(x if not start else x[rng.choice(len(x), min(len(x), 30), replace=False)], 1.0)
        for _ in range(50):
            mean, cov = estimate(x[np.argsort(d(mean, cov), kind="stable")[:h]], Q.consistency(coverage))
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, mean, cov
    near = d(*best[1:]) < np.sqrt(Q.chi2_quantile(0.975, 6))
    return best[0], d(*estimate(x[near], Q.consistency(0.975)))


def planted(n=3000, seed=2, far=0.2):
    """Correlated vectors, a fifth of them from a tight cloud elsewhere, which pulls plain estimates towards it."""
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(6, 6)) * 0.8
    x = rng.normal(size=(n, 6)) @ mix + 5
    bad = rng.random(n) < far
    x[bad] = rng.normal(size=(int(bad.sum()), 6)) * 0.3 + 30
    return x, bad


def test_the_least_determinant_is_found(spark):
    x, bad = planted()
    rows = spark.createDataFrame([("g", len(x), *map(float, v)) for v in x], ", ".join(["group string, group_rows long", *[f"{n} double" for n in Q.FEATURES]]))
    scratch = Scratch(spark, "t")
    rows = scratch.save(rows, "x")
    least = Q._least(rows, 0.75, 30, True, len(x), scratch).collect()
    det, _ = distances(x)
    assert len(least) == 1 and least[0].rows == len(x) and least[0].det == pytest.approx(det, abs=0.05)
    starts = Q._with_factor(Q._starts(rows), 1.0).collect()
    assert sorted(r.start for r in starts) == list(range(2 + Q.RANDOM_STARTS)) and all(r.det > least[0].det for r in starts if r.start < 2)
    dist = [r["__d"] for r in Q._with_distance(rows, Q._least(rows, 0.75, 30, True, len(x), scratch), True, len(x)).orderBy(*Q.FEATURES).collect()]
    flags = [b for _, b in sorted(zip(map(tuple, x), bad))]
    limit = np.sqrt(Q.chi2_quantile(1 - 1e-9, 6))
    assert all((d > limit) == f for d, f in zip(dist, flags))


@pytest.mark.parametrize("name", list(Q.FEATURES))
def test_each_statistic_can_reject(name):
    """At its least spread and alone, each one reaches values beyond the cut."""
    most = {"size": np.log1p(10**9), "word_length": np.log(10**6), "symbols": np.log1p(100), "capitals": np.log1p(20), "same_lines": np.log1p(10), "repeats": np.log1p(5)}
    start = {"size": np.log1p(300), "word_length": np.log(5)}
    assert ((most[name] - start.get(name, 0)) / Q.FEATURES[name]) ** 2 > Q.chi2_quantile(1 - 1e-9, 6)


def test_whole_table(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang", "source"]).to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    c = {r["doc_id"]: counts(r["text"]) for r in docs}
    kept = {d: not failed(x) for d, x in c.items()}
    ok = [r for r in docs if kept[r["doc_id"]]]
    by = Counter((r["lang"], r["source"]) for r in ok)
    group = lambda r: (r["lang"], r["source"]) if by[r["lang"], r["source"]] >= 30 else r["lang"]
    size = Counter(map(group, ok))
    group2 = lambda r: group(r) if size[group(r)] >= 30 else "all"
    limit = np.sqrt(Q.chi2_quantile(1 - 1e-9, 6))
    for g in set(map(group2, ok)):
        rows = [r for r in ok if group2(r) == g]
        far = distances(np.array([vector(r["text"], c[r["doc_id"]]) for r in rows]))[1] > limit
        for r, f in zip(rows, far):
            kept[r["doc_id"]] = not f
    got = {r.doc_id: tuple(r)[1:8] for r in QUERIES["op2_quality_rules"](spark, SF).collect()}
    assert got == {d: (*c[d], failed(c[d]), kept[d]) for d in c}
    assert all(kept[d] == bool(q) for d, q in labels.items() if not failed(c[d]))


ODD = [
    (1, None, "en", "a", 1, "m"),
    (2, "", None, None, None, None),
    (None, " \n \t", None, "a", 3, "m"),
    (4, "one two three one two three one", "en", "a", 4, None),
    (4, "one two three one two three one", "en", "a", 4, None),
    (5, "  lead and trail \n\n x\n x\n\x1ckeep\x85 \xa0 ", "xx", "b", 5, "m"),
    (6, "a b c d " * 60_000, "en", "a", 6, "m"),
    (7, "ñandú 😀 #*$%&|<> é\n" * 3, "es", "b", 7, "m"),
]
SCHEMA = "doc_id long, text string, lang string, source string, __d int, m0 string"


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumnRenamed("__d", "rows")
    out = Q.quality_rules(df)
    assert out.columns[:6] == df.columns
    got = sorted(((r["doc_id"] or 0, *(r[c] for c in Q.COUNTS), r["__base_failed"]) for r in out.collect()))
    assert got == sorted((d or 0, *counts(t), failed(counts(t))) for d, t, *_ in ODD)
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_are_kept_keep_their_columns(spark):
    df = spark.createDataFrame([(i, f"word{i % 7} " * 60 if i % 2 else "short", "en", "s", 1, 2) for i in range(80)], "doc_id long, text string, lang string, source string, __kept int, `a.b` int")
    out = Q.keep_good(df)
    assert out.columns == df.columns
    varied = spark.createDataFrame([(i, " ".join(f"w{j * (i + 1)}" for j in range(60 + i)), "en", "s", 1, 2) for i in range(80)], df.schema)
    assert Q.keep_good(varied).count() == 80


def test_many_groups_take_the_other_join(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    few = {r["doc_id"]: r["__kept"] for r in Q.quality_rules(df, ["doc_id"]).collect()}
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert {r["doc_id"]: r["__kept"] for r in Q.quality_rules(df, ["doc_id"]).collect()} == few


@pytest.mark.parametrize("p", [0.5, 0.9, 0.999])
def test_quantiles(p):
    rng = np.random.default_rng(0)
    assert Q.chi2_quantile(p, 6) == pytest.approx(np.quantile((rng.normal(size=(400_000, 6)) ** 2).sum(1), p), rel=0.03)


def test_the_filter_on_kept_rows_is_compiled(spark):
    """Spark writes the distance out in the filter: it must not grow past the 64 KB of a method."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        kept = [r.doc_id for r in Q.keep_good(docs).collect()]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert sorted(kept) == sorted(r.doc_id for r in Q.quality_rules(docs, ["doc_id"]).where("__kept").collect())
