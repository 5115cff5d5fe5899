"""Line and exact deduplication against brute force, over several batches and compactions, and odd rows."""

import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.common import Files, Scratch
from tidewright.llm.exact_dedup import DigestIndex, exact_dedup
from tidewright.llm.line_dedup import LineRuns, dedup_batch, line_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, pos string, h1 int"


def plain(rows, min_chars=10):
    owner = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    rank = lambda d: (d is None, d or 0)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), d), d, key=rank)
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or owner[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["__lines"], r["__dropped"], r["text"]) for r in df.collect()), key=repr)


def corpus(n=120, seed=4):
    rng = np.random.default_rng(seed)
    pool = [f"A shared line number {i}" for i in range(40)] + ["short", "", "  \t", "Ünïcode LINE ÄÖ", "ünïcode line äö"]
    rows = []
    for d in range(n):
        lines = [str(rng.choice(pool)) + (" " if rng.random() < 0.3 else "") for _ in range(rng.integers(1, 9))]
        if rng.random() < 0.5:
            lines.append("A shared line number 7")
        rows.append((d, "\n".join(lines).upper() if rng.random() < 0.2 else "\n".join(lines), "x", d))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines(spark, batches):
    rows = corpus()
    assert got(line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), batches=batches)) == plain(rows)


def test_runs_stay_few_and_hold_each_hash_once(spark):
    runs = LineRuns(spark, fanout=2, buckets=4)
    scratch, out = Scratch(spark, "t"), []
    rows = corpus(60, 9)
    for i in range(0, 60, 10):
        out += got(dedup_batch(spark.createDataFrame(rows[i : i + 10], SCHEMA), runs, scratch))
        assert all(len(level) < 2 for level in runs.levels)
    assert sorted(out, key=repr) == plain(rows)
    held = [tuple(r) for level in runs.levels for t in level for r in runs.run(t).collect()]
    assert len(held) == len({x[:2] for x in held})


def test_runs_are_opened_again(spark):
    rows, scratch, out = corpus(60, 11), Scratch(spark, "t"), []
    name = f"runs_{uuid.uuid4().hex[:8]}"
    for i in range(0, 60, 20):
        # Each batch opens the runs anew; before the last, this session has forgotten the tables.
        runs = LineRuns(spark, name, buckets=3 + i)
        assert runs.store.buckets == 3
        out += got(dedup_batch(spark.createDataFrame(rows[i : i + 20], SCHEMA), runs, scratch))
        for t in runs.store.tables if i == 20 else ():
            spark.sql(f"DROP TABLE `{t}`")
    assert sorted(out, key=repr) == plain(rows)
    # What was written but never recorded does not count, and does no harm.
    runs.store.append(runs.store.create(), runs.store.table(next(iter(runs.store.tables))))
    again = LineRuns(spark, name)
    assert len(again.store.tables) == len(runs.store.tables) - 1
    assert got(dedup_batch(spark.createDataFrame([(99, rows[0][1], "x", 1)], SCHEMA), again, scratch)) == [x for x in plain([*rows, (99, rows[0][1], "x", 1)]) if x[0] == 99]
    root = again.store.files.root
    again.drop()
    assert Files(spark, root).names() == []


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a line to be shared", 1, 2, 3, 4, 5), (2, "a line to be shared\nown", 1, 2, 3, 4, 5)], "doc_id long, text string, __gone int, __parts int, own int, r1 int, `a.b` int")
    out = line_dedup(df)
    assert out.columns == [*df.columns, "__lines", "__dropped"] and sorted(out.collect())[1][1] == "own"
    clash = df.withColumnRenamed("r1", "__lines")
    assert line_dedup(clash, counts=False).columns == clash.columns and line_dedup(clash, counts=False).count() == 2


def test_lines_odd_rows(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(50_000))
    rows = [(1, None, "a", 1), (2, "", None, 2), (2, "", None, 2), (None, "line 7 of a very long text\nown line of null", "b", 3), (None, "only null rows hold this", "b", 3), (5, long, "c", 4), (4, long, "c", 4), (6, "dup in one dup in one\ndup in one dup in one", "c", None), (7, "twice the same row here", "c", 1), (7, "twice the same row here", "c", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = line_dedup(df, batches=3)
    assert out.columns == [*df.columns, "__lines", "__dropped"]
    assert got(out) == plain(rows)
    assert line_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def digest(text):
    return hashlib.sha256(re.sub("[ \t\n\x0b\x0c\r]+", " ", text or "").encode()).hexdigest()


def test_exact_over_batches(spark):
    first = [(5, "a b", "x"), (3, "a \t\nb", "x"), (9, None, "x"), (7, "", "x"), (8, "a b", "x"), (8, "c " * 100_000, "x")]
    second = [(1, "a  b", "x"), (20, "new", "x"), (21, "new", "x"), (None, "new", "x"), (None, "null alone", "x"), (30, "c  " * 100_000, "x")]
    index = DigestIndex(spark, buckets=4)
    a = {(r.doc_id, digest_hex(r)): (r.keep_id, r.group_size, r.kept) for r in index.ingest(spark.createDataFrame(first, "doc_id long, text string, digest string")).collect()}
    assert a[5, digest("a b")] == (3, 2, False) and a[3, digest("a b")] == (3, 2, True)
    assert a[7, digest("")] == (7, 2, True) and a[9, digest("")] == (7, 2, False) and a[8, digest("a b")] == (8, 1, True)
    b = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in index.ingest(spark.createDataFrame(second, "doc_id long, text string, digest string")).collect()], key=repr)
    assert b == sorted([(1, 3, 1, False), (20, 20, 3, True), (21, 20, 3, False), (None, 20, 3, False), (None, None, 1, True), (30, 8, 1, False)], key=repr)
    assert index.table().count() == index.table().select("digest").distinct().count() == 6
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_in_batches(spark, batches):
    rng = np.random.default_rng(batches)
    rows = [(int(rng.integers(0, 200)) if rng.random() < 0.95 else None, str(rng.choice(["a", "b  c", "b c", "", "d\te", "d e"])) + str(rng.integers(0, 9))) for _ in range(400)]
    groups = {}
    for d, t in rows:
        groups.setdefault(digest(t), []).append(d)
    keep = {h: min((d for d in ds if d is not None), default=None) for h, ds in groups.items()}
    want = sorted([(d, keep[digest(t)], len(groups[digest(t)]), d == keep[digest(t)]) for d, t in rows], key=repr)
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()], key=repr) == want


def test_index_is_opened_again(spark):
    name = f"index_{uuid.uuid4().hex[:8]}"
    DigestIndex(spark, name, buckets=3).ingest(spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string"))
    for t in DigestIndex(spark, name).store.tables:
        spark.sql(f"DROP TABLE `{t}`")
    index = DigestIndex(spark, name, buckets=9)
    assert index.store.buckets == 3 and index.table().count() == 2
    assert [tuple(r)[2:] for r in index.ingest(spark.createDataFrame([(9, "a  b")], "doc_id long, text string")).collect()] == [(5, 1, False)]
    index.drop()
    assert DigestIndex(spark, name).table().count() == 0


def digest_hex(r):
    return bytes(r.digest).hex()


def test_index_join_does_not_shuffle_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    index.ingest(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"))
    rows = spark.range(40).select(F.unhex(F.sha2(F.concat(F.lit("text "), F.col("id").cast("string")), 256)).alias("digest"))
    plan = rows.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
