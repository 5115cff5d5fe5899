import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import simhash as S
from tidewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(text, k=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(items, radius=2):
    """doc_id → smallest doc_id reachable, by brute force over distinct fingerprints."""
    fps = sorted({fp for _, fp in items})
    a = np.array(fps, np.uint64)
    root = dict(zip(fps, fps))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            root[find(fps[i + 1 + j])] = find(x)
    low = {}
    for d, fp in items:
        if d is not None:
            low[find(fp)] = min(low.get(find(fp), d), d)
    return [(d, fp, low.get(find(fp))) for d, fp in items]


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in df.collect())


def test_whole_table(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = sorted((d, f"{fp:016x}", c) for d, fp, c in classes([(r["doc_id"], plain(r["text"])) for r in rows]))
    assert sorted(map(tuple, QUERIES["op3_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_odd_rows(spark):
    long = "Word " * 200_000
    rows = [(3, None, 1), (1, "", 2), (2, " \t\n", 3), (5, "One two", 4), (6, "one  TWO", 5), (None, "one two", 6), (7, long, 7), (7, long, 8), (8, "É é", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int").repartition(2)
    want = classes([(d, plain(t)) for d, t, _ in rows])
    assert got(S.simhash_classes(df)) == sorted((-1 if d is None else d, fp, c) for d, fp, c in want)


def test_empty(spark):
    assert S.simhash_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("crowd", [2, 128])
def test_links_of_crowds_and_chains(spark, crowd, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(c) for c in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    items = [(i, x) for i, x in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in items], "doc_id long, fp long")
    from tidewright.common import Scratch
    from tidewright.operators.components import connected_components

    n, both = S.bit_moments(df)
    assert n == len(items)
    roots = connected_components(S.links(df.select("fp"), n, both, Scratch(spark, "t"), 2, crowd), Scratch(spark, "t"))
    root = {r.node: r.root for r in roots.collect()}
    ids = {}
    of = {r.doc_id: root.get(r.fp, r.fp) for r in df.collect()}
    for d, r in of.items():
        ids[r] = min(ids.get(r, d), d)
    assert [(d, x, ids[of[d]]) for d, x in items] == classes(items)


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 9, 30], [0, 100, 900, 901], [0, 3, 4, 5]]
    from itertools import product

    want = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in product(range(-1, 3), repeat=3) if sum(ts) == 0)
    assert sum(c[t + 1] for c, t in zip(costs, S.allocate(costs, 0))) == want[0]


def test_hash_is_the_engines(spark):
    text = "héllo wörld x"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)
