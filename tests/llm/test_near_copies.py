"""Near copies against all pairs, and what a cut of two fingerprint bits loses."""

import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as C
from tidewright.llm import near_copies as N

SF = "/root/testdata/sf0.01"
ROW = "doc_id long, r1 long, r2 long, text string"


def plain(items, k=5, least=0.8):
    """doc_id to the smallest doc_id of its class, over all pairs that share a shingle."""
    sets = {}
    for d, text in items:
        w = (text or "").lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {()}
    root, holders, shared = {d: d for d in sets}, {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for x in s:
            for e in holders.setdefault(x, []):
                shared[e, d] = shared.get((e, d), 0) + 1
            holders[x].append(d)
    for (a, b), n in shared.items():
        if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9 and (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_sets_are_those_of_the_words_themselves():
    rng = np.random.default_rng(2)
    pool = ["The", "the", "naïve", "日本", "x", "ÄÖ", "äö", "a\u00a0b"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, 30))) + str(rng.choice(["", " \n", "\t"])) for _ in range(3000)] + [None, "", " "]
    array = pa.array(["skipped", *texts]).slice(1)
    whole, parts = N.shingle_sets(array), [x for i in range(0, len(texts), 700) for x in N.shingle_sets(array.slice(i, 700))]
    names = {}
    for text, found, again in zip(texts, whole, parts, strict=True):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\u00a0", "_").split()
        plain = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(found) == len(plain) and found.tolist() == again.tolist() == sorted(found.tolist())
        if len(plain) == 1:
            assert names.setdefault(next(iter(plain)), found[0]) == found[0]
    assert len(set(names.values())) == len(names)


def classes(out):
    rows = out.collect()
    low = {}
    for r in rows:
        low[r.root] = min(low.get(r.root, r.best.doc_id), r.best.doc_id)
    return sorted(low.values())


@pytest.mark.parametrize("crowd", [2, 64])
def test_whole_table(spark, crowd):
    items = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    df = spark.createDataFrame([(d, d, d, t) for d, t in items], ROW)
    assert classes(N.near_copy_sets(df, crowd=crowd)) == sorted(set(plain([(d, (t or "").encode()) for d, t in items]).values()))


@pytest.mark.parametrize("crowd", [2, 64])
def test_crowds_of_edited_copies(spark, crowd):
    rng = np.random.default_rng(4)
    items = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(25):
            copy = list(base)
            for i in rng.integers(0, len(copy), rng.integers(0, 9)):
                copy[i] = f"x{rng.integers(0, 10**6)}"
            items.append((len(items), " ".join(copy)))
    items += [(len(items) + i, f"shared opening of five words and then {' '.join(f'y{x}' for x in rng.integers(0, 10**6, 9))}") for i in range(90)]
    df = spark.createDataFrame([(d, d, d, t) for d, t in items], ROW)
    assert classes(N.near_copy_sets(df, crowd=crowd)) == sorted(set(plain(items).values()))


def test_stage_drops_a_copy_with_a_few_words_edited(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        edited = list(words)
        edited[50], edited[140] = "edited", "too"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    got = C.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 40, 2))


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(6)
    for n in (0, 3, 200, 3000, 90_000):
        pool = rng.integers(0, 2**63, 2 * n + 1, np.uint64)
        x, y = (np.unique(rng.choice(pool, n)) for _ in "ab")
        rows = [np.frombuffer(N.sketch(s), np.uint8)[None] for s in (x, y)]
        bound = int(N.at_most_shared(*rows, np.array([len(x)]), np.array([len(y)]))[0])
        assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))


def test_fingerprints_two_bits_apart_link_what_similarity_does_not(spark):
    """A line said forty times outweighs what differs: fingerprints are equal, and the sets of shingles are not alike."""
    said = "one line that is said over and over again. " * 40
    rows = [(1, said + "alpha beta gamma delta epsilon zeta eta theta"), (2, said + "iota kappa lambda mu nu xi omicron pi"), (3, "something else of a few words only"), (4, None), (5, "")]
    got = C.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 3, 4]
