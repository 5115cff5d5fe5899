"""Entity resolution, search, communities and betweenness against brute force on small fixtures."""

from itertools import combinations

import numpy as np
import pytest

from tidewright.common import Scratch
from tidewright.operators import components as C
from tidewright.operators import network as N
from tidewright.operators import resolution as E

EDGES = "source_id string, dest_id string"


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_like_names_loses_no_pair(spark, least):
    rng = np.random.default_rng(int(least * 100))
    words = ["".join(rng.choice(list("abcde "), rng.integers(1, 14))).strip() for _ in range(160)]
    for w in list(words[:80]):
        i = int(rng.integers(0, max(len(w), 1)))
        words.append(w[:i] + str(rng.choice(list("xyz"))) + w[i + int(rng.integers(0, 2)) :])
    names = sorted({w for w in words if w})
    got = {(r.key_a, r.key_b): r.ratio for r in E.like_names(spark.createDataFrame([(n,) for n in names], "key string"), least).collect()}
    want = {(a, b): E.ratio(a, b) for a, b in combinations(names, 2) if E.ratio(a, b) >= least}
    assert got == pytest.approx(want) and want


def test_short_names_of_few_letters_meet_by_their_rests(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = {"".join(rng.choice(list("0123"), 15)) for _ in range(300)}
    names = sorted(names | {w[:4] + w[6:] + "zé" for w in list(names)[:90]} | {w[:14] for w in list(names)[:90]})
    df = spark.createDataFrame([(n,) for n in names], "key string")
    met = E._met_by_rests(df, {14: [12, 13], 15: [13]}).count()
    want = {(a, b): E.ratio(a, b) for a, b in combinations(names, 2) if E.ratio(a, b) >= 0.85}
    # Of 108,000 pairs in all, few but those alike are compared.
    assert len(want) <= met < 5 * len(want)
    monkeypatch.setattr(E, "_pieces", None)
    assert {(r.key_a, r.key_b): r.ratio for r in E.like_names(df, 0.85).collect()} == pytest.approx(want)


def test_names_of_any_length_meet(spark):
    rng = np.random.default_rng(6)
    long = ["".join(rng.choice(list("abcdefgh "), n)).strip() for n in (15, 17, 22, 40) for _ in range(30)]
    names = sorted({*long, *(w[:3] + w[5:] for w in long), *(w[:9] + "xy" + w[9:] for w in long), "a", "b", "ab", ""} - {""})
    got = {(r.key_a, r.key_b): r.ratio for r in E.like_names(spark.createDataFrame([(n,) for n in names], "key string"), 0.85, most=200).collect()}
    assert got == pytest.approx({(a, b): E.ratio(a, b) for a, b in combinations(names, 2) if E.ratio(a, b) >= 0.85}) and len(got) > 200


def test_pairs_of_compatible_types_need_more(spark):
    rows = [("1", "a", "company", "Blue Ocean Ltd."), ("2", "b", "organization", "blue ocean ltd"), ("3", "b", "port", "Blue Ocean Ltd"), ("4", "b", "company", "Blue Ocaen Ltd"), ("5", "c", "organization", "Blue Ocxxn Ltd"), ("6", "b", None, None), ("7", "a", "company", "Blue Ocean Ltd")]
    e = spark.createDataFrame(rows, "id string, source_name string, entity_type string, name string")
    got = {(r.id_a, r.id_b) for r in E.name_pairs(e).collect()}
    assert ("1", "2") in got and ("1", "4") in got and not any("3" in p or "6" in p for p in got) and ("1", "5") not in got
    assert E.name_pairs(e.where("false")).collect() == []
    assert E.compatible("species_observation", "taxon") and E.compatible("port", "infrastructure_entity") and E.compatible("port", "entity") and not E.compatible("port", "taxon") and not E.compatible("project", "contract")


def test_merges_keep_what_is_there(spark):
    e = spark.createDataFrame([("1", "n", {"x": "1", "y": "1"}), ("2", "m", {"y": "2", "z": "2"}), ("3", "o", {"z": "3", "w": "3"}), ("4", "p", None)], "id string, name string, payload map<string,string>")
    got = {r.id: r for r in E.merged(e, spark.createDataFrame([("1", "2"), ("1", "3")], "keep_id string, drop_id string")).collect()}
    assert got["1"].payload == {"x": "1", "y": "1", "z": "2", "w": "3"} and got["1"].provenance == ["2", "3"] and got["1"].status == "active"
    assert got["2"].status == got["3"].status == "merged" and got["2"].into == "1" and got["4"].payload is None


def clustered(n=3000, dims=24, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(40, dims)) * 2
    return middle[rng.integers(0, 40, n)] + rng.normal(size=(n, dims))


def test_search_finds_nine_of_ten_and_more(spark):
    x = clustered()
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(90_000, None)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    ask = list(range(0, len(x), 20))
    got = {}
    for r in N.nearest(v.where("id % 20 = 0"), v, 10, part_rows=100).collect():
        got.setdefault(r.probe, set()).add(r.id)
    sims = u[ask] @ u.T
    sims[np.arange(len(ask)), ask] = -np.inf
    want = [set(np.argsort(-row)[:10].tolist()) for row in sims]
    assert np.mean([len(w & got.get(i, set())) / 10 for i, w in zip(ask, want)]) >= 0.9
    exact = N.nearest(v.where("id % 20 = 0"), v, 10, lists=5, look=5, part_rows=300).collect()
    assert {(r.probe, r.id) for r in exact} == {(i, j) for i, w in zip(ask, want) for j in w}
    assert N.nearest(v, v.where("false")).collect() == []


def test_semantic_edges_join_kinds(spark):
    x, kinds = clustered(400), ["a", "b", "c"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    of = [kinds[0 if i % 8 == 0 else 1 if i % 3 else 2] for i in range(len(x))]
    v = spark.createDataFrame([(i, k, row.tolist()) for i, (k, row) in enumerate(zip(of, x))], "id long, kind string, v array<double>")
    order = sorted(kinds, key=lambda k: (of.count(k), k))
    want = set()
    for i, k in enumerate(of):
        for c in order[order.index(k) + 1 :]:
            best = sorted((j for j in range(len(x)) if of[j] == c and u[i] @ u[j] >= 0.5), key=lambda j: -(u[i] @ u[j]))[:5]
            want |= {(min(i, j), max(i, j)) for j in best}
    assert {(r.source_id, r.target_id) for r in N.semantic_edges(v, 5, 0.5, None, lists=1).collect()} == want


def test_communities_are_those_planted(spark):
    rng = np.random.default_rng(3)
    edges = [(f"g{g}n{a:02}", f"g{g}n{b:02}") for g in range(4) for a, b in combinations(range(12 + g), 2) if rng.random() < 0.7]
    edges += [(f"g{g}n00", f"g{(g + 1) % 4}n01") for g in range(4)]
    df = spark.createDataFrame(edges, EDGES)
    of = {r.node: r.community for r in N.communities(df).collect()}
    assert all(of[n] == 3 - int(n[1]) for n in of)  # numbered by size
    assert N.modularity(df, N.communities(df)) > 0.6
    about = spark.createDataFrame([(n, f"k{int(n[1]) % 2}", f"s{n[-1]}") for n in of], "id string, kind string, source string")
    got = {r.community: r for r in N.community_summary(N.communities(df), about).collect()}
    assert got[0]["size"] == 15 and got[0].kinds == ["k1=15"] and got[0].members == [f"g3n{i:02}" for i in range(15)] and len(got[0].sources) == 10
    bridges = {r.id: (r.communities, r.kinds) for r in N.bridge_nodes(df, N.communities(df), about).collect()}
    assert set(bridges) == {f"g{g}n0{i}" for g in range(4) for i in (0, 1)} and set(bridges.values()) == {(2, 2)}


def test_communities_of_small_parts_take_no_rounds_of_joins(spark, monkeypatch):
    rng = np.random.default_rng(7)
    edges = [(f"p{p}g{g}n{a:02}", f"p{p}g{g}n{b:02}") for p in range(3) for g in range(3) for a, b in combinations(range(9 + p + 3 * g), 2) if rng.random() < 0.8]
    edges += [(f"p{p}g{g}n00", f"p{p}g{(g + 1) % 3}n01") for p in range(3) for g in range(3)] + [("lone1", "lone2"), ("loop", "loop")]
    df = spark.createDataFrame(edges, EDGES)
    groups = lambda **more: sorted(sorted(r.node for r in rows) for rows in [[r for r in got if r.community == c] for got in [N.communities(df, **more).collect()] for c in sorted({r.community for r in got})])
    large = groups(held=100)
    monkeypatch.setattr(N, "_joined_louvain", None)
    of = groups()
    assert of == large and len(of) == 10 and ["lone1", "lone2"] in of and all(len({n[:4] for n in g}) == 1 for g in of if len(g) > 2)


def test_communities_are_found_without_weighing_or_numbering_first(spark, monkeypatch):
    # Repeated edges weigh more: without weights, the node in the middle of the path could go either way.
    edges = [("a", "b")] * 3 + [("b", "c")] + [("d", "c")] * 3 + [("b", "a")] + [("y", "x")] * 2 + [("x", "x"), (None, "x")]
    df = spark.createDataFrame(edges, EDGES)
    large = {(r.node, r.community) for r in N.communities(df, held=3).collect()}
    for name in ("weighed_once", "parted", "placed"):  # a shuffle of all edges, or more, each
        monkeypatch.setattr(N, name, None)
    got = {(r.node, r.community) for r in N.communities(df).collect()}
    assert got == large == {("a", 0), ("b", 0), ("c", 1), ("d", 1), ("x", 2), ("y", 2)}
    assert N.communities(df.where("false")).collect() == []


def test_betweenness_of_a_path_and_a_star(spark):
    path = [(f"n{i}", f"n{i + 1}") for i in range(5)]
    got = {r.id: r.betweenness for r in N.betweenness(spark.createDataFrame(path, EDGES)).collect()}
    assert got == pytest.approx({f"n{i}": 2 * i * (5 - i) / 20 for i in range(6)})
    star = [("hub", f"n{i}") for i in range(6)]
    got = {r.id: r.betweenness for r in N.betweenness(spark.createDataFrame(star, EDGES)).collect()}
    assert got["hub"] == pytest.approx(1.0) and all(v == 0 for k, v in got.items() if k != "hub")
    # Two edges between two nodes are twice as far, so the way round is as short and half the paths take it.
    square = [("a", "b"), ("a", "b"), ("a", "c"), ("c", "b")]
    got = {r.id: r.betweenness for r in N.betweenness(spark.createDataFrame(square, EDGES)).collect()}
    assert got == pytest.approx({"a": 0.0, "b": 0.0, "c": 0.5})
    assert N.betweenness(spark.createDataFrame([], EDGES)).collect() == []


def test_constraint_meets_no_paths_but_triangles(spark, monkeypatch):
    from tidewright.operators import graph as G

    rng, saved, save = np.random.default_rng(11), {}, G.Scratch.save

    def keep(self, df, name):
        saved[name] = save(self, df, name)
        return saved[name]

    monkeypatch.setattr(G.Scratch, "save", keep)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (90, 2))]
    w = {}
    for a, b in pairs:
        if a != b:
            w[a, b], w[b, a] = w.get((a, b), 0) + 1, w.get((b, a), 0) + 1
    p = {(a, b): n / sum(m for (x, _), m in w.items() if x == a) for (a, b), n in w.items()}
    want = {a: sum((p[a, b] + sum(p[a, c] * p[c, b] for c in want_nodes if (a, c) in p and (c, b) in p and c != b)) ** 2 for b in want_nodes if (a, b) in p) for want_nodes in [sorted({x for x, _ in w})] for a in want_nodes}
    got = {r.id: r.constraint for r in G.constraint(spark.createDataFrame(pairs, EDGES)).collect()}
    assert got == pytest.approx(want) and len(got) == 14
    # Two hubs that share 300 neighbours: 90,000 paths from neighbour to neighbour, none of them between neighbours.
    two = [(h, f"n{i}") for h in ("x", "y") for i in range(300)]
    got = {r.id: r.constraint for r in G.constraint(spark.createDataFrame(two, EDGES)).collect()}
    assert got["x"] == pytest.approx(1 / 300) and got["n7"] == pytest.approx(0.5) and saved["middle"].count() == 0
    assert G.constraint(spark.createDataFrame([], EDGES)).collect() == []


def test_betweenness_of_several_parts_stays_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng, w, out = np.random.default_rng(2), {}, {}
    pairs = [(f"{g}{a}", f"{g}{b}") for g, n in (("p", 9), ("q", 12)) for a, b in rng.integers(0, n, (30, 2)) if a != b]
    for a, b in pairs:
        w[a, b] = w[b, a] = w.get((a, b), 0) + 1
    nodes = sorted({a for a, _ in w})
    far = {(a, b): 0 if a == b else w.get((a, b), np.inf) for a in nodes for b in nodes}
    for c in nodes:
        far |= {(a, b): min(far[a, b], far[a, c] + far[c, b]) for a in nodes for b in nodes}
    ways = {}
    for a in nodes:
        for b in sorted(nodes, key=lambda x: far[a, x]):
            ways[a, b] = 1 if a == b else sum(ways[a, c] for c in nodes if (c, b) in w and far[a, c] + w[c, b] == far[a, b] < np.inf)
    for v in nodes:
        out[v] = sum(ways[a, v] * ways[v, b] / ways[a, b] for a in nodes for b in nodes if len({a, b, v}) == 3 and far[a, v] + far[v, b] == far[a, b] < np.inf) / ((len(nodes) - 1) * (len(nodes) - 2))
    monkeypatch.setattr(DataFrame, "toPandas", None)
    got = {r.id: r.betweenness for r in N.betweenness(spark.createDataFrame(pairs, EDGES), walks=4).collect()}
    assert got == pytest.approx(out) and len({x[0] for x in got}) == 2 and max(out.values()) > 0


def test_ratios_are_those_of_difflib():
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list(letters), n)) for letters in ("ab", "abc ", "0123456789abcdef", "é😀\0z") for n in [0, 1, 7, 15, 16, 17, 31, 33, 64, 65, 90] for _ in range(3)]
    pairs = [(a, b) for a in names for b in names]
    assert E.ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [E.ratio(a, b) for a, b in pairs]


def test_rests_of_names_travel_in_blocks(spark):
    met = E._met_by_rests(spark.range(300).selectExpr("substring(md5(cast(id as string)), 1, 12) as key"), {12: [10]}, 3)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "numbers" in plan and "collect_set" not in plan  # 66 rests a name were rows of their own
    crowd = spark.createDataFrame([(f"abcdefghij{c}{d}",) for c in "xyz" for d in "xyz"], "key string")
    assert E._met_by_rests(crowd, {12: [10]}, 3).distinct().count() == 36


def test_places_too_far_apart_for_what_is_wanted_are_not_compared(spark, monkeypatch):
    rows = [("a1", "crm", 0.0), ("b1", "erp", 0.001), ("b2", "erp", 0.01)]
    df = spark.createDataFrame([(i, s, "port", "same name", lat, 0.0) for i, s, lat in rows], "id string, source_name string, entity_type string, name string, lat double, lon double")
    every = {(r.id_a, r.id_b): r.confidence for r in E.spatial_pairs(df).collect()}
    assert every == {("a1", "b1"): pytest.approx(0.9889), ("a1", "b2"): pytest.approx(0.889)}
    assert {(r.id_a, r.id_b) for r in E.spatial_pairs(df, wanted=0.95).collect()} == {("a1", "b1")}


def test_every_pair_of_like_names_is_given(spark):
    """Entities of one name are not cut to one of them, in whatever blocks, and what a group raises to the threshold is in."""
    rng = np.random.default_rng(9)
    words = ["blue ocean ltd", "blue ocaen ltd", "blue ocean l", "red sea company", "red sea compny"]
    kinds = ["company", "organization", "port"]
    rows = [(str(i), "abc"[rng.integers(0, 3)], kinds[rng.integers(0, 3)], words[rng.integers(0, 5)]) for i in range(120)]
    rows += [("x", "a", "company", "abcdefghijkl"), ("y", "b", "company", "abcdefghijxyz"), ("z", "c", "company", "abcdefghijxyz")]
    e = spark.createDataFrame(rows, "id string, source_name string, entity_type string, name string")
    for groups in ([], [frozenset("ab")]):
        want = {}
        for a, b in combinations(sorted(rows), 2):
            r = E.ratio(a[3], b[3])
            r = min(1.0, r * 1.05) if groups and {a[1], b[1]} <= set("ab") and r > 0.7 else r
            if a[1] != b[1] and E.compatible(a[2], b[2]) and r >= (0.82 if a[2] == b[2] else 0.87):
                want[a[0], b[0], a[1], b[1]] = r
        got = E.name_pairs(e, 0.82, groups=groups, block=5).collect()
        assert {tuple(r[:4]): r.confidence for r in got} == pytest.approx(want) and len(got) == len(want) > 500
        assert (("x", "y", "a", "b") in want) == bool(groups)


def test_parts_are_settled_in_few_rows(spark, monkeypatch):
    """However tasks come by the edges, parts are those of plain reckoning, and no edge goes into the rounds of joins."""
    rng = np.random.default_rng(11)
    edges = sorted({tuple(sorted(f"n{x}" for x in rng.choice(90, 2, replace=False))) for _ in range(40)} | {(f"p{i:02}", f"p{i + 1:02}") for i in range(60)})
    df = spark.createDataFrame(edges, "a string, b string").repartition(5)
    of = {}
    for a, b in edges:
        one = of.get(a, {a}) | of.get(b, {b})
        of |= {x: one for x in one}
    seen = []
    whole = C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda e, s: seen.append(e.count()) or whole(e, s))
    for rows, most in ((7, 4_000_000), (4, 10)):
        got = C.settled_parts(df, Scratch(spark, "test"), rows, most).collect()
        assert {r.id: r.n for r in got} == {x: sum(x in e for e in edges) for x in of}
        parts = {}
        for r in got:
            parts.setdefault(r.root, set()).add(r.id)
        assert {frozenset(p) for p in parts.values()} == {frozenset(p) for p in of.values()} and len(parts) > 5
    assert seen[0] <= len(edges)
    assert C.settled_parts(df.where("false"), Scratch(spark, "test")).collect() == []


def test_dependencies_are_the_same_in_any_steps():
    """Edges come in blocks and are looked at few at a time; a node's own are kept whole."""
    rng = np.random.default_rng(3)
    pairs = sorted({tuple(sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(150)})
    a, b, w = np.array([p[0] for p in pairs], np.int32), np.array([p[1] for p in pairs], np.int32), rng.integers(1, 4, len(pairs)).astype("u1")
    start, to, weight = N._lists([(a[i : i + 40], b[i : i + 40], w[i : i + 40].astype("u2" if i else "u1")) for i in range(0, len(a), 40)], 40)
    near = {i: sorted(zip(to[start[i] : start[i + 1]].tolist(), weight[start[i] : start[i + 1]].tolist())) for i in range(40)}
    assert near == {i: sorted([(int(y), int(z)) for x, y, z in zip(a, b, w) if x == i] + [(int(x), int(z)) for x, y, z in zip(a, b, w) if y == i]) for i in range(40)}
    for s in (0, 7):
        one = N._dependencies(s, 40, start, to, weight)
        assert one.sum() > 0 and np.allclose(one, N._dependencies(s, 40, start, to, weight, most=5))
    assert N.MOST_EDGES >= 30_000_000


def test_a_view_of_all_needs_no_communities(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "d", "x"), ("d", "a", "y")], "source_id string, dest_id string, relationship_type string")
    rank = spark.createDataFrame([("a", 0.4), ("b", 0.3), ("c", 0.2), ("d", 0.1)], "id string, rank double")
    of = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "node string, community int")
    about = spark.createDataFrame([("a", "k"), ("b", "k")], "id string, kind string")
    view = lambda *x, **y: sorted(map(tuple, N.graph_view(edges, rank, *x, about, **y).collect()))
    assert view(None, n=3) == view(of, n=3) == [("a", "b", "x"), ("b", "c", "y")]
    assert view(of, community=1) == [("c", "d", "x")] and view(None, kind="k") == [("a", "b", "x")]
