"""Graphs, paths and walks on small literal graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.operators import diffusion, graph, paths, tiles


def edges(spark, text):
    return spark.createDataFrame([tuple(p.split("-")) for p in text.split()] if text else [], "src string, dst string")


def nodes(spark, text):
    return spark.createDataFrame([(x,) for x in text.split()], "node string")


def values(df, key="node"):
    rows = df.collect()
    other = next(c for c in df.columns if c != key)
    return {r[key]: r[other] for r in rows}


PATH = "A-B B-C C-D"


def test_canonical_edges(spark):
    e = spark.createDataFrame([("b", "a", 3), ("a", "b", 5), ("c", "c", 9), ("a", "c", 1)], "src string, dst string, score int")
    assert sorted(map(tuple, graph.canonical(e, 2).collect())) == [("a", "b", 5)]
    assert sorted(map(tuple, graph.canonical(e, 2, drop_loops=False).collect())) == [("a", "b", 5), ("c", "c", 9)]
    m = spark.createDataFrame([("a", "X"), ("b", "Y"), ("c", None)], "id string, name string")
    assert sorted(map(tuple, graph.extract(e, m, 1).collect())) == [("X", "Y", 5)]


def test_degree_and_counts(spark):
    e = edges(spark, "A-B A-C A-A B-A")
    assert values(graph.degree(e, nodes(spark, "A B C Z"))) == {"A": 4, "B": 1, "C": 1, "Z": 0}
    assert tuple(graph.counts(e).first()) == (3, 3)


def test_components(spark):
    e = edges(spark, "A-B B-C X-Y Z-Z")
    assert values(graph.components(e, nodes(spark, "A B C X Y Z Q"))) == {"A": "A", "B": "A", "C": "A", "X": "X", "Y": "X", "Z": "Z", "Q": "Q"}
    assert graph.components(edges(spark, "")).count() == 0


def test_components_of_a_random_graph(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(80)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert values(graph.components(spark.createDataFrame(pairs, "src string, dst string"))) == {x: find(x) for x in root}


def test_filter_to(spark):
    run = lambda e, n, keep: sorted(r[0] for r in graph.filter_to(edges(spark, e), nodes(spark, n), nodes(spark, keep)).collect())
    assert run("A-B B-C C-D D-E X-Y", "A B C D E X Y", "A B C X Y") == ["A", "B", "C"]
    assert run(PATH, "A B C D", "A B D") == ["A", "B"]
    assert run("A-B B-C", "A B C", "A") == ["A"]
    assert run("A-B X-Y", "A B X Y", "A B X Y") == ["A", "B"]
    assert run("A-B", "A B", "Q") == []


def test_validate(spark):
    assert tuple(graph.validate(edges(spark, "A-B X-Y")).first()) == (4, 2, False)
    assert graph.validate(edges(spark, PATH)).first()["connected"]
    with pytest.raises(ValueError):
        graph.validate(edges(spark, ""))


@pytest.mark.parametrize(
    ("e", "targets", "disease", "dc"),
    [(PATH, "A", "D", 3.0), (PATH, "A", "C D", 2.0), (PATH, "A B", "D", 2.5), (PATH + " D-E", "A B", "D E", 2.5), ("A-B C-D", "A", "C", None), ("A-B", "X", "A", None), (PATH, "A A B", "D", 8 / 3)],
)
def test_proximity(spark, e, targets, disease, dc):
    out = paths.proximity(paths.distances(edges(spark, e), nodes(spark, disease)), nodes(spark, targets)).first()
    assert out["dc"] == (None if dc is None else pytest.approx(dc))


WALKS = [
    (PATH, None, "A", 0.15, {"A": 0.302224, "B": 0.358175, "C": 0.238316, "D": 0.101284}),
    (PATH, None, "A D", 0.15, {"A": 0.201754, "B": 0.298246, "C": 0.298246, "D": 0.201754}),
    ("A-B B-C", None, "A", 0.15, {"A": 0.345270, "B": 0.459459, "C": 0.195270}),
    ("A-B B-C", None, "A A", 0.15, {"A": 0.172635, "B": 0.229730, "C": 0.097635}),
    ("", "A", "A", 0.15, {"A": 0.15}),
    ("A-B B-C", None, "Z", 0.15, {"A": 0, "B": 0, "C": 0}),
    ("A-B C-D B-C", None, "A D", 0.99, {"A": 0.495025, "B": 0.004975, "C": 0.004975, "D": 0.495025}),
    ("A-B B-C X-Y", None, "A", 0.15, {"X": 0, "Y": 0}),
    ("0-1 0-2 0-3 0-4 0-5", None, "0", 0.15, {"0": 0.540541, "3": 0.091892}),
    ("0-1 1-2 2-3 3-4 4-5 5-0", None, "0 3", 0.15, {"0": 0.201754, "1": 0.149123, "3": 0.201754}),
]


def walked(spark, e, n, seeds, alpha, want):
    got = values(diffusion.rwr(edges(spark, e), nodes(spark, seeds), alpha, nodes=n and nodes(spark, n)))
    assert {k: got[k] for k in want} == pytest.approx(want, abs=6e-6)


@pytest.mark.parametrize(("e", "n", "seeds", "alpha", "want"), [WALKS[1], WALKS[4], WALKS[5], WALKS[6]])
def test_walk(spark, e, n, seeds, alpha, want):
    walked(spark, e, n, seeds, alpha, want)


def test_many_walks_in_one_loop(spark):
    """The walks above side by side: a graph of all their graphs, a set for each; columns stop at their own steps."""
    chosen = [k for k, w in enumerate(WALKS) if w[3] == 0.15 and w[1] is None]
    e = edges(spark, " ".join(f"{k}.{p.replace('-', f'-{k}.')}" for k in chosen for p in WALKS[k][0].split()))
    seeds = spark.createDataFrame([(k, f"{k}.{x}") for k in chosen for x in WALKS[k][2].split()] + [(None, "0.A")], "set int, node string")
    for columns in (4,):
        got = {(r["set"], r["node"]): r["p"] for r in diffusion.rwr_many(e, seeds, "set", columns=columns).collect()}
        assert {k for k, _ in got} == set(chosen)
        for k in chosen:
            assert {x: got[k, f"{k}.{x}"] for x in WALKS[k][4]} == pytest.approx(WALKS[k][4], abs=6e-6)
    assert diffusion.rwr_many(e, seeds.limit(0), "set").count() == 0


def dense(pairs, names):
    """The transition matrix as numpy, destination by source."""
    w = np.zeros((len(names), len(names)))
    for a, b in pairs:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = 1
    return w / np.maximum(w.sum(axis=0), 1)


def test_tiles_of_any_size_walk_alike(spark):
    """Blocks of 7 nodes and parts of 5 entries, hubs split: every column stops where a check after each step stops it."""
    rng = random.Random(12)
    names = [f"n{k:02d}" for k in range(40)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(60)} | {("n00", x) for x in names[1:30]}
    w = dense(pairs, names)
    entries = spark.createDataFrame([(names[i], names[j], float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "to string, from string, w double")
    b = np.zeros((40, 3))
    b[0, 0], b[[3, 9], 1], b[39, 2] = 1.0, 0.5, 1.0
    start = spark.createDataFrame([(names[i], int(c), float(b[i, c])) for i, c in zip(*np.nonzero(b), strict=True)], "node string, col int, b double")
    numbers = tiles.numbered(spark.createDataFrame([(x,) for x in names], "node string"))
    want, p, on = np.zeros((40, 3)), b.copy(), np.ones(3, bool)
    for _ in range(100):
        new = 0.5 * w @ p + 0.5 * b
        stop = (np.abs(new - p).sum(axis=0) < 1e-3) & on
        want[:, stop] = new[:, stop]
        on &= ~stop
        p = new
    t = tiles.tiled(entries, numbers, start, 3, size=7, part_entries=5)
    assert t.tiles.agg(F.max("fan")).first()[0] > 5
    for chunk in (4, 15):
        got = np.zeros((40, 3))
        for r in tiles.walk(t, 3, 0.5, None, 1e-3, 100, chunk).collect():
            got[r["place"], r["col"]] = r["p"]
        assert got == pytest.approx(want, abs=1e-13)
    once = {(r["place"], r["col"]): r["p"] for r in tiles.walk(t, 3, 0.5, 1, 0, 0).collect()}
    assert once[0, 0] == pytest.approx((0.5 * w @ b + 0.5 * b)[0, 0])
    t.release()


def test_pair_distances(spark):
    rng = random.Random(3)
    names = [f"n{k}" for k in range(60)]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(70)]
    near = {x: set() for x in names}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    want = {}
    for s in names[:50]:
        dist, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in near[x] if y not in dist and not dist.update({y: dist[x] + 1})]
        want |= {(t, s): d for t, d in dist.items() if t in names[30:] and near[s] and near[t]}
    e = spark.createDataFrame(pairs, "src string, dst string")
    sources, targets = (nodes(spark, " ".join([*x, "elsewhere"])) for x in (names[:50], names[30:]))
    got = {(r["target"], r["source"]): r["dist"] for r in paths.pair_distances(e, sources, targets, at_once=30).collect()}
    assert got == want
    assert paths.pair_distances(edges(spark, ""), sources, targets).count() == 0


def test_walk_on_nothing(spark):
    assert diffusion.rwr(edges(spark, ""), nodes(spark, "A")).count() == 0


def test_weighted_walk(spark):
    e, x = edges(spark, "C-L C-H"), spark.createDataFrame([("C", 10.0), ("L", 1.0), ("H", 1000.0)], "node string, x double")
    w = diffusion.normalise(graph.nodes_of(e), x)
    assert values(w) == pytest.approx({"C": 0.274269, "L": 0.01, "H": 1.0}, abs=1e-6)
    got = values(diffusion.rwr(e, nodes(spark, "C"), steps=60, weight=w))
    assert got == pytest.approx({"C": 0.540541, "L": 0.004549, "H": 0.454910}, abs=6e-5)


def test_normalise_edges(spark):
    n = nodes(spark, "A B")
    x = spark.createDataFrame([("A", 3.0), ("B", 7.0)], "node string, x double")
    assert values(diffusion.normalise(n, x)) == {"A": 0.01, "B": 1.0}
    assert values(diffusion.normalise(n, x.limit(0))) == {"A": 1.0, "B": 1.0}
    with pytest.raises(ValueError):
        diffusion.normalise(n, x, "rank")


def test_adjoint_equals_forward(spark):
    h = diffusion.adjoint(edges(spark, PATH), nodes(spark, "D"), steps=20)
    assert values(h) == pytest.approx({"A": 0.095348, "B": 0.125094, "C": 0.173151, "D": 0.308161}, abs=1e-6)
    p = diffusion.rwr(edges(spark, PATH), nodes(spark, "A"), steps=20)
    assert diffusion.influence_of(p, nodes(spark, "D")).first()[0] == pytest.approx(values(h)["A"], abs=1e-12)
    sets = spark.createDataFrame([("x", "A"), ("x", "B"), ("x", "Q")], "compound string, node string")
    assert tuple(diffusion.influence(h, sets, ["compound"]).first()) == ("x", 2, pytest.approx((0.095348 + 0.125094) / 2, abs=1e-6))


def test_direct_neighbours(spark):
    got = graph.direct_neighbours(edges(spark, "A-B A-C A-A"), nodes(spark, "A Q"), nodes(spark, "B")).collect()
    assert [tuple(r) for r in got] == [("A", 2, 1, 0.5)]


def test_walk_sums_to_one_on_a_connected_graph(spark):
    rng = random.Random(4)
    e = edges(spark, " ".join(f"n{i}-n{rng.randrange(i)}" for i in range(1, 60)))
    assert diffusion.rwr(e, nodes(spark, "n3 n7")).agg(F.sum("p")).first()[0] == pytest.approx(1, abs=1e-9)


def test_edge_weights(spark):
    e = spark.createDataFrame([("A", "B", 3.0), ("A", "C", 1.0), ("C", "A", 0.5), ("C", "C", 4.0)], "src string, dst string, weight double")
    w = {(r["src"], r["dst"]): r["w"] for r in diffusion.transition(e).collect()}
    assert w == pytest.approx({("A", "B"): 0.75, ("A", "C"): 0.25, ("B", "A"): 1.0, ("C", "A"): 0.2, ("C", "C"): 0.8})
    x = spark.createDataFrame([("A", 1.0), ("B", 0.1), ("C", 0.9)], "node string, e double")
    w = {(r["src"], r["dst"]): r["w"] for r in diffusion.transition(e, x).collect()}
    assert w[("A", "B")] == pytest.approx(0.3 / 1.2) and w[("C", "C")] == pytest.approx(3.6 / 4.6)
    plain, weighted = (values(diffusion.rwr(d, nodes(spark, "A"), steps=1)) for d in (e.drop("weight"), e))
    assert plain["B"] == pytest.approx(0.85 * 0.5) and weighted["B"] == pytest.approx(0.85 * 0.75)


def test_network(spark):
    links = spark.createDataFrame([("a", "b", 800), ("b", "c", 800), ("c", "d", 100), ("x", "y", 900), ("b", "q", 900)], "src string, dst string, score int")
    names = spark.createDataFrame([(k, k.upper()) for k in "abcdxy"], "id string, name string")
    assert sorted(map(tuple, graph.network(links, names, 700).collect())) == [("A", "B", 800), ("B", "C", 800)]
    assert graph.network(links, names, 1000).count() == 0
