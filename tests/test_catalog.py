"""Registered queries on small tables, against plain Python."""

import random

import numpy as np
import pytest

from graphsieve.operators import iterate
from graphsieve.plans import catalog, files
from graphsieve.sources import readers


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, edges, neighbours): suppliers s1 to s8 with parts p1 to p60, each pair of 0, 2 or 3 order lines; the first suppliers are hubs."""
    rng, out = random.Random(3), str(tmp_path_factory.mktemp("star"))
    edges = {(s, p) for s in range(1, 9) for p in range(1, 61) if rng.random() < 0.7 / s} | {(1 + p % 8, p) for p in range(1, 61)}
    lines = [x for e in sorted(edges) for x in [e] * rng.choice((2, 3))]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{out}/{name}.parquet")
    write(lines, "l_suppkey long, l_partkey long", "lineitem")
    write([(p, f"Brand#{1 + p % 20}", p % 13, 900.0 + p) for p in range(1, 61)], "p_partkey long, p_brand string, p_size int, p_retailprice double", "part")
    write([(s, 100.0 * s) for s in range(1, 9)], "s_suppkey long, s_acctbal double", "supplier")
    write([(0,)], "r_regionkey int", "region")
    near: dict[str, set] = {}
    for s, p in edges:
        near.setdefault(f"s{s}", set()).add(f"p{p}")
        near.setdefault(f"p{p}", set()).add(f"s{s}")
    return out, near


def disease():
    return {f"p{p}" for p in range(1, 61) if p % 13 <= 5}


def test_direct_neighbors_of_all_nodes(spark, tables):
    out, near = tables
    got = {r["node"]: (r["n_neighbours"], r["n_disease"]) for r in catalog.QUERIES["direct_neighbors"](spark, out).collect()}
    assert got == {n: (len(x), len(x & disease())) for n, x in near.items()}


def test_links_are_grouped_and_written_in_parts(spark, tables):
    """Tasks follow the rows, not the session's number of partitions, and no one task writes the links."""
    out, near = tables
    assert iterate.dealt(spark.range(100), 100, "id", task_rows=10).rdd.getNumPartitions() == 10
    assert iterate.dealt(spark.range(100), 0, "id").rdd.getNumPartitions() == 2
    path = files._links(spark, out, 100)
    written = spark.read.text(path)
    assert len(written.inputFiles()) == 2 and written.filter("value = 'protein1 protein2 combined_score'").count() == 2
    got = [(r["src"], r["dst"]) for r in readers.edges(spark, path, 200).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, p) for s in near if s[0] == "s" for p in near[s]}
    assert {(r["src"], r["dst"]) for r in catalog.QUERIES["cli_extract"](spark, out).collect()} == {(p.upper(), s.upper()) for s, p in got}
    report = {r["check"]: (r["actual"], r["ok"]) for r in catalog.QUERIES["integrity_checks"](spark, out).filter("check <> 'regions'").collect()}
    assert report["loose edges"] == (str(len(got)), True) and all(ok for _, ok in report.values())


def distance(near, sources):
    dist, level = {}, set(sources) & set(near)
    while level:
        dist |= dict.fromkeys(level, max(dist.values(), default=-1) + 1)
        level = {m for n in level for m in near[n]} - set(dist)
    return dist


def greedy(near, wanted, value, band, barred, times=4000):
    """Mean and deviation of the mean value of degree-matched sets, drawn one target after the other by the random module."""
    rng, means, degree = random.Random(5), [], {n: len(x) for n, x in near.items()}
    for _ in range(times):
        used: list[str] = []
        for t in sorted(wanted & set(near)):
            low, high = band(degree[t])
            names = [n for n in degree if low <= degree[n] <= high and n not in barred and n not in used]
            used.append(rng.choice(names or [n for n in degree if n not in barred and n not in used]))
        means.append(np.mean([value[n] for n in used if n in value]))
    return np.mean(means), np.std(means)


def targets():
    """Parts of brand 1, and of the brands 2 to 7."""
    return {"A": {f"p{p}" for p in range(1, 61) if p % 20 == 0}, "B": {f"p{p}" for p in range(1, 61) if 1 <= p % 20 <= 6}}


def agrees(row, mean, std):
    """The null's mean within four standard errors of 1,000 draws, the deviation near, and p a share of 1,001."""
    assert row["null_mean"] == pytest.approx(mean, abs=4 * std / 1000**0.5 + 1e-6) and row["null_std"] == pytest.approx(std, rel=0.12)
    assert row["p_value"] * 1001 == pytest.approx(round(row["p_value"] * 1001), abs=1e-3)


@pytest.mark.parametrize("name", ["permutation_test", "ewi_permutation_test"])
def test_permutations_match_degrees(spark, tables, name):
    out, near = tables
    h = {r["node"]: r["h"] for r in catalog._h(spark, out, name.startswith("ewi")).collect()}
    for r in catalog.QUERIES[name](spark, out).collect():
        wanted = targets()[r["compound"]]
        agrees(r, *greedy(near, wanted, h, lambda k: (k - max(1, k // 4), k + max(1, k // 4)), wanted))


def test_path_permutations_match_degrees(spark, tables):
    out, _ = tables
    near: dict[str, set] = {}
    for a, b in catalog._edges(spark, out, 3).select("src", "dst").collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist = distance(near, disease())
    for r in catalog.QUERIES["path_permutation_test"](spark, out).collect():
        wanted = targets()[r["compound"]]
        agrees(r, *greedy(near, wanted, dist, lambda k: (int(k * 0.75), int(k * 1.25) + 1), set()))


def test_path_permutations_of_unreached_sets(spark, tmp_path):
    """Set A reaches no disease node: it has no row, as in the SQL."""
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([x for s, p in [(1, 1), (2, 2), (2, 3), (3, 4), (3, 5)] for x in [(s, p)] * 3], "l_suppkey long, l_partkey long", "lineitem")
    write([(1, "Brand#1", 9, 1.0), (2, "Brand#2", 9, 1.0), (3, "Brand#9", 1, 1.0), (4, "Brand#2", 9, 1.0), (5, "Brand#9", 2, 1.0)], "p_partkey long, p_brand string, p_size int, p_retailprice double", "part")
    write([(1, 1.0)], "s_suppkey long, s_acctbal double", "supplier")
    got = catalog.QUERIES["path_permutation_test"](spark, str(tmp_path)).collect()
    assert [(r["compound"], r["observed"]) for r in got] == [("B", 2.0)]


def solved(spark, out, near, bias, weighted, forward):
    """The fixpoint of a walk by a dense solver."""
    names = sorted(near)
    at = {n: k for k, n in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for r in catalog.QUERIES["ewi_transition" if weighted else "transition_matrix"](spark, out).collect():
        w[at[r["dst"]], at[r["src"]]] = r["w"]
    b = np.array([bias.get(n, 0.0) for n in names])
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - 0.85 * (w if forward else w.T), 0.15 * b)))


@pytest.mark.parametrize("weighted", [False, True])
def test_walks_converge(spark, tables, weighted):
    out, near = tables
    seeds = targets()["A"] & set(near)
    p = solved(spark, out, near, dict.fromkeys(seeds, 1 / len(seeds)), weighted, True)
    got = {r["node"]: r["p"] for r in catalog.QUERIES["ewi_scores" if weighted else "rwr_scores"](spark, out).collect()}
    assert got == pytest.approx(p, abs=6e-6)
    h = solved(spark, out, near, dict.fromkeys(disease(), 1.0), weighted, False)
    mean = {c: np.mean([h[n] for n in x if n in near]) for c, x in targets().items()}
    column = "weighted" if weighted else "standard"
    assert {r["compound"]: r[column] for r in catalog.QUERIES["standard_vs_weighted"](spark, out).collect()} == pytest.approx(mean, abs=2e-6)
