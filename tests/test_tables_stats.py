"""Curation, statistics, sampling, similarity, reports, checks, runner."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphsieve.functions import columns as C
from graphsieve.operators.iterate import placed
from graphsieve.operators import checks, graph, reshape, sampling, similarity, stats, tables
from graphsieve.plans import runner


def one(spark, expr, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in cols.items())).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("Foo Hydrochloride", "foo"), (" Bar sodium ", "bar"), ("x dihydrate sulfate", "x"), ("x sulfate dihydrate", "x sulfate"), ("hcl", "hcl"), ("y sulfate sodium", "y sulfate")])
def test_strip_salts(spark, name, want):
    # suffixes are tried once, in list order: " sulfate" is tried before " sodium" has gone
    assert one(spark, C.strip_salts(F.col("n")), n=name) == want


@pytest.mark.parametrize(("acc", "gene", "foreign", "strict"), [("Q91A", "AKT1", True, False), ("P12345", "insr", True, True), ("P12345", "GyrA", True, True), ("O75469", "NR1I2", False, True), ("Q9Y210", None, False, False), ("P1234", "A", False, False)])
def test_accessions(spark, acc, gene, foreign, strict):
    assert one(spark, C.is_non_human(F.col("a"), F.col("g")), a=acc, g=gene) is foreign
    assert one(spark, C.is_strict_accession(F.col("a")), a=acc) is strict


def test_curation(spark):
    raw = spark.createDataFrame([("A", "P1", "s1", 1), ("A", "P1", "s0", 2), ("A", "Q91x", "s", 3), ("B", "P2", "s", 4), ("B", "P3", "s", 5)], "compound string, protein_id string, source string, ord int")
    m = spark.createDataFrame([("P1", "MDR1"), ("Q91x", "AKT1"), ("P3", "insr")], "protein_id string, gene_name string")
    assert [tuple(r) for r in tables.curate(raw, m, [F.col("ord")]).collect()] == [("A", "P1", "s1", "ABCB1")]
    assert sorted(map(tuple, tables.curation_audit(raw, m).collect())) == [("A", 3, 0, 1, 2, 1), ("B", 2, 1, 1, 0, 0)]
    trace = {(r["compound"], r["idx"]): (r["reason"], r["species"]) for r in tables.exclusion_trace(raw, m, "ord").collect()}
    assert trace[("A", 3)] == ("Non-human (AKT1)", "Mouse") and trace[("B", 1)] == ("No mapping", None) and trace[("B", 2)][1] == "Non-human"


def test_resolvers(spark):
    e = spark.createDataFrame([("a", "b", 1)], "gene1 string, gene2 string, score int")
    assert C.resolve_edges(e).columns == ["src", "dst", "score"]
    assert C.resolve_edges(e.toDF("x", "y", "z")).columns == ["src", "dst", "z"]
    g = spark.createDataFrame([("a", "b"), ("a", None)], "gene_name string, q string")
    assert [r[0] for r in C.resolve_genes(g).collect()] == ["a"]


def test_row_median(spark):
    m = lambda *v: one(spark, C.row_median(*[F.lit(x) for x in v]), z="z")
    assert m("3", "1", "x") == 2.0 and m("5", "1", "2") == 2.0 and m("x", None) is None


def frame(spark, values, schema="value double"):
    return spark.createDataFrame([(float(v),) for v in values], schema)


def test_z_and_p(spark):
    s = frame(spark, [1, 2, 3, 4, 5]).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    assert s.select(stats.z_score(F.lit(1.0), F.col("m"), F.col("s"))).first()[0] == pytest.approx(-math.sqrt(2))
    assert s.select(stats.z_score(F.lit(1.0), F.col("m"), F.lit(0.0))).first()[0] == 0
    p = lambda o, tail: frame(spark, [1, 2, 3, 4, 5]).agg(stats.empirical_p(F.lit(float(o)), F.col("value"), tail)).first()[0]
    assert [p(10, "one_greater"), p(0, "one_greater"), p(3, "one_greater")] == pytest.approx([1 / 6, 1, 4 / 6])
    assert p(3, "one_less") == pytest.approx(4 / 6) and p(3, "two") == pytest.approx(8 / 6)
    assert frame(spark, []).agg(stats.empirical_p(F.lit(1.0), F.col("value"))).first()[0] is None
    with pytest.raises(ValueError):
        stats.empirical_p(F.lit(1.0), F.col("value"), "three")
    z = frame(spark, [2])
    assert z.select(stats.gaussian_p(F.col("value"))).first()[0] == pytest.approx(0.0455, abs=1e-4)
    assert z.select(stats.gaussian_p(F.col("value"), "one")).first()[0] == pytest.approx(0.0228, abs=1e-4)


def test_false_discovery(spark):
    got = stats.bh(spark.createDataFrame([("a", 1e-16), ("b", 1.601017e-08), ("c", None)], "k string, p_value double").filter("k <> 'c'"), [])
    assert {r["k"]: r["p_fdr"] for r in got.collect()} == pytest.approx({"a": 2e-16, "b": 1.601017e-08})
    got = stats.bh(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p_value double"), [])
    assert {r["k"]: r["p_fdr"] for r in got.collect()} == pytest.approx({"a": 0.04, "b": 0.16 / 3, "c": 0.16 / 3, "d": 1.0})


def test_null_summary(spark):
    null = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 6.0)], "c string, value double")
    r = stats.null_summary(null, spark.createDataFrame([("a", 10.0)], "c string, observed double"), ["c"]).first()
    assert r["z_score"] == pytest.approx(6 / math.sqrt(8 / 3)) and r["p_value"] == 0.25


def test_bootstrap_summary(spark):
    r = stats.bootstrap_summary(frame(spark, range(101)), F.lit(99.0), []).first()
    assert (r["mean"], r["ci_lower"], r["ci_upper"], r["exceeds_ci"], r["n_bootstrap"]) == (50, 2.5, 97.5, True, 101)


def hubs(spark):
    rows = [(h, f"{h}{k}") for h, n in (("T", 10), ("C1", 8), ("C2", 12), ("C3", 13)) for k in range(n)]
    return spark.createDataFrame(rows, "src string, dst string")


def test_degree_matched(spark):
    deg, t = graph.degree(hubs(spark)), spark.createDataFrame([("T",)], "node string")
    assert {r["node"] for r in sampling.bands(deg, t).collect()} == {"C1", "C2"}
    drawn = sampling.degree_matched(deg, t, 40).collect()
    assert {r["node"] for r in drawn} == {"C1", "C2"} and len(drawn) == 40
    assert "T" in {r["node"] for r in sampling.degree_matched(deg, t, 60, mode="M2").collect()}
    only = spark.createDataFrame([("C2",), ("T1",)], "node string")
    assert {r["node"] for r in sampling.degree_matched(deg, t, 20, mode="M3", expressed=only).collect()} == {"C2"}
    two = spark.createDataFrame([("T",), ("C3",)], "node string")
    by = {}
    for r in sampling.degree_matched(deg, two, 10).collect():
        by.setdefault(r["perm_id"], []).append(r["node"])
    assert all(len(set(v)) == len(v) == 2 and not {"T", "C3"} & set(v) for v in by.values())
    assert sampling.degree_matched(deg, two, 3, n_sample=1).count() == 3
    with pytest.raises(ValueError):
        sampling.degree_matched(deg, t, 1, mode="M9")


def one_by_one(degrees, wanted, permutations, seed, mode, keep=None):
    """The draws of one target after another, from plain lists."""
    band = {"M1": lambda d: (d - max(1, int(d * 0.25)), d + max(1, int(d * 0.25))), "M2": lambda d: (int(d * 0.75), int(d * 1.25) + 1), "M3": lambda d: (int(d * 0.75), int(d * 1.25))}[mode]
    pool = sorted((d, n) for n, d in degrees.items() if (mode != "M1" or n not in wanted) and (keep is None or n in keep))
    out = set()
    for perm in range(permutations):
        used = set()
        for k, target in enumerate(sorted(t for t in wanted if t in degrees)):
            low, high = band(degrees[target])
            for stage, span in enumerate(([i for i, (d, _) in enumerate(pool) if low <= d <= high], list(range(len(pool))))):
                roll = lambda m, n: int(hashlib.md5(f"{seed}:{perm}:{k}:{n}".encode()).hexdigest()[:16], 16) % m  # noqa: E731, B023
                tried = [span[roll(len(span), n)] for n in range(24)] if span else []
                free = [x for x in span if x not in used]
                if mode == "M2" and stage == 1:
                    got = tried[:1]
                else:
                    got = [x for x in tried if x not in used][:1] or ([free[roll(len(free), 24)]] if free else [])
                if got:
                    used.add(got[0])
                    out.add((perm, k, pool[got[0]][1]))
                    break
    return out


@pytest.mark.parametrize("mode", ["M1", "M2", "M3"])
def test_draws_of_crowded_bands(spark, mode):
    # more targets than nodes of their degree: tries run out, free places are numbered, then bands are left
    degrees = {f"t{k}": 10 + k % 2 for k in range(14)} | {f"h{k}": 90 for k in range(3)} | {f"n{k}": 9 + k % 3 for k in range(9)} | {f"f{k}": 40 for k in range(6)}
    wanted = {f"t{k}" for k in range(14)} | {"h0", "none"}
    keep = {n for n in degrees if n[0] in "nf" or n < "t3"} if mode == "M3" else None
    frame = spark.createDataFrame(list(degrees.items()), "node string, degree long")
    named = lambda x: spark.createDataFrame([(n,) for n in sorted(x)], "node string")
    got = sampling.degree_matched(frame, named(wanted), 30, 7, mode, expressed=named(keep) if keep else None).collect()
    assert {tuple(r) for r in got} == one_by_one(degrees, wanted, 30, 7, mode, keep) and len(got) == len({tuple(r) for r in got})


def test_draws_from_nothing(spark):
    deg, none = graph.degree(hubs(spark)), spark.createDataFrame([], "node string")
    assert sampling.degree_matched(deg, none, 3).count() == 0
    assert sampling.degree_matched(deg, graph.nodes_of(hubs(spark)), 3).count() == 0
    assert sampling.degree_matched(deg, spark.createDataFrame([("T",)], "node string"), 3, mode="M3", expressed=none).count() == 0
    with pytest.raises(ValueError):
        sampling.degree_matched(deg, none, 0)


def test_bootstrap_draws(spark):
    pool = spark.createDataFrame([(f"n{k}",) for k in range(30)], "node string")
    by = {}
    for r in sampling.bootstrap(pool, 7, 5, 42).collect():
        by.setdefault(r["iter"], set()).add(r["node"])
    assert sorted(by) == list(range(5)) and all(len(v) == 7 for v in by.values()) and len(set(map(frozenset, by.values()))) == 5
    with pytest.raises(ValueError):
        sampling.bootstrap(pool, 31, 1, 42)


def test_tanimoto(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([], []), ([1], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(similarity.tanimoto(F.col("a"), F.col("b"))).collect()] == [0.4, 0.0, 0.0]
    df = spark.createDataFrame([([7, 0], [14, 1])], "a array<long>, b array<long>")
    assert df.select(similarity.tanimoto_words(F.col("a"), F.col("b"))).first()[0] == 2 / 5
    refs = spark.createDataFrame([("r1", "positive", [1, 2]), ("r2", "negative", [9])], "reference string, category string, bits array<int>")
    s = similarity.summary(similarity.pairs(spark.createDataFrame([("c", [1, 2, 3])], "compound string, bits array<int>"), refs)).first()
    assert (s["n_positive"], s["max_positive"], s["max_negative"], s["analog"]) == (1, pytest.approx(2 / 3), 0.0, True)
    cache = spark.createDataFrame([("r1", ""), ("r2", "CC")], "name string, smiles string")
    assert [r["reference"] for r in similarity.resolve(refs, cache).collect()] == ["r2"]


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.8, 1.0])
def test_analogs_against_all_pairs(spark, threshold):
    rng = random.Random(5)
    sets = [sorted({min(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(0, 25))}) for _ in range(150)]
    sets += sets[:20] + [[0]] * 30 + [None, []]
    refs = spark.createDataFrame([(k, "positive" if k % 2 else "negative", x) for k, x in enumerate(sets)], "reference int, category string, bits array<int>")
    tests = refs.filter("reference % 3 = 0").select(F.col("reference").alias("compound"), "bits")
    found = similarity.analogs(tests, refs, threshold)
    brute = set()
    for x in range(0, len(sets), 3):
        for y in range(len(sets)):
            a, b = set(sets[x] or ()), set(sets[y] or ())
            if a | b and len(a & b) / len(a | b) >= threshold:
                brute.add((x, y, len(a & b) / len(a | b)))
    got = found.collect()
    assert {(r["compound"], r["reference"], r["similarity"]) for r in got} == brute and len(got) == len(brute)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert similarity.analogs(tests.limit(0), refs, threshold).count() == 0
    with pytest.raises(ValueError):
        similarity.analogs(tests, refs, 0.0)


def test_analogs_by_tiles(spark):
    """Blocks of 8 give the pairs of one tile; negative and large bits too; a pair is no row of a shuffle or join before it is found."""
    rng = random.Random(6)
    sets = [sorted({rng.choice((-7, 1 << 30, rng.randrange(40))) for _ in range(rng.randrange(1, 30))}) for _ in range(90)] + [list(range(40))] * 10
    refs = spark.createDataFrame([(k, None if k % 5 else "positive", x) for k, x in enumerate(sets)], "reference int, category string, bits array<int>")
    tests = refs.filter("reference % 2 = 0").select(F.concat(F.lit("t"), "reference").alias("compound"), "bits")
    brute = {(f"t{x}", y, None if y % 5 else "positive", len(set(a) & set(b)) / len(set(a) | set(b))) for x, a in enumerate(sets) if x % 2 == 0 for y, b in enumerate(sets)}
    found = similarity.analogs(tests, refs, 0.5, block=8)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in brute if x[3] >= 0.5}
    assert "Join" not in found._jdf.queryExecution().toString()


def test_waterfall(spark):
    row = spark.createDataFrame([(10.0, 4.0, 9.0, 6.0)], "a_plain double, b_plain double, a_weighted double, b_weighted double")
    got = [(r["value"], r["ymin"], r["ymax"], r["fill"]) for r in reshape.waterfall(row).orderBy("ord").collect()]
    assert got == [(6, 0, 6, "Total"), (-1, 5, 6, "Decrease"), (2, 5, 7, "Increase"), (3, 0, 3, "Total")]


def test_trace(spark):
    a = spark.createDataFrame([("x", 1, None), (None, 3, 4)], "compound string, n long, m int")
    b = spark.createDataFrame([("x", 7)], "compound string, n int")
    got = {tuple(r) for r in reshape.trace({"s": a, "t": b}, "compound").collect()}
    assert got == {("s", "x", "n", 1), ("s", "x", "m", None), ("s", None, "n", 3), ("s", None, "m", 4), ("t", "x", "n", 7)}
    assert reshape.trace({"s": a.limit(0)}, "compound").count() == 0


def test_checks(spark):
    n = lambda k: spark.range(k).agg(F.count("*"))
    report = checks.run([checks.Check("a", n(3), 3), checks.Check("b", n(3), 4, "warning"), checks.Check("c", spark.sql("select true"), True)])
    assert [r["ok"] for r in report.collect()] == [True, False, True] and not checks.failed(report)
    assert checks.failed(checks.run([checks.Check("a", n(3), 4)]))


def test_measured(spark):
    frame = spark.range(4)
    aim = [checks.Measure("rows", F.count("*"), 4), checks.Measure("sum", F.sum("id"), F.count("*") + 2), checks.Measure("low", F.min("id"), 1, "warning"), checks.Measure("any", F.max("id") > 2, True)]
    report = checks.measured(frame, aim)
    assert [(r["check"], r["expected"], r["actual"], r["ok"]) for r in report.collect()] == [("rows", "4", "4", True), ("sum", "6", "6", True), ("low", "1", "0", False), ("any", "true", "true", True)]
    assert not checks.failed(report) and checks.failed(checks.measured(frame.limit(0), aim[:1]))
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1


def test_runner(spark, tmp_path):
    ran = []
    make = lambda p: lambda s: (ran.append(p.name), p.write_text("x"))

    def fail(s):
        raise RuntimeError("no")

    a, b = tmp_path / "a", tmp_path / "b"
    steps = [runner.Step(1, "a", make(a), [str(a)], skip_if_exists=True), runner.Step(2, "bad", fail), runner.Step(3, "need", fail, required=True), runner.Step(4, "b", make(b), [str(b)])]
    first = runner.run(spark, steps)
    assert [o.status for o in first] == ["done", "failed", "failed"] and not runner.succeeded(first)
    assert [o.status for o in runner.run(spark, steps, only=4)] == ["done"] and runner.run(spark, steps, only=1)[0].status == "skipped"
    assert [s.number for s in runner.select(steps, start=3)] == [3, 4] and ran == ["a", "b"]
    assert runner.run(spark, [runner.Step(1, "none", lambda s: None, [str(tmp_path / "z")])])[0].error
    with pytest.raises(ValueError):
        runner.select(steps, only=9)


def test_normal_tails(spark):
    xs = [0.0, 0.3, 1.0, -1.7, 2.5, 5.0, 6.9, 7.1, -9.0, 30.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "z double")
    got = {r[0]: r for r in df.select("z", stats.gaussian_p(F.col("z")), stats.gaussian_p(F.col("z"), "one")).collect()}
    for x in xs:
        assert got[x][1] == pytest.approx(math.erfc(abs(x) / math.sqrt(2)), rel=2e-8, abs=0)
        assert got[x][2] == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=2e-8, abs=0)
    assert got[None][1] is None and got[None][2] is None


def test_places(spark):
    rows = [(k % 7, f"n{k:03d}") for k in range(200)]
    got = placed(spark.createDataFrame(rows, "d int, node string").repartition(5), "d", "node").collect()
    assert [(r["d"], r["node"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(rows)
    assert sorted(r["place"] for r in got) == list(range(200))
    assert placed(spark.createDataFrame([], "d int"), "d").count() == 0


#: Fixed values, published results: observed, mean and deviation of the null, z.
PUBLISHED = [
    (0.121163940, 0.016313687, 0.008680480, 12.078855), (0.032621627, 0.015675706, 0.003064354, 5.530015), (0.113809745, 0.014690641, 0.009796087, 10.118235), (0.032171300, 0.014776876, 0.003820484, 4.552937),
    (0.144874681, 0.023801833, 0.010806985, 11.203203), (0.051108934, 0.023258999, 0.003930680, 7.085271), (0.132974093, 0.020512010, 0.012517767, 8.984197), (0.049344209, 0.020853316, 0.004922195, 5.788249),
    (0.600000, 1.578700, 0.161976, -6.042243), (1.338710, 1.706726, 0.067445, -5.456566), (1.300000, 2.208600, 0.235300, -3.861455), (1.677419, 2.174903, 0.091444, -5.440302),
]


def test_published_scores(spark):
    df = spark.createDataFrame(PUBLISHED, "o double, m double, s double, z double")
    for r in df.select("z", stats.z_score(F.col("o"), F.col("m"), F.col("s")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["z"], rel=4e-5)
    p = df.filter("z > 5.53 and z < 5.54").select(stats.gaussian_p(F.col("z"), "one")).first()[0]
    assert p == pytest.approx(1.601017e-08, rel=1e-5)


def test_ranks_and_q_values_of_large_families(spark):
    """Families over several ranges, ties over ranges, a null family and null p-values, against plain Python."""
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([0.01, 0.01, 0.01, 0.2, None, rng.random()])) for k in range(600)]
    df = spark.createDataFrame(rows, "id int, f string, p_value double").repartition(4)
    for family in (["f"], []):
        want = {}
        for f in {r[1] for r in rows} if family else {0}:
            some = sorted((1.0 if p is None else p, k) for k, g, p in rows if not family or g == f)
            q = 1.0
            for at in range(len(some), 0, -1):
                q = min(q, some[at - 1][0] * len(some) / at)
                want[some[at - 1][1]] = q
        got = {r["id"]: r["q"] for r in stats.bh(df, family, out="q").collect()}
        assert got == pytest.approx(want)
    assert stats.bh(df.limit(0), []).count() == 0


def test_quantiles_and_density(spark):
    rng = random.Random(2)
    rows = [(g, x) for g, n in (("a", 301), ("b", 2), (None, 40)) for x in [rng.choice([1.5, rng.gauss(0, 3)]) for _ in range(n)]] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r["g"]: (r["n"], r["q0"], r["q1"], r["q2"]) for r in stats.quantiles(df, ["g"], "x", [0.0, 0.3, 0.975]).collect()}
    for g in ("a", "b", None):
        x = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx((len(x), *np.quantile(x, [0.0, 0.3, 0.975])))
    assert len(got) == 3
    x = np.array([v for _, v in rows if v is not None])
    d = sorted((r["x"], r["density"]) for r in stats.density(df, "x", 256).collect())
    at, y = np.array(d).T
    h = 0.9 * min(x.std(ddof=1), np.subtract(*np.quantile(x, [0.75, 0.25])) / 1.34) * len(x) ** -0.2
    want = np.exp(-(((at[:, None] - x) / h) ** 2) / 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert len(d) == 256 and np.abs(y - want).max() < 0.01 * want.max() and np.trapezoid(y, at) == pytest.approx(1, abs=2e-3)
    one = stats.density(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 64).collect()
    assert sum(r["density"] for r in one) > 0 and stats.density(df.limit(0), "x").count() == 0
