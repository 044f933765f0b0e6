"""Blocks, communities and paths against brute force; diagnostics of series against plain loops and at their edges."""

import itertools
import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tallgrass.operators import diagnostics as X
from tallgrass.operators import forecast as FC
from tallgrass.operators import ml as ML
from tallgrass.operators import structure as G


def parts(nodes, edges):
    label = {v: v for v in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return len(set(label.values()))


def test_blocks_against_removal(spark):
    r = random.Random(5)
    edges = set()
    # three random parts, some apart, with repeated, reversed and looping edges
    for base, n, m in ((0, 9, 11), (20, 6, 5), (40, 5, 9)):
        edges |= {tuple(sorted((base + r.randrange(n), base + r.randrange(n)))) for _ in range(m)}
    edges = sorted(e for e in edges if e[0] != e[1])
    df = spark.createDataFrame(edges + [(edges[0][1], edges[0][0]), edges[1], (3, 3)], "src long, dst long")
    nodes = {v for e in edges for v in e} | {3}
    whole = parts(nodes, edges)
    cut = {e for e in edges if parts(nodes, [x for x in edges if x != e]) > whole}
    assert {(x.src, x.dst) for x in G.bridges(df).collect()} == cut
    points = {v for v in nodes if parts(nodes - {v}, [e for e in edges if v not in e]) > whole}
    assert {x.id for x in G.articulation_points(df).collect()} == points
    assert G.bridges(df.limit(0)).count() == 0


def test_louvain_finds_cliques(spark):
    cliques = [e for base in (0, 10, 20) for e in itertools.combinations(range(base, base + 5), 2)]
    df = spark.createDataFrame([*cliques, (0, 10), (11, 20)], "src long, dst long")
    communities, q = G.louvain(df)
    assert {x.id: x.community for x in communities.collect()} == {base + i: base for base in (0, 10, 20) for i in range(5)}
    # 32 edges: 10 inside each clique, degrees 21, 22 and 21
    assert math.isclose(q, sum(20 / 64 - (d / 64) ** 2 for d in (21, 22, 21)), rel_tol=1e-9)
    lone, q = G.louvain(spark.createDataFrame([(1, 1)], "src long, dst long"))
    assert [tuple(x) for x in lone.collect()] == [(1, 1)] and q == 0


def test_paths_against_enumeration(spark):
    r = random.Random(2)
    n = 7
    w = {(a, b): float(r.randint(1, 9)) for a in range(n) for b in range(n) if a != b and r.random() < 0.4}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, weight double")
    every = []
    for k in range(n - 1):
        for middle in itertools.permutations(range(1, n - 1), k):
            p = [0, *middle, n - 1]
            if all(x in w for x in itertools.pairwise(p)):
                every.append((sum(w[x] for x in itertools.pairwise(p)), p))
    every.sort()
    got = G.k_shortest_paths(df, 0, n - 1, 5).orderBy("rank").collect()
    assert [x.distance for x in got] == [d for d, _ in every[:5]]
    assert all((x.distance, x.path) in every for x in got) and len({tuple(x.path) for x in got}) == len(got)
    h = spark.createDataFrame([(v, 0.5) for v in range(1, n - 1)], "id long, h double")
    assert G.shortest_path_to(df, 0, n - 1, h).first().distance == every[0][0]
    assert G.shortest_path_to(df, 0, 99).count() == 0


def test_diagnostics_at_their_edges(spark):
    r = random.Random(1)
    walk = [r.gauss(0, 1) for _ in range(40)]
    rows = [("a", i, x) for i, x in enumerate(walk)] + [("a", 99, None)] + [("flat", i, 1.1) for i in range(12)] + [("one", 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    by = lambda d: {x.g: x for x in d.collect()}
    dw = by(X.durbin_watson(df, ["g"], ["t"], "v"))
    m = sum(walk) / 40
    v = sum((x - m) ** 2 for x in walk)
    assert math.isclose(dw["a"].statistic, sum((y - x) ** 2 for x, y in itertools.pairwise(walk)) / v) and "one" not in dw
    lb = by(X.portmanteau(df, ["g"], ["t"], "v", 3))
    acf = [sum((walk[i] - m) * (walk[i + k] - m) for i in range(40 - k)) / v for k in (1, 2, 3)]
    assert math.isclose(lb["a"].ljung_box, 40 * 42 * sum(x * x / (40 - k - 1) for k, x in enumerate(acf)), rel_tol=1e-9)
    assert lb["one"].ljung_box == 0 and not lb["one"].autocorrelated and 0 <= lb["a"].p <= 1
    drift = by(X.drift_test(df, ["g"], ["t"], "v"))
    assert set(drift) == {"a", "flat"} and drift["flat"].statistic == 0
    for trend in ("constant", "linear"):
        k = by(X.kpss(df, ["g"], ["t"], "v", trend))
        assert set(k) == {"a", "flat"} and k["flat"].is_stationary and k["flat"].statistic < 1e-6
    assert by(X.variance_ratio(df, ["g"], ["t"], "v"))["flat"].variance_ratio == 1
    assert by(X.grubbs(df, ["g"], "v"))["one"].statistic == 0
    assert by(X.jarque_bera(df, ["g"], "v"))["flat"].statistic == 0
    z = X.modified_zscores(df, ["g"], "v").collect()
    assert len(z) == 53 and all(x.modified_z == 0 for x in z if x.g != "a")
    jump = spark.createDataFrame([("a", i, 0.0 if i < 10 else 1.0) for i in range(20)], "g string, t int, v double")
    scores = X.mean_shifts(jump, ["g"], ["t"], "v").orderBy("t").collect()
    assert max(scores, key=lambda x: x.score).t == 10 and scores[0].score == scores[19].score == 0
    assert X.kpss(df.limit(0), ["g"], ["t"], "v").count() == 0


def test_mean_shifts_sum_without_rounding_errors(spark):
    values = [1e16, 1.0, -1e16, 1.0, 1.0, 1.0, 1.0, 1.0]
    # far off the range of the parts: sums of doubles as they are
    odd = [("tiny", k, 1e-300 * (k > 3)) for k in range(8)] + [("nan", k, float("nan")) for k in range(8)] + [("zero", k, 0.0) for k in range(8)] + [("huge", k, 2.0**1015) for k in range(8)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)] + odd, "g string, t int, v double")
    got = {(x.g, x.t): x.score for x in X.mean_shifts(df, ["g"], ["t"], "v").collect()}
    exact = [Fraction(v) for v in values]
    assert all(math.isclose(got["a", i], abs(sum(exact[:i]) / i - sum(exact[i:]) / (8 - i)), rel_tol=1e-15) for i in range(2, 6))
    assert got["tiny", 4] == 1e-300 and math.isnan(got["nan", 4]) and got["zero", 4] == 0 and got["huge", 4] == 0 and len(got) == 40


def test_permutation(spark):
    rows = [(i, "a" if i < 12 else "b", float(i % 5 + (3 if i < 12 else 0))) for i in range(24)]
    df = spark.createDataFrame(rows, "k int, g string, v double")
    got = X.permutation_test(df, "v", "g", "a", "b", "k").first()
    assert got.permutations == 200 and got.p < 0.02 and got.difference > 2.5
    same = X.permutation_test(df.withColumn("v", F.lit(1.0)), "v", "g", "a", "b", "k").first()
    assert same.p == 1 and same.difference == 0
    assert X.permutation_test(df.limit(0), "v", "g", "a", "b", "k").first().p is None


def test_choose_model(spark):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(40)], "x double, y double")
    name, model, scores = ML.choose_model(df, ["x"], "y", {"linear_regression": {"regParam": [0.0, 5.0]}, "tree_regressor": {"maxDepth": [1]}}, "rmse", folds=2)
    assert name == "linear_regression" and scores[name] < 0.01
    assert math.isclose(ML.predict(model, df).orderBy("x").first().prediction, 1.0, abs_tol=1e-3)


def test_autoregression(spark):
    x = [1.0, 4.0]
    while len(x) < 14:
        x.append(2 + 0.6 * x[-1] - 0.3 * x[-2])
    walk = [0.0]
    for v in x:
        walk.append(walk[-1] + v)
    rows = [("ar", i, v) for i, v in enumerate(x[:10])] + [("sum", i, v) for i, v in enumerate(walk[:12])] + [("one", 0, 7.0), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    plain = {(r.g, r.step): r.forecast for r in FC.autoregressive(df, ["g"], ["t"], "v", 3, p=2).collect()}
    assert all(math.isclose(plain["ar", h], x[9 + h], rel_tol=1e-8) for h in (1, 2, 3))
    assert plain["one", 3] == 7 and ("none", 1) not in plain
    summed = {(r.g, r.step): r.forecast for r in FC.autoregressive(df, ["g"], ["t"], "v", 2, p=2, d=1).collect()}
    assert all(math.isclose(summed["sum", h], walk[11 + h], rel_tol=1e-8) for h in (1, 2)) and summed["one", 1] == 7
