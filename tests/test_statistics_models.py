"""Distributions, tests, graphs, models, labels and keyed stream state against known values and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import distributions as P
from tallgrass.operators import graph as G
from tallgrass.operators import labels as L
from tallgrass.operators import ml as ML
from tallgrass.operators import stats as X
from tallgrass.streaming import stateful as ST
from tallgrass.streaming import windows as stream


def near(a, b, tol=1e-6):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def test_distributions_against_tables():
    # critical values of printed tables
    assert near(P.normal_cdf(1.959964), 0.975)
    assert near(P.t_cdf(2.228139, 10), 0.975)
    assert near(P.t_cdf(-12.7062, 1), 0.025, 1e-5)
    assert near(P.chi2_cdf(3.841459, 1), 0.95)
    assert near(P.chi2_cdf(18.307038, 10), 0.95)
    assert near(P.f_cdf(3.325835, 5, 10), 0.95)
    assert near(P.inverse(P.t_cdf, 0.975, 10), 2.228139)
    assert near(P.inverse(P.normal_cdf, 0.5), 0, 1e-9)
    for n, p in ((7, 0.3), (20, 0.55)):
        for k in range(n):
            assert near(P.binomial_cdf(k, n, p), sum(P.binomial_pmf(i, n, p) for i in range(k + 1)), 1e-10)
    for k in range(12):
        assert near(P.poisson_cdf(k, 3.5), sum(P.poisson_pmf(i, 3.5) for i in range(k + 1)), 1e-10)
    # densities are the slopes of distribution functions
    for cdf, pdf, args in ((P.t_cdf, P.t_pdf, (5,)), (P.chi2_cdf, P.chi2_pdf, (4,)), (P.f_cdf, P.f_pdf, (3, 8)), (P.normal_cdf, P.normal_pdf, (1, 2))):
        assert near((cdf(1.3 + 1e-5, *args) - cdf(1.3 - 1e-5, *args)) / 2e-5, pdf(1.3, *args), 1e-6)


def test_tests_with_p_values(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    t = X.pooled_t(df, "v", "g", "a", "b").first()
    assert near(t.t, -1.8973666) and t.dof == 8 and near(t.p, 0.0943497728, 1e-5)
    one = X.one_sample_t(df.where("g = 'a'"), "v", 3.0).first()
    assert one.t == 0 and one.p == 1
    pairs = spark.createDataFrame([(x, y + 0.5 * (x == 3)) for x, y in zip(a, b, strict=True)] + [(None, 1.0)], "x double, y double")
    assert X.paired_t(pairs, "x", "y").first().dof == 4
    u = X.mann_whitney(df, "v", "g", "a", "b").first()
    brute = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (u.u1, u.u2) == (brute, 25 - brute) and u.u == min(brute, 25 - brute) and 0 < u.p < 1
    ks = X.ks_two_sample(df, "v", "g", "a", "b").first()
    assert near(ks.d, max(abs(sum(x <= v for x in a) / 5 - sum(x <= v for x in b) / 5) for v in a + b)) and 0 < ks.p <= 1
    assert near(X.spearman(pairs, "x", "y").first().rho, 1)
    w = X.wilcoxon(pairs, "x", "y").first()
    assert (w.w_plus, w.w_minus) == (0, 15)
    h = X.kruskal(df, "v", "g").first()
    assert h.dof == 1 and 0 < h.p < 1
    empty = df.limit(0)
    assert X.one_sample_t(empty, "v", 0.0).first().p is None
    assert X.mann_whitney(empty, "v", "g", "a", "b").first().u is None


def test_rank_tests_of_millions_of_rows(spark):
    n, plus = 1_700_000, 1_275_000
    w = X.wilcoxon(spark.range(n).select(F.when(F.col("id") % 4 == 0, -1.0).otherwise(1.0).alias("x"), F.lit(0.0).alias("y")), "x", "y").first()
    # all differences are as large, so each rank is (n + 1) / 2
    assert (w.w_plus, w.w_minus) == (plus * (n + 1) / 2, (n - plus) * (n + 1) / 2)
    assert near(w.z, ((n - plus) * (n + 1) / 2 - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    m = 1_700_000
    u = X.mann_whitney(spark.range(2 * m).select(F.when(F.col("id") < m, "a").otherwise("b").alias("g"), (F.col("id") % 2).cast("double").alias("v")), "v", "g", "a", "b").first()
    assert u.u1 == u.u2 == m * m / 2 and near(u.z, 0.5 / math.sqrt(m * m * (2 * m + 1) / 12))


def test_runs_friedman_and_corrections(spark):
    flags = spark.createDataFrame([(1, k, bool(int(c))) for k, c in enumerate("1100101")], "g int, k int, f boolean")
    assert X.runs_test(flags, "f", ["g"], ["k"]).first().runs == 5
    blocks = spark.createDataFrame([(b, t, float(v)) for b, row in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3)]) for t, v in enumerate(row)], "b int, t int, v double")
    f = X.friedman(blocks, "b", "t", "v").first()
    assert near(f.chi2, 14 / 3) and f.dof == 2
    ps = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.04, 0.03])], "k int, p double")
    values = lambda m: [round(r.adjusted, 6) for r in X.adjust_p_values(ps, "p", m).orderBy("k").collect()]
    assert values("bonferroni") == [0.03, 0.12, 0.09]
    assert values("holm") == [0.03, 0.06, 0.06]
    assert values("fdr") == [0.03, 0.04, 0.04]


def test_bootstrap_and_strata(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"), (F.col("id") % 4).cast("string").alias("s"))
    i = X.bootstrap_interval(df, "v").first()
    assert 4.0 < i.low < 4.5 < i.high < 5.0
    part = X.stratified_sample(df, "s", 0.1, "id")
    assert {r.s: r["count"] for r in part.groupBy("s").count().collect()} == dict.fromkeys("0123", 10)
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, X.stratified_sample(df, "s", 0.1, "id").collect()))


def _floyd(n, edges):
    d = [[0 if i == j else math.inf for j in range(n)] for i in range(n)]
    for a, b, w in edges:
        d[a][b] = min(d[a][b], w)
    for k in range(n):
        for i in range(n):
            for j in range(n):
                d[i][j] = min(d[i][j], d[i][k] + d[k][j])
    return d


def test_paths_of_more_than_100_edges(spark):
    n = 103
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long").coalesce(1)
    assert {x.id: x.level for x in G.bfs_levels(chain, 0).collect()} == {i: i for i in range(n + 1)}
    assert G.bfs_levels(chain, 0, limit=3).count() == 4
    # of vertex i the n - i behind it are reached, at 1, 2, ... edges
    want = {i: (n - i) ** 2 / (n * (n - i) * (n - i + 1) / 2) if i < n else 0 for i in range(n + 1)}
    got = {x.id: x.closeness for x in G.closeness(chain).collect()}
    assert got.keys() == want.keys() and all(near(got[i], want[i]) for i in want)


def test_closeness_of_more_than_100000_vertices(spark):
    n = 100_001
    star = spark.range(1, n + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    c = G.closeness(star).agg(F.count("*").alias("n"), F.count_if(F.col("closeness") == 1 / n).alias("spokes"), F.count_if(F.col("closeness") == 0).alias("hub")).first()
    assert (c.n, c.spokes, c.hub) == (n + 1, n, 1)


def test_graph_against_brute_force(spark):
    r = random.Random(3)
    n = 9
    edges = sorted({(r.randrange(n), r.randrange(n)) for _ in range(16)} | {(i, (i + 1) % 4) for i in range(4)})
    weighted = [(a, b, float(r.randint(1, 9))) for a, b in edges]
    df = spark.createDataFrame(weighted, "src long, dst long, weight double")
    ids = sorted({v for e in edges for v in e})
    d = _floyd(n, weighted)
    assert {x.id: x.distance for x in G.shortest_paths(df, 0).collect()} == {j: d[0][j] for j in ids if d[0][j] < math.inf}
    hops = _floyd(n, [(a, b, 1) for a, b in edges])
    assert {(x.start, x.id): x.distance for x in G.distances_from(df).collect()} == {(i, j): hops[i][j] for i in ids for j in ids if hops[i][j] < math.inf}
    want = {i: min(j for j in ids if hops[i][j] < math.inf and hops[j][i] < math.inf) for i in ids}
    assert {x.id: x.component for x in G.strongly_connected(df).collect()} == want
    assert G.has_cycle(df)
    star = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "src long, dst long")
    between = {x.id: x.betweenness for x in G.betweenness(star, directed=False).collect()}
    assert near(between[0], 1) and between[1] == 0
    assert {x.id: x.level for x in G.topological_levels(star).collect()} == {0: 1, 1: 0, 2: 0, 3: 0}
    assert not G.has_cycle(star)
    two = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], "src long, dst long")
    split = spark.createDataFrame([(i, i // 3) for i in range(6)], "id long, community int")
    assert near(G.modularity(two, split).first().q, 6 / 7 - 0.5)
    assert len({x.label for x in G.label_propagation(two).collect()}) <= 2


def test_negative_cycle_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, weight double")
    with pytest.raises(ValueError):
        G.shortest_paths(df, 0)


def test_models(spark):
    df = spark.range(200).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df = df.withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 1).withColumn("c", (F.col("a") > 9).cast("double"))
    train, test = ML.train_test_split(df, "id")
    assert train.count() + test.count() == 200 and 20 <= test.count() <= 60
    fitted = ML.predict(ML.fit(train, "linear_regression", ["a", "b"], "y", solver="normal"), test)
    assert ML.regression_report(fitted, "y").first().r2 > 0.999
    named = ML.predict(ML.fit(train, "tree_classifier", ["a", "b"], "c"), test)
    assert named.where("prediction != c").count() == 0
    assert ML.select_k_best(df, ["a", "b"], "c", 1) == ["a"]
    groups = ML.predict(ML.fit(df.withColumn("far", 100 * F.col("c")), "kmeans", ["far"], k=2, seed=1), df.withColumn("far", 100 * F.col("c")))
    assert groups.select("c", "prediction").distinct().count() == 2
    scaled = ML.standard_scale(df, ["a"]).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert near(scaled.m, 0) and near(scaled.s, 1)
    assert tuple(ML.minmax_scale(df, ["b"]).agg(F.min("b"), F.max("b")).first()) == (0, 1)
    gaps = df.withColumn("a", F.when(F.col("id") > 0, F.col("a")))
    assert ML.impute(gaps, ["a"], "median").where("a is null").count() == 0
    assert ML.polynomial_columns(df, ["a", "b"]).columns[-3:] == ["a_x_a", "a_x_b", "b_x_b"]
    assert len(ML.pca(df, ["a", "b"], 1).first().components) == 1


def test_labels(spark):
    df = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 3)], "k string, l string, v int")
    assert [tuple(r) for r in L.xs(df, "l", "q").collect()] == [("x", 2)]
    assert L.get_tuple(df, ["k", "l"], ("y", "p")).first().v == 3
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string"), spark.createDataFrame([(2, 5), (3, 6)], "id int, t int")
    assert {h: L.align(a, b, "id", h)[0].count() for h in ("outer", "inner", "left", "right")} == {"outer": 3, "inner": 1, "left": 2, "right": 2}
    assert sorted((r.id, r.s) for r in L.reindex(a, "id", spark.range(2, 4)).collect()) == [(2, "b"), (3, None)]
    assert {r.l: r.n for r in L.category_counts(df, "l", ["p", "q", "z"]).collect()} == {"p": 2, "q": 1, "z": 0}
    assert [r.c for r in df.select(L.category_code(F.col("l"), ["q", "p"]).alias("c")).collect()] == [1, 0, 1]
    got = df.select(L.interval_index(F.col("v"), [1, 2, 3], "right").alias("r"), L.interval_index(F.col("v"), [1, 2, 3], "left").alias("l")).collect()
    assert [tuple(r) for r in got] == [(None, 0), (0, 1), (1, None)]
    day = spark.sql("SELECT DATE '2024-02-17' AS d")
    assert [str(v) for v in day.select(*L.period(F.col("d"), "month"), *L.period(F.col("d"), "quarter")).first()] == ["2024-02-01", "2024-02-29", "2024-01-01", "2024-03-31"]


def test_windows_by_count_and_limited_sessions(spark, tmp_path):
    # a second after the epoch, where the first watermark lies: a row at the watermark is late
    rows = [("a", 0, 1.0), ("a", 5, 2.0), ("a", 10, 3.0), ("a", 14, 4.0), ("a", 60, 5.0), ("b", 1, 6.0), ("b", 500, 7.0)]
    df = spark.createDataFrame(rows, "k string, s int, v double").select("k", F.timestamp_seconds(F.col("s") + 1).alias("ts"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: stream.read(spark, str(tmp_path / "in"), df.schema)
    full = stream.run_available(ST.count_windows(source(), ["k"], "ts", "v", 2), "full", str(tmp_path / "c1"))
    assert sorted(tuple(r) for r in full.collect()) == [("a", 0, 2, 3.0, 1.0, 2.0), ("a", 1, 2, 7.0, 3.0, 4.0), ("b", 0, 2, 13.0, 6.0, 7.0)]
    limited = ST.sessions_limited(stream.with_watermark(source(), "ts", "0 seconds"), ["k"], "ts", "v", 10_000, 12_000)
    got = sorted(tuple(r) for r in stream.run_available(limited, "limited", str(tmp_path / "c2")).collect())
    assert got[:2] == [("a", 1000, 11_000, 3, 6.0), ("a", 15_000, 15_000, 1, 4.0)]
    assert ("b", 2000, 2000, 1, 6.0) in got
