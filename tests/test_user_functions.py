"""User functions, hierarchies, footers, and operators that go by slices, against plain Python."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallgrass.operators import aggregate as H
from tallgrass.operators import apply as U
from tallgrass.operators import combine as M
from tallgrass.operators import graph as G
from tallgrass.operators import stats as X
from tallgrass.operators import windows as W
from tallgrass.plans.context import Context
from tallgrass.sources import files


def test_functions_on_values_rows_groups_and_frames(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0), ("b", 1, 7.0)], "k string, t long, v double")
    assert [r.v for r in U.apply_map(df, ["v"], lambda s: s * 10, "double").orderBy("k", "t").collect()] == [20.0, None, 50.0, 70.0]
    assert [r.n for r in U.apply_rows(df, lambda r: f"{r['k']}{r['t']}", "n", "string").orderBy("k", "t").collect()] == ["a1", "a2", "a3", "b1"]
    got = U.aggregate_custom(df, ["k"], spread=("v", lambda s: s.max() - s.min()))
    assert {r.k: r.spread for r in got.collect()} == {"a": 3.0, "b": 0.0}
    kept = U.apply_groups(df, ["k"], lambda g: g if len(g) > 1 else g.iloc[:0], "k string, t long, v double")
    assert sorted(r.t for r in kept.collect()) == [1, 2, 3]
    frames = df.withColumn("r", U.rolling_apply("v", lambda x: x[-1] - x[0], 3, ["k"], ["t"], min_periods=2)).withColumn("e", U.expanding_apply("v", sum, ["k"], ["t"]))
    assert [(r.r, r.e) for r in frames.orderBy("k", "t").collect()] == [(None, 2.0), (None, 2.0), (3.0, 7.0), (None, 7.0)]
    assert U.aggregate_custom(df.limit(0), ["k"], spread=("v", lambda s: s.max())).count() == 0


def test_hierarchies_with_null_keys(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("x", None, 3.0), (None, "a", 10.0)], "p string, c string, v double")
    levels = ["p", "c"]
    assert {(r.p, r.c, r.s) for r in H.cross_level(df, levels, 0, 1, s=F.sum("v")).collect()} == {("x", "a", 6.0), ("x", "b", 6.0), ("x", None, 6.0), (None, "a", 10.0)}
    assert {(r.p, r.s) for r in H.cross_level(df, levels, 1, 0, s=F.sum("v")).collect()} == {("x", 6.0), (None, 10.0)}
    assert {(r.p, r.c) for r in H.hierarchical_filter(df, levels, 0, F.sum("v") > 6).collect()} == {(None, "a")}
    got = H.cross_level_comparison(df, levels, "v", 1, [0])
    assert {(r.p, r.c, r.v_base_level_1, r.v_level_0) for r in got.collect()} == {("x", "a", 1.0, 6.0), ("x", "b", 2.0, 6.0), ("x", None, 3.0, 6.0), (None, "a", 10.0, 10.0)}


@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
@pytest.mark.parametrize("ascending", [True, False])
def test_ranks_by_slices(spark, monkeypatch, method, ascending):
    monkeypatch.setattr(M, "ONE_TASK_BYTES", -1)
    r = random.Random(2)
    rows = [(i, r.choice([None, *range(12)])) for i in range(80)]
    df = spark.createDataFrame(rows, "i long, v long")
    got = {x.i: x.r for x in M.rank(df, "v", "r", method, ties=["i"], ascending=ascending).collect()}
    want = pd.Series([v for _, v in rows], dtype="Float64").rank(method=method, ascending=ascending)
    assert got == {i: None if v is None else float(want[i]) for i, v in rows}


def test_slices_are_those_of_a_plain_count(spark):
    r = random.Random(3)
    for n in (1, 2, 5, 63, 64, 100):
        cuts = sorted(r.randint(0, 40) for _ in range(n - 1))
        df = spark.createDataFrame([(x, cuts) for x in range(-1, 42)], "x long, cuts array<long>")
        got = df.select("x", W.slice_of("x", "cuts", n).alias("s")).collect()
        assert all(g.s == sum(c < g.x for c in cuts) for g in got)


@pytest.mark.parametrize("how", ["mean", "var", "std"])
def test_ewm_is_its_recursion(spark, how):
    values = [None, 3.0, 5.0, None, 4.0, 4.0, -2.0]
    df = spark.createDataFrame([("g", t, v) for t, v in enumerate(values)] + [("h", 0, 1.0)], "g string, t long, v double")
    y = s = None
    want = []
    for x in values:
        if x is not None:
            if y is None:
                y, s = x, 0.0
            else:
                d = x - y
                y, s = y + 0.3 * d, 0.7 * (s + 0.3 * d * d)
        want.append(None if y is None else {"mean": y, "var": s, "std": math.sqrt(s)}[how])
    for by, rows in ((["g"], df), ([], df.where("g = 'g'"))):
        got = [r.y for r in W.ewm(rows, "v", by, ["t"], "y", alpha=0.3, how=how).where("g = 'g'").orderBy("t").collect()]
        assert [g is None for g in got] == [w is None for w in want]
        assert all(abs(g - w) < 1e-12 for g, w in zip(got, want, strict=True) if w is not None)


def test_update_keeps_the_rows_of_left(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(1, "x", 1), (1, "w", 2), (3, "z", 1)], "k long, v string, t long")
    assert sorted((r.k, r.v) for r in M.update(left, right, "k", ["v"], ["t"]).collect()) == [(1, "w"), (1, "w"), (2, "c")]
    assert sorted((r.k, r.v) for r in M.update(left, right, "k", ["v"]).collect()) == [(1, "x"), (1, "x"), (2, "c")]


def test_bootstrap_draws_again_alike(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "i long, v double")
    draw = lambda d: sorted((r.sample, round(r.mean, 9)) for r in X.bootstrap_means(d, "v", 40, key=["i"]).collect())
    means = draw(df)
    assert means == draw(df.repartition(7))
    assert len({m for _, m in means}) > 30 and abs(sum(m for _, m in means) / 40 - 3) < 0.2


def test_triangles_are_joined_by_equality(spark):
    r = random.Random(6)
    edges = [(r.randrange(14), r.randrange(14)) for _ in range(60)]
    u = {frozenset(e) for e in edges if e[0] != e[1]}
    want = {}
    for a in range(14):
        for b in range(a):
            for c in range(b):
                if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= u:
                    for v in (a, b, c):
                        want[v] = want.get(v, 0) + 1
    found = G.triangles(spark.createDataFrame(edges, "src long, dst long"))
    assert {x.id: x.triangles for x in found.collect()} == want
    assert "Cartesian" not in found._jdf.queryExecution().toString()


def test_footers_schemas_and_named_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, None)], "i long, s string").coalesce(1).write.parquet(path)
    got = {r["column"]: r for r in files.parquet_footers(spark, path).collect()}
    assert set(got) == {"i", "s"} and got["i"].rows == 2 and got["i"].low == "1" and got["i"].high == "2" and got["s"].nulls == 1
    more = str(tmp_path / "more")
    spark.createDataFrame([(3, 1.5)], "i long, x double").write.parquet(more)
    both = files.read_parquet_evolved(spark, path, more)
    assert sorted(both.columns) == ["i", "s", "x"] and both.count() == 3
    c = Context(spark)
    c.register_parquet("footer_rows", path)
    assert c.sql("SELECT count(*) AS n FROM footer_rows WHERE i > :least", least=1).first().n == 1
    c.create_function("twice", "x BIGINT", "BIGINT", "x * 2")
    assert c.sql("SELECT sum(twice(i)) AS n FROM footer_rows").first().n == 6
    c.validate("footer_rows", {"i": "bigint"})
    with pytest.raises(ValueError, match="differ"):
        c.validate("footer_rows", {"i": "string"})
