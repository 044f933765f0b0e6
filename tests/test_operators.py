"""Small inputs with known results, and every registered SQL twin on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import dates as D
from tallgrass.functions import text as S
from tallgrass.functions.expression import evaluate, query_filter
from tallgrass.operators import combine as M
from tallgrass.operators import graph as G
from tallgrass.operators import windows as W
from tallgrass.plans import analytics, basic, frames, grouped, joined, registry, series  # noqa: F401
from tallgrass.sources import files
from tallgrass.streaming import windows as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    """Sums of doubles depend on their order, and a rounded double may fall on either side."""
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6) if isinstance(a, float) and isinstance(b, float) else str(a) == str(b)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_its_sql_twin(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    result = db.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    # rows in the order of their exact values, then of their doubles
    exact = lambda row: ([str(v) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)])
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=exact)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in result.fetchall()), key=exact)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_business_days_in_parts_by_size(spark, monkeypatch):
    query = registry.QUERIES["business_day_count"]
    whole = sorted(map(tuple, query(spark, SF).collect()))
    monkeypatch.setattr(M, "ONE_TASK_BYTES", 1 << 10)
    monkeypatch.setattr(M, "PART_BYTES", 10 << 10)
    df = query(spark, SF)
    # about 116 KB of lineitem
    assert df.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, df.collect())) == whole


def test_merges(spark):
    a = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "Dave")], "id long, name string")
    b = spark.createDataFrame([(1, 100), (2, 200), (5, 500), (6, 600)], "id long, value long")
    assert {how: M.merge(a, b, on=["id"], how=how).count() for how in ("inner", "left", "right", "outer")} == {"inner": 2, "left": 4, "right": 4, "outer": 6}
    assert sorted(r.id for r in M.merge(a, b, on=["id"], how="outer").collect()) == [1, 2, 3, 4, 5, 6]


def test_rolling_and_ewm(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(1, 8)], "g int, t int, v double")
    got = df.select("t", W.rolling("v", "mean", 3, ["g"], ["t"]).alias("m")).orderBy("t").collect()
    assert [r.m for r in got] == [None, None, 2, 3, 4, 5, 6]
    tens = spark.createDataFrame([(1, k, 10.0 * k) for k in range(1, 6)], "g int, t int, v double")
    for by in (["g"], []):
        assert [r.y for r in W.ewm(tens, "v", by, ["t"], "y", alpha=0.5).orderBy("t").collect()] == [10, 15, 22.5, 31.25, 40.625]


def test_expression_language(spark):
    df = spark.createDataFrame([(1, 2.0, "x"), (5, 3.0, "y z"), (None, 1.0, "x")], "a int, b double, s string")
    count = lambda q, **v: query_filter(df, q, v).count()
    assert count("a > 1 and s == 'y z'") == 1
    assert count("not (a > 1) || b ** 2 ** 0.5 > 100") == 1
    assert count("s in ['x', 'q'] and b < @top", top=1.5) == 1
    assert count("1 < b < 3") == 1
    assert df.select(evaluate(df, "-b ** 2").alias("x")).first().x == -4
    for bad in ("a >", "a $ b", "nofunc(a)", "a b"):
        with pytest.raises(Exception):
            query_filter(df, bad)


def test_business_days(spark):
    df = spark.sql("SELECT DATE '2024-03-01' AS a, DATE '2024-03-11' AS b, DATE '2024-03-02' AS c, DATE '2024-03-03' AS d")
    got = df.select(D.business_days(F.col("a"), F.col("b")).alias("x"), D.business_days(F.col("c"), F.col("d")).alias("y"), D.business_days(F.col("b"), F.col("a")).alias("z")).first()
    assert tuple(got) == (7, 0, 0)


def test_padding_keeps_long_strings(spark):
    df = spark.createDataFrame([("abc",), ("-5",), (None,)], "s string")
    got = [tuple(r) for r in df.select(S.pad(F.col("s"), 2).alias("a"), S.center(F.col("s"), 6, "*").alias("b"), S.zfill(F.col("s"), 4).alias("c")).collect()]
    assert got == [("abc", "*abc**", "0abc"), ("-5", "**-5**", "-005"), (None, None, None)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "src long, dst long")
    assert {r.id: r.component for r in G.connected_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert {r.id: r.triangles for r in G.triangles(e).collect()} == {1: 1, 2: 1, 3: 1}
    assert math.isclose(sum(r["rank"] for r in G.pagerank(e, 5).collect()), 1)
    assert {r.id: r.level for r in G.bfs_levels(e, 1).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "id long, s string, v double")
    for form, write, read in (("csv", files.write_csv, lambda p: files.read_csv(spark, p, df.schema)), ("json", files.write_json, lambda p: files.read_json(spark, p, df.schema)), ("orc", files.write_orc, lambda p: files.read_orc(spark, p)), ("parquet", files.write_parquet, lambda p: files.read_parquet(spark, p))):
        path = str(tmp_path / form)
        write(df, path)
        assert sorted(map(tuple, read(path).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_stream_windows_are_the_batch_windows(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/events.parquet")
    end = src.agg(F.max("ts")).first()[0]
    src.write.parquet(str(tmp_path / "in"))
    df = stream.read(spark, str(tmp_path / "in"), src.schema)
    out = stream.run_available(stream.tumbling(df, "ts", "6 hours", "1 hour", ["event_type"], n=F.count("*")), "tumbling_out", str(tmp_path / "c1"), "complete")
    want = basic.table(spark, SF, "events").groupBy(F.window("ts", "6 hours"), "event_type").count()
    assert out.count() == want.count()
    assert out.agg(F.sum("n")).first()[0] == src.count()
    assert end is not None
