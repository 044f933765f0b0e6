"""Queries of user functions, hierarchies, labels, named tables, rank tests and graph structure, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import aggregate as H
from ..operators import apply as U
from ..operators import columns as C
from ..operators import combine as M
from ..operators import graph as G
from ..operators import labels as L
from ..operators import stats as X
from ..operators import structure as S
from .analytics import _TREE, _tree
from .context import Context
from .registry import query, table

#: Added before rounding, here and in the SQL, so that the engines round halves alike.
NUDGE = 1e-9
WIN = "PARTITION BY user_id ORDER BY ts"


def _rounded(c: str, digits: int = 6) -> F.Column:
    return F.round(F.col(c) + NUDGE, digits).alias(c)


# --- user functions ---


@query("SELECT event_id, value * 2 + 1 AS value FROM events")
def apply_map_values(spark: SparkSession, sf: str) -> DataFrame:
    return U.apply_map(table(spark, sf, "events").select("event_id", "value"), ["value"], lambda v: v * 2 + 1, "double")


@query("SELECT r_regionkey, r_name, length(r_name) + r_regionkey AS size FROM region")
def apply_rows_to_regions(spark: SparkSession, sf: str) -> DataFrame:
    return U.apply_rows(table(spark, sf, "region").select("r_regionkey", "r_name"), lambda r: len(r["r_name"]) + int(r["r_regionkey"]), "size", "long")


@query("SELECT event_type, max(value) - min(value) AS spread, max(abs(value - 50)) AS far FROM events GROUP BY event_type")
def aggregate_custom_functions(spark: SparkSession, sf: str) -> DataFrame:
    return U.aggregate_custom(table(spark, sf, "events"), ["event_type"], spread=("value", lambda v: v.max() - v.min()), far=("value", lambda v: (v - 50).abs().max()))


@query("SELECT user_id, event_id, round(value - first(value) OVER (PARTITION BY user_id ORDER BY ts) + 1e-9, 6) AS since FROM events QUALIFY count(*) OVER (PARTITION BY user_id) > 3")
def apply_groups_transform_filter(spark: SparkSession, sf: str) -> DataFrame:
    def since(g):  # noqa: ANN001, ANN202
        g = g.sort_values("ts") if len(g) > 3 else g.iloc[:0]
        return g.assign(since=g["value"] - (g["value"].iloc[0] if len(g) else 0.0))[["user_id", "event_id", "since"]]

    return U.apply_groups(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], since, "user_id long, event_id long, since double").select("user_id", "event_id", _rounded("since"))


@query(f"SELECT event_id, CASE WHEN row_number() OVER ({WIN}) >= 3 THEN round((lag(value, 2) OVER ({WIN}) + 2 * lag(value) OVER ({WIN}) + 3 * value) / 6 + 1e-9, 6) END AS weighted FROM events")
def rolling_apply_weighted(spark: SparkSession, sf: str) -> DataFrame:
    weighted = U.rolling_apply("value", lambda x: (x[0] + 2 * x[1] + 3 * x[2]) / 6, 3, ["user_id"], ["ts"])
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value").withColumn("weighted", weighted).select("event_id", _rounded("weighted"))


@query(f"SELECT event_id, max(value) OVER w - min(value) OVER w AS spread FROM events WINDOW w AS ({WIN} ROWS UNBOUNDED PRECEDING)")
def expanding_apply_spread(spark: SparkSession, sf: str) -> DataFrame:
    spread = U.expanding_apply("value", lambda x: max(x) - min(x), ["user_id"], ["ts"])
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value").withColumn("spread", spread).select("event_id", "spread")


# --- hierarchies: region, nation, segment ---

_LEVELS = ["n_regionkey", "c_nationkey", "c_mktsegment"]
_CUSTOMERS = "(SELECT n_regionkey, c_nationkey, c_mktsegment, c_acctbal, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(*_LEVELS, "c_acctbal", "c_custkey")


@query(f"SELECT n_regionkey, c_nationkey, n, round(total, 2) AS total FROM (SELECT DISTINCT n_regionkey, c_nationkey FROM {_CUSTOMERS}) JOIN (SELECT n_regionkey, count(*) AS n, sum(c_acctbal) AS total FROM {_CUSTOMERS} GROUP BY 1) USING (n_regionkey)")
def cross_level_agg(spark: SparkSession, sf: str) -> DataFrame:
    return H.cross_level(_customers(spark, sf), _LEVELS, 0, 1, n=F.count("*"), total=F.round(F.sum("c_acctbal"), 2))


@query(f"SELECT c_custkey, c_acctbal = max(c_acctbal) OVER (PARTITION BY n_regionkey, c_nationkey) AS best FROM {_CUSTOMERS}")
def nested_transform(spark: SparkSession, sf: str) -> DataFrame:
    return H.nested_transform(_customers(spark, sf), _LEVELS, 1, lambda w: F.col("c_acctbal") == F.max("c_acctbal").over(w), "best").select("c_custkey", "best")


@query(f"SELECT c_custkey FROM {_CUSTOMERS} QUALIFY avg(c_acctbal) OVER (PARTITION BY n_regionkey, c_nationkey) > 4500")
def hierarchical_filter(spark: SparkSession, sf: str) -> DataFrame:
    return H.hierarchical_filter(_customers(spark, sf), _LEVELS, 1, F.avg("c_acctbal") > 4500).select("c_custkey")


@query(f"SELECT n_regionkey, c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS c_acctbal_base_level_2, round(sum(sum(c_acctbal)) OVER (PARTITION BY n_regionkey), 2) AS c_acctbal_level_0, round(sum(sum(c_acctbal)) OVER (PARTITION BY n_regionkey, c_nationkey), 2) AS c_acctbal_level_1 FROM {_CUSTOMERS} GROUP BY 1, 2, 3")
def cross_level_comparison(spark: SparkSession, sf: str) -> DataFrame:
    out = H.cross_level_comparison(_customers(spark, sf), _LEVELS, "c_acctbal", 2, [0, 1])
    return out.select(*_LEVELS, *[F.round(c, 2).alias(c) for c in out.columns[3:]])


# --- labels, types, named tables ---


@query("SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS as_text, CAST(trunc(c_acctbal) AS BIGINT) AS as_long FROM customer WHERE c_acctbal >= 0")
def astype_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey", F.col("c_acctbal").alias("as_text"), F.col("c_acctbal").alias("as_long"))
    return C.astype(C.astype(c, "as_text", "string"), "as_long", "bigint")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def xs_of_a_level(spark: SparkSession, sf: str) -> DataFrame:
    return L.xs(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), "o_orderstatus", "F")


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'SEVEN' ELSE n_name END AS n_name FROM nation")
def set_value_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return L.set_value(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7, "n_name", "SEVEN")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def align_outer_left(spark: SparkSession, sf: str) -> DataFrame:
    return L.align(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")[0]


@query("(SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION ALL (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    return M.symmetric_difference(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")))


@query("SELECT event_id, value / 0.5 AS v, CAST(isfinite(value / 0.5) AS BOOLEAN) AS finite FROM events")
def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 0.5).alias("v"))
    return e.withColumn("finite", A.is_finite(F.col("v")))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice * 1.1::DOUBLE), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority")
def context_sql(spark: SparkSession, sf: str) -> DataFrame:
    c = Context(spark)
    c.register_parquet("context_orders", f"{sf}/orders.parquet")
    c.validate("context_orders", {"o_orderkey": "bigint", "o_totalprice": "double"})
    c.create_function("with_tax", "x DOUBLE", "DOUBLE", "x * 1.1D")
    return c.sql("SELECT o_orderpriority, count(*) AS n, round(sum(with_tax(o_totalprice)), 2) AS total FROM context_orders WHERE o_totalprice > :least GROUP BY o_orderpriority", least=1000)


# --- rank tests ---


@query(
    """WITH d AS (SELECT l_quantity - 25 AS d FROM lineitem WHERE l_quantity <> 25), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d),
    w AS (SELECT sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, count(*)::DOUBLE AS n FROM r)
    SELECT w_plus, w_minus, least(w_plus, w_minus) AS w, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM w"""
)
def wilcoxon_signed_rank(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select("l_quantity", F.lit(25.0).alias("half"))
    return X.wilcoxon(d, "l_quantity", "half").select("w_plus", "w_minus", "w", F.round("z", 6).alias("z"))


_BLOCKS = "(SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS a FROM customer GROUP BY 1, 2)"


@query(
    f"""WITH r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_nationkey ORDER BY a) + (count(*) OVER (PARTITION BY c_nationkey, a) - 1) / 2 AS r FROM {_BLOCKS}),
    s AS (SELECT sum(r) AS r, count(*) AS n FROM r GROUP BY c_mktsegment), t AS (SELECT count(*) AS k, max(n) AS n, sum(r * r) AS s FROM s)
    SELECT round(12 * s / (n * k * (k + 1)) - 3 * n * (k + 1) + 1e-9, 6) AS chi2, (k - 1)::DOUBLE AS dof FROM t"""
)
def friedman_test(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("a"))
    return X.friedman(blocks, "c_nationkey", "c_mktsegment", "a").select(_rounded("chi2"), "dof")


@query(
    f"""WITH f AS (SELECT user_id, value > 50 AS f, coalesce((value > 50) <> lag(value > 50) OVER ({WIN}), true) AS b FROM events),
    m AS (SELECT user_id, count(*) FILTER (b) AS runs, (count(*) FILTER (f))::DOUBLE AS a, (count(*) FILTER (NOT f))::DOUBLE AS c FROM f GROUP BY user_id),
    t AS (SELECT *, a + c AS n, 2 * a * c AS ab, runs - (2 * a * c / (a + c) + 1) AS gap FROM m)
    SELECT user_id, runs, round(CASE WHEN n > 1 AND ab * (ab - n) > 0 THEN (CASE WHEN gap > 0 THEN gap - 0.5 ELSE gap + 0.5 END) / sqrt(ab * (ab - n) / (n * n * (n - 1))) END, 6) AS z FROM t"""
)
def runs_of_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", (F.col("value") > 50).alias("high"))
    return X.runs_test(e, "high", ["user_id"], ["ts"]).select("user_id", "runs", F.round("z", 6).alias("z"))


_PS = "(SELECT n_nationkey, (n_nationkey * n_nationkey + 1) / 5000.0::DOUBLE AS p FROM nation)"


@query(
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM {_PS})
    SELECT n_nationkey, round(least(1, p * n), 9) AS bonferroni, round(least(1, max(p * (n - i + 1)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING)), 9) AS holm,
    round(least(1, min(p * n / i) OVER (ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS fdr FROM o"""
)
def adjust_p_values(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "nation").select("n_nationkey", ((F.col("n_nationkey") * F.col("n_nationkey") + 1) / 5000.0).alias("p"))
    for m in ("bonferroni", "holm", "fdr"):
        p = X.adjust_p_values(p, "p", m, m)
    return p.select("n_nationkey", *[F.round(m, 9).alias(m) for m in ("bonferroni", "holm", "fdr")])


# --- graphs: nations that trade, and a directed graph over nations ---

_TRADE = "(SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE (s_nationkey + c_nationkey) % 3 = 1)"
_STEPS = "(SELECT n_nationkey AS src, (n_nationkey * n_nationkey + 1) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 2 = 0)"


def _trade(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name, *c: table(spark, sf, name).select(*c)
    lines = t("lineitem", "l_orderkey", "l_suppkey").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = lines.join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return both.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).where((F.col("src") + F.col("dst")) % 3 == 1).distinct()


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"))
    return n.select("src", ((F.col("src") * F.col("src") + 1) % 25).alias("dst")).union(n.where("src % 2 = 0").select("src", ((F.col("src") + 5) % 25).alias("dst"))).distinct()


@query(
    f"""WITH u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_TRADE} WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON x.a = z.a AND y.b = z.b)
    SELECT id, count(*) AS triangles FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id"""
)
def triangle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return G.triangles(_trade(spark, sf))


@query(
    f"""WITH RECURSIVE e AS {_STEPS}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
    SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""
)
def strongly_connected(spark: SparkSession, sf: str) -> DataFrame:
    return G.strongly_connected(_steps(spark, sf))


@query(
    f"""WITH e AS (SELECT DISTINCT * FROM (SELECT src, dst FROM {_STEPS} UNION ALL SELECT dst, src FROM {_STEPS}) WHERE src <> dst), v AS (SELECT src AS id FROM {_STEPS} UNION SELECT dst FROM {_STEPS}),
    a AS (SELECT id, coalesce((SELECT min(dst) FROM e WHERE src = id), id) AS label FROM v),
    w AS (SELECT src, label, count(*) AS n FROM e JOIN a ON dst = id GROUP BY 1, 2), b AS (SELECT src, arg_min(label, (-n, label)) AS label FROM w GROUP BY src)
    SELECT id, coalesce(b.label, a.label) AS label FROM a LEFT JOIN b ON id = src"""
)
def label_propagation_2(spark: SparkSession, sf: str) -> DataFrame:
    return G.label_propagation(_steps(spark, sf), rounds=2)


def _power(rounds: int) -> str:
    out = [f"e AS {_STEPS}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), x0 AS (SELECT id, 1 / sqrt(count(*) OVER ()) AS x FROM v)"]
    for k in range(rounds):
        out.append(f"y{k} AS (SELECT v.id, coalesce(sum(x), 0) AS x FROM v LEFT JOIN (e JOIN x{k} ON e.dst = x{k}.id) ON v.id = e.src GROUP BY v.id), x{k + 1} AS (SELECT id, x / sqrt(sum(x * x) OVER ()) AS x FROM y{k})")
    return f"WITH {', '.join(out)} SELECT id, round(x + 1e-9, 6) AS score FROM x{rounds}"


@query(_power(4))
def eigenvector_4(spark: SparkSession, sf: str) -> DataFrame:
    return G.eigenvector(_steps(spark, sf), rounds=4, tolerance=None).select("id", _rounded("score"))


@query(
    f"""WITH RECURSIVE e AS (SELECT src, dst, 1.0 + (src * 3 + dst * 7) % 11 AS weight FROM {_STEPS} WHERE src <> dst), p AS (SELECT 0 AS here, [0] AS path, 0.0::DOUBLE AS distance UNION ALL
    SELECT e.dst, list_append(path, e.dst), distance + e.weight FROM p JOIN e ON p.here = e.src WHERE p.here <> 7 AND NOT list_contains(path, e.dst))
    SELECT CAST(row_number() OVER (ORDER BY distance, path) AS INT) AS rank, distance, array_to_string(path, ',') AS path FROM p WHERE here = 7 ORDER BY distance, p.path LIMIT 3"""
)
def k_shortest_paths_3(spark: SparkSession, sf: str) -> DataFrame:
    e = _steps(spark, sf).withColumn("weight", 1.0 + (F.col("src") * 3 + F.col("dst") * 7) % 11)
    return S.k_shortest_paths(e, 0, 7, 3).select("rank", "distance", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query(f"SELECT id, count(*) AS n FROM (SELECT src AS id FROM {_TREE} UNION ALL SELECT dst FROM {_TREE}) GROUP BY id HAVING count(*) > 1")
def hubs_of_tree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_tree(spark, sf)).where("degree > 1").select("id", F.col("degree").alias("n"))
