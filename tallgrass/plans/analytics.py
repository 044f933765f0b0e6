"""Queries of statistics and graphs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import stats as X
from .registry import query, table


@query(
    """SELECT (ma - mb) / sqrt(va + vb) AS t, (va + vb) * (va + vb) / (va * va / (na - 1) + vb * vb / (nb - 1)) AS dof FROM (SELECT avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'view') AS mb,
    var_samp(value) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'view') / count(*) FILTER (event_type = 'view') AS vb, count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb FROM events)"""
)
def ttest_welch(spark: SparkSession, sf: str) -> DataFrame:
    return X.welch_t(table(spark, sf, "events"), "value", "event_type", "click", "view")


@query(
    """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
    SELECT (b / (k - 1)) / (w / (n - k)) AS f FROM t"""
)
def anova_f(spark: SparkSession, sf: str) -> DataFrame:
    return X.anova_f(table(spark, sf, "events"), "value", "event_type")


@query(
    """WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb FROM n)
    SELECT sum(n) * (sum(n * n / (ra * rb)) - 1) AS chi2, sqrt((sum(n * n / (ra * rb)) - 1) / least(count(DISTINCT a) - 1, count(DISTINCT b) - 1)) AS cramers_v FROM w"""
)
def chi2_cramers_v(spark: SparkSession, sf: str) -> DataFrame:
    return X.chi2(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem")
def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    return X.ols_simple(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT o_orderkey FROM orders, (SELECT quantile_cont(o_totalprice, [0.25, 0.75]) AS q FROM orders) WHERE o_totalprice < q[1] - 0.5 * (q[2] - q[1]) OR o_totalprice > q[2] + 0.5 * (q[2] - q[1])")
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return X.iqr_outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.5).select("o_orderkey")


@query("SELECT avg((l_extendedprice - 1000 * l_quantity) ** 2) AS mse, avg(abs(l_extendedprice - 1000 * l_quantity)) AS mae, 1 - sum((l_extendedprice - 1000 * l_quantity) ** 2) / (var_pop(l_extendedprice) * count(*)) AS r2 FROM lineitem")
def mse_mae_r2(spark: SparkSession, sf: str) -> DataFrame:
    return X.regression_metrics(table(spark, sf, "lineitem").withColumn("guess", 1000 * F.col("l_quantity")), "l_extendedprice", "guess")


@query("SELECT (tp + tn) / n AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT count(*) AS n, count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality = 0) AS fn, count(*) FILTER (toxic = 0 AND quality = 0) AS tn FROM labels)")
def accuracy_precision_recall_f1(spark: SparkSession, sf: str) -> DataFrame:
    return X.classification_metrics(table(spark, sf, "labels"), "toxic", "quality")


_RANKED = "SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM events"


@query(
    f"""WITH x AS ({_RANKED.replace("FROM events", "FROM events WHERE event_type IN ('click', 'view')")}), m AS (SELECT sum(r) FILTER (event_type = 'click') AS r1, count(*) FILTER (event_type = 'click') AS n1, count(*) FILTER (event_type = 'view') AS n2 FROM x)
    SELECT r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2) AS u2, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u FROM m"""
)
def mannwhitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return X.mann_whitney(table(spark, sf, "events"), "value", "event_type", "click", "view").select("u1", "u2", "u")


@query(
    f"""SELECT round(12 * sum(r * r / n) / (sum(n) * (sum(n) + 1)) - 3 * (sum(n) + 1), 6) AS h, (count(*) - 1)::DOUBLE AS dof FROM (SELECT event_type, sum(r) AS r, count(*) AS n FROM ({_RANKED}) GROUP BY event_type)"""
)
def kruskal_h(spark: SparkSession, sf: str) -> DataFrame:
    return X.kruskal(table(spark, sf, "events"), "value", "event_type").select(F.round("h", 6).alias("h"), "dof")


@query(
    """WITH v AS (SELECT value, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY value), t AS (SELECT sum(a) AS na, sum(b) AS nb FROM v)
    SELECT round(max(abs(g)), 9) AS d FROM (SELECT sum(a) OVER w / na - sum(b) OVER w / nb AS g FROM v, t WINDOW w AS (ORDER BY value))"""
)
def ks_two_sample(spark: SparkSession, sf: str) -> DataFrame:
    return X.ks_two_sample(table(spark, sf, "events"), "value", "event_type", "click", "view").select(F.round("d", 9).alias("d"))


@query(
    """SELECT round(corr(a, b), 9) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
    rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)"""
)
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return X.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 9).alias("rho"))


@query(
    """WITH n AS (SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM n),
    ha AS (SELECT -sum(ra / t * ln(ra / t)) AS h FROM (SELECT DISTINCT a, ra, t FROM w)), hb AS (SELECT -sum(rb / t * ln(rb / t)) AS h FROM (SELECT DISTINCT b, rb, t FROM w)), m AS (SELECT sum(n / t * ln(n * t / (ra * rb))) AS mi FROM w)
    SELECT round(mi, 9) AS mi, round(mi / sqrt(ha.h * hb.h), 9) AS nmi FROM m, ha, hb"""
)
def mutual_info(spark: SparkSession, sf: str) -> DataFrame:
    return X.mutual_information(table(spark, sf, "part"), "p_brand", "p_type").select(F.round("mi", 9).alias("mi"), F.round("nmi", 9).alias("nmi"))


@query("SELECT round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))), 8) AS t, (count(value) - 1)::DOUBLE AS dof FROM events")
def ttest_one_sample(spark: SparkSession, sf: str) -> DataFrame:
    return X.one_sample_t(table(spark, sf, "events"), "value", 50.0).select(F.round("t", 8).alias("t"), "dof")


@query("SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, (count(d) - 1)::DOUBLE AS dof FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def ttest_paired(spark: SparkSession, sf: str) -> DataFrame:
    return X.paired_t(table(spark, sf, "lineitem"), "l_discount", "l_tax").select(F.round("t", 6).alias("t"), "dof")


@query("SELECT o_orderkey FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) > 1.5 * s")
def zscore_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return X.zscore_outliers(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5).select("o_orderkey")


@query("SELECT o_orderstatus, CAST(round(count(*) * 0.25) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def stratified_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.stratified_sample(table(spark, sf, "orders"), "o_orderstatus", 0.25, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# --- graphs: suppliers and the customers they deliver to; the tree of customers, suppliers, nations and regions ---

_EDGES = "(SELECT DISTINCT l_suppkey AS src, 10000000 + o_custkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_TREE = """(SELECT 10000000 + c_custkey AS src, CAST(1000 + c_nationkey AS BIGINT) AS dst, abs(c_acctbal) AS weight FROM customer
    UNION ALL SELECT 1000000 + s_suppkey, 1000 + s_nationkey, abs(s_acctbal) FROM supplier UNION ALL SELECT 1000 + n_nationkey, n_regionkey, 1.5::DOUBLE FROM nation)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("src"), (F.col("o_custkey") + 10_000_000).alias("dst")).distinct()


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda name, key, shift, up, base, weight: table(spark, sf, name).select((F.col(key) + shift).cast("long").alias("src"), (F.col(up) + base).cast("long").alias("dst"), weight.alias("weight"))
    customers = part("customer", "c_custkey", 10_000_000, "c_nationkey", 1000, F.abs("c_acctbal"))
    suppliers = part("supplier", "s_suppkey", 1_000_000, "s_nationkey", 1000, F.abs("s_acctbal"))
    return customers.union(suppliers).union(part("nation", "n_nationkey", 1000, "n_regionkey", 0, F.lit(1.5)))


@query(f"SELECT id, sum(o) AS out_degree, sum(i) AS in_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {_EDGES} UNION ALL SELECT dst, 0, 1 FROM {_EDGES}) GROUP BY id")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_edges(spark, sf))


@query(
    """WITH RECURSIVE e AS (SELECT o_custkey AS a, 10000000 + o_orderkey AS b FROM orders), u AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e), r AS (SELECT src AS id, src AS label FROM u UNION SELECT u.dst, r.label FROM r JOIN u ON r.id = u.src)
    SELECT id, min(label) AS component FROM r GROUP BY id"""
)
def components_min_label(spark: SparkSession, sf: str) -> DataFrame:
    return G.connected_components(table(spark, sf, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst")))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {_TREE} UNION SELECT dst, src FROM {_TREE}), r AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS level UNION SELECT e.dst, level + 1 FROM r JOIN e ON r.id = e.src WHERE level < 4)
    SELECT id, min(level) AS level FROM r GROUP BY id"""
)
def bfs_levels(spark: SparkSession, sf: str) -> DataFrame:
    return G.bfs_levels(_tree(spark, sf), 1, directed=False)


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_TREE}), r AS (SELECT CAST(1 AS BIGINT) AS id, 0.0::DOUBLE AS distance, CAST(NULL AS BIGINT) AS parent UNION ALL SELECT e.src, distance + weight, r.id FROM r JOIN e ON r.id = e.dst)
    SELECT id, distance, parent FROM r"""
)
def shortest_paths_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return G.shortest_paths(_tree(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), 1)


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_TREE}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id AS start, id, 0 AS d FROM v UNION SELECT r.start, e.dst, d + 1 FROM r JOIN e ON r.id = e.src)
    SELECT start AS id, coalesce((count(*) - 1) * (count(*) - 1) / nullif((SELECT count(*) - 1 FROM v) * sum(d), 0), 0)::DOUBLE AS closeness FROM r GROUP BY start"""
)
def closeness(spark: SparkSession, sf: str) -> DataFrame:
    return G.closeness(_tree(spark, sf))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_TREE}), r AS (SELECT src AS id, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM r JOIN e ON r.id = e.src)
    SELECT id, max(level) AS level FROM r GROUP BY id"""
)
def toposort_levels(spark: SparkSession, sf: str) -> DataFrame:
    return G.topological_levels(_tree(spark, sf))


_COMMUNITY = """(SELECT 10000000 + c_custkey AS id, n_regionkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 1000000 + s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 1000 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT r_regionkey, r_regionkey FROM region)"""


@query(
    f"""WITH c AS ({_COMMUNITY}), u AS (SELECT src, dst FROM {_TREE} UNION SELECT dst, src FROM {_TREE}), s AS (SELECT a.c, count(*) AS k, count(*) FILTER (a.c = b.c) AS inside FROM u JOIN c a ON a.id = u.src JOIN c b ON b.id = u.dst GROUP BY a.c)
    SELECT round(sum(inside / (SELECT sum(k) FROM s) - (k / (SELECT sum(k) FROM s)) ** 2), 10) AS q FROM s"""
)
def modularity_given(spark: SparkSession, sf: str) -> DataFrame:
    n, region = table(spark, sf, "nation"), table(spark, sf, "region")
    by_nation = lambda name, key, up, shift: table(spark, sf, name).join(n, F.col(up) == F.col("n_nationkey")).select((F.col(key) + shift).alias("id"), F.col("n_regionkey").alias("community"))
    given = by_nation("customer", "c_custkey", "c_nationkey", 10_000_000).union(by_nation("supplier", "s_suppkey", "s_nationkey", 1_000_000))
    given = given.union(n.select(F.col("n_nationkey") + 1000, "n_regionkey")).union(region.select("r_regionkey", "r_regionkey"))
    return G.modularity(_tree(spark, sf), given).select(F.round("q", 10).alias("q"))


@query(
    f"""WITH e AS MATERIALIZED (SELECT * FROM {_EDGES}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), k1 AS (SELECT id, 1.0::DOUBLE AS x FROM v),
    k2 AS MATERIALIZED (SELECT id, 1.0 + 0.1 * coalesce(s, 0) AS x FROM v LEFT JOIN (SELECT src, sum(x) AS s FROM e JOIN k1 ON dst = id GROUP BY src) ON src = id),
    k3 AS (SELECT id, 1.0 + 0.1 * coalesce(s, 0) AS x FROM v LEFT JOIN (SELECT src, sum(x) AS s FROM e JOIN k2 ON dst = id GROUP BY src) ON src = id)
    SELECT id, round(x / max(x) OVER (), 10) AS score FROM k3"""
)
def katz_k(spark: SparkSession, sf: str) -> DataFrame:
    return G.katz(_edges(spark, sf), rounds=3, tolerance=None).select("id", F.round("score", 10).alias("score"))


@query(
    f"""WITH e AS MATERIALIZED (SELECT * FROM {_EDGES}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
    a1 AS (SELECT dst AS id, count(*) AS x FROM e GROUP BY dst), h1 AS MATERIALIZED (SELECT src AS id, sum(x) AS x FROM e JOIN a1 ON a1.id = dst GROUP BY src),
    a2 AS MATERIALIZED (SELECT dst AS id, sum(x) AS x FROM e JOIN h1 ON h1.id = src GROUP BY dst), h2 AS (SELECT src AS id, sum(x) AS x FROM e JOIN a2 ON a2.id = dst GROUP BY src)
    SELECT v.id, round(coalesce(h2.x / (SELECT sqrt(sum(x::DOUBLE * x)) FROM h2), 0), 9) AS hub, round(coalesce(a2.x / (SELECT sqrt(sum(x::DOUBLE * x)) FROM a2), 0), 9) AS authority FROM v LEFT JOIN h2 ON h2.id = v.id LEFT JOIN a2 ON a2.id = v.id"""
)
def hits_k(spark: SparkSession, sf: str) -> DataFrame:
    return G.hits(_edges(spark, sf), rounds=2, tolerance=None).select("id", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {_EDGES}), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), k AS (SELECT src, count(*) AS k FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM v),
    r1 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n),
    r2 AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / k) AS got FROM e JOIN k USING (src) JOIN r1 ON r1.id = e.src GROUP BY dst) g ON g.dst = v.id, n, (SELECT coalesce(sum(rank), 0) AS lost FROM r1 WHERE id NOT IN (SELECT src FROM k))),
    r3 AS (SELECT v.id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM v LEFT JOIN (SELECT dst, sum(rank / k) AS got FROM e JOIN k USING (src) JOIN r2 ON r2.id = e.src GROUP BY dst) g ON g.dst = v.id, n, (SELECT coalesce(sum(rank), 0) AS lost FROM r2 WHERE id NOT IN (SELECT src FROM k)))
    SELECT id, round(rank, 10) AS rank FROM r3"""
)
def pagerank_k(spark: SparkSession, sf: str) -> DataFrame:
    return G.pagerank(_edges(spark, sf), rounds=2).select("id", F.round("rank", 10).alias("rank"))
