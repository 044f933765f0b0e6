"""Queries of aggregates, groups, hierarchies and reshaping, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import reshape as R
from .registry import query, table


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 10")
def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return sums.orderBy(F.desc("spent"), "o_custkey").limit(10)


@query(
    """SELECT column_name, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3, max(v) AS max
    FROM (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem) GROUP BY column_name"""
)
def describe_columns(spark: SparkSession, sf: str) -> DataFrame:
    return A.describe_long(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])


@query("SELECT quantile_cont(value, 0.1) AS p10, median(value) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events")
def quantile_linear(spark: SparkSession, sf: str) -> DataFrame:
    q = A.quantile_linear("value", [0.1, 0.5, 0.9, 0.25, 0.75])
    return table(spark, sf, "events").agg(q.alias("q")).select(F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), (F.col("q")[4] - F.col("q")[3]).alias("iqr"))


@query("SELECT s[CAST(floor((len(s) - 1) * 0.1) AS INT) + 1] AS p0, s[CAST(floor((len(s) - 1) * 0.9) AS INT) + 1] AS p1 FROM (SELECT list(value ORDER BY value) AS s FROM events)")
def percentile_floor(spark: SparkSession, sf: str) -> DataFrame:
    return A.percentile_floor(table(spark, sf, "events"), "value", [0.1, 0.9])


@query("SELECT event_type, skewness(value) AS skew, kurtosis(value) AS kurt FROM events GROUP BY event_type")
def skew_kurt_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(A.skew_adjusted("value").alias("skew"), A.kurt_adjusted("value").alias("kurt"))


@query("SELECT event_type, stddev_samp(value) / sqrt(count(value)) AS sem, stddev_samp(value) / avg(value) AS cv, max(value) - min(value) AS rng FROM events GROUP BY event_type")
def sem_cv_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(A.sem("value").alias("sem"), A.coefficient_of_variation("value").alias("cv"), A.value_range("value").alias("rng"))


@query("SELECT p_brand, exp(avg(ln(p_size))) AS geo, count(*) / sum(1.0 / p_size) AS harm FROM part GROUP BY p_brand HAVING min(p_size) > 0")
def geo_harm_mean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(A.geometric_mean("p_size").alias("geo"), A.harmonic_mean("p_size").alias("harm")).where("geo is not null")


@query("SELECT avg(abs(value - m)) AS mad FROM events, (SELECT avg(value) AS m FROM events)")
def mad(spark: SparkSession, sf: str) -> DataFrame:
    return A.mean_absolute_deviation(table(spark, sf, "events"), "value")


@query("SELECT avg(value) AS trimmed_mean FROM (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) WHERE r > floor(n * 0.1) AND r <= n - floor(n * 0.1)")
def trimmed_mean(spark: SparkSession, sf: str) -> DataFrame:
    return A.trimmed_mean(table(spark, sf, "events"), "value", 0.1)


@query("SELECT p_size, n FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_size))")
def mode_all(spark: SparkSession, sf: str) -> DataFrame:
    return A.mode_all(table(spark, sf, "part"), "p_size")


@query("SELECT c_mktsegment, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY c_mktsegment")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(table(spark, sf, "customer"), "c_mktsegment", normalize=True)


@query("SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) AS n FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) GROUP BY bin")
def value_count_bins(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_count_bins(table(spark, sf, "customer"), "c_acctbal", 10)


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, bool_or(value > 99) AS any_big, bool_and(value >= 0) AS all_pos FROM events")
def nunique_any_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.bool_or(F.col("value") > 99).alias("any_big"), F.bool_and(F.col("value") >= 0).alias("all_pos"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS value FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_tax")))
def corr_matrix_long(spark: SparkSession, sf: str) -> DataFrame:
    return A.corr_long(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query("SELECT 'l_quantity' AS a, 'l_tax' AS b, covar_samp(l_quantity, l_tax) AS value FROM lineitem")
def cov_pair(spark: SparkSession, sf: str) -> DataFrame:
    return A.corr_long(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], covariance=True).where("a = 'l_quantity' and b = 'l_tax'")


@query("SELECT event_type, max(value) AS top, (list(event_id ORDER BY value DESC, event_id))[1] AS at FROM events GROUP BY event_type")
def idxmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.max("value").alias("top"), A.idxmax(table(spark, sf, "events"), "value", "event_id").alias("at"))


@query("SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS m, min(o_totalprice) AS lo, max(o_totalprice) AS hi, median(o_totalprice) AS md, count(DISTINCT o_custkey) AS nu FROM orders GROUP BY o_orderpriority")
def group_multi_agg(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("m"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.percentile("o_totalprice", F.lit(0.5)).alias("md"), F.countDistinct("o_custkey").alias("nu"))


@query("SELECT o_custkey, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(o_totalprice) END AS sd, CASE WHEN count(*) = 1 THEN 0.0 ELSE var_samp(o_totalprice) END AS vr FROM orders GROUP BY o_custkey")
def group_std_var_zero_single(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(A.std_zero_single("o_totalprice").alias("sd"), A.var_zero_single("o_totalprice").alias("vr"))


@query("SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS fst, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS lst FROM orders GROUP BY o_custkey")
def group_first_last(spark: SparkSession, sf: str) -> DataFrame:
    o = ["o_orderdate", "o_orderkey"]
    return table(spark, sf, "orders").groupBy("o_custkey").agg(A.first_by("o_totalprice", o).alias("fst"), A.last_by("o_totalprice", o).alias("lst"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15)")
def group_filter(spark: SparkSession, sf: str) -> DataFrame:
    return A.group_filter(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], F.count("*") > 15)


@query("SELECT event_type, sum(CASE WHEN value > 50 THEN value END) AS big, count(*) FILTER (value <= 50) AS n_small FROM events GROUP BY event_type")
def cond_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(F.when(F.col("value") > 50, F.col("value"))).alias("big"), F.count_if(F.col("value") <= 50).alias("n_small"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def crosstab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS k FROM conversations")
def cumcount(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", A.cumcount(["conv_id"], ["turn"]).alias("k"))


@query("SELECT r_name, n_name, CAST(CASE WHEN grouping(n_name) = 0 THEN 1 ELSE 0 END AS INT) AS rollup_level, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name) HAVING grouping(r_name) = 0")
def rollup_levels(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.rollup_levels(df, ["r_name", "n_name"], n=F.count("*"), bal=F.round(F.sum("c_acctbal"), 2))


@query("SELECT n_regionkey, n_nationkey, sum(c_acctbal) AS total, sum(c_acctbal) / sum(sum(c_acctbal)) OVER (PARTITION BY n_regionkey) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey")
def inter_level_ratio(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.share_of_parent(df, ["n_regionkey"], ["n_nationkey"], "c_acctbal")


# --- reshape ---


@query("SELECT l_orderkey, variable, value FROM (SELECT l_orderkey, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_tax))")
def melt(spark: SparkSession, sf: str) -> DataFrame:
    return R.melt(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_tax"])


@query("SELECT event_type, sum(value) FILTER (user_id % 3 = 0) AS \"0\", sum(value) FILTER (user_id % 3 = 1) AS \"1\", sum(value) FILTER (user_id % 3 = 2) AS \"2\" FROM events GROUP BY event_type")
def pivot_table_sum(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").withColumn("k", F.col("user_id") % 3)
    return R.pivot_table(df, ["event_type"], "k", F.sum("value"), [0, 1, 2])


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def unstack_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return R.unstack(table(spark, sf, "events"), ["user_id"], "event_type", "value", ["event_id"], ["click", "view"])


@query("SELECT p_partkey, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)")
def explode_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.explode_split(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", " ", "word").select("p_partkey", "word")


@query("SELECT 'r_name' AS column_name, max(r_name) FILTER (r_regionkey = 0) AS c0, max(r_name) FILTER (r_regionkey = 1) AS c1 FROM region")
def transpose_small(spark: SparkSession, sf: str) -> DataFrame:
    return R.transpose(table(spark, sf, "region").where("r_regionkey < 2"), "r_regionkey", ["r_name"], [0, 1], prefix="c")
