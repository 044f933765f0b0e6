"""Queries of positions, joins with clashing names, forecasts and further windows, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import combine as M
from ..operators import forecast as FC
from ..operators import labels as L
from ..operators import ml as ML
from ..operators import timeseries as T
from ..operators.columns import zscore
from .registry import query, table

#: Added before rounding, here and in the SQL, so that halves fall alike.
NUDGE = 1e-9
_W = "PARTITION BY user_id ORDER BY ts"
U, O_ = ["user_id"], ["ts"]


def _r(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c) + NUDGE, digits).alias(c)


@query("SELECT event_id, position FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events) WHERE position IN (0, 5, 77)")
def take_positions(spark: SparkSession, sf: str) -> DataFrame:
    return A.take(table(spark, sf, "events").select("event_id"), "event_id", [0, 5, 77])


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events) WHERE position NOT IN (1, 3)")
def drop_positions(spark: SparkSession, sf: str) -> DataFrame:
    return A.drop_rows(table(spark, sf, "events").select("event_id"), "event_id", [1, 3])


@query("SELECT min(event_id) AS first_at, arg_min(v, event_id) AS first_value, max(event_id) AS last_at, arg_max(v, event_id) AS last_value FROM (SELECT event_id, value AS v FROM events WHERE event_type = 'click')")
def first_last_valid(spark: SparkSession, sf: str) -> DataFrame:
    return A.valid_ends(table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") == "click", F.col("value"))), "v", "event_id")


@query("SELECT 'o_orderkey' AS \"column\", 'bigint' AS type, count(*) AS present, 0::BIGINT AS missing FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority), count(*) - count(o_orderpriority) FROM orders")
def frame_info(spark: SparkSession, sf: str) -> DataFrame:
    return A.info(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


@query("SELECT s_suppkey, s_name, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
def join_diff_keys(spark: SparkSession, sf: str) -> DataFrame:
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.join(c, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") == F.col("c_custkey"))).select("s_suppkey", "s_name", "c_custkey")


@query("SELECT a.n_nationkey AS k, a.n_name AS name_x, r_name AS name_y FROM nation a JOIN region ON n_nationkey = r_regionkey")
def join_clash_suffix(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return M.merge(n, r, on=["k"])


@query("SELECT user_id, median(value) AS med, count(DISTINCT event_type) AS types FROM events GROUP BY user_id")
def group_median_nunique(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.percentile("value", F.lit(0.5)).alias("med"), F.countDistinct("event_type").alias("types"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w + 1e-9, 6) AS z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
def group_transform_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(zscore("o_totalprice", "o_orderpriority") + NUDGE, 6).alias("z"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) + 1e-9, 6) AS p_retailprice, (p_size - (SELECT min(p_size) FROM part)) / (SELECT max(p_size) - min(p_size) FROM part) AS p_size FROM part")
def standard_minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    scaled = ML.standard_scale(ML.minmax_scale(table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size"), ["p_size"]), ["p_retailprice"])
    return scaled.select("p_partkey", _r("p_retailprice"), "p_size")


@query("SELECT k AS brand, count(p_partkey) AS n FROM (VALUES ('Brand#11'), ('Brand#12'), ('none')) t(k) LEFT JOIN part ON p_brand = k GROUP BY k")
def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return L.category_counts(table(spark, sf, "part"), "p_brand", ["Brand#11", "Brand#12", "none"]).withColumnRenamed("p_brand", "brand")


@query("SELECT c_custkey, CASE WHEN c_acctbal > -1000 AND c_acctbal <= 0 THEN 0 WHEN c_acctbal > 0 AND c_acctbal <= 5000 THEN 1 WHEN c_acctbal > 5000 AND c_acctbal <= 10000 THEN 2 END AS i FROM customer")
def interval_index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", L.interval_index(F.col("c_acctbal"), [-1000, 0, 5000, 10000]).alias("i"))


@query(
    f"""WITH a AS (SELECT event_id, user_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS trend, (row_number() OVER ({_W}) - 1) % 4 AS ph FROM events),
    m AS (SELECT user_id, ph, avg(value - trend) AS m FROM a GROUP BY ALL), s AS (SELECT user_id, ph, m - avg(m) OVER (PARTITION BY user_id) AS seasonal FROM m)
    SELECT event_id, round(trend + 1e-9, 6) AS trend, round(seasonal + 1e-9, 6) AS seasonal, round(value - trend - seasonal + 1e-9, 6) AS residual FROM a JOIN s USING (user_id, ph)"""
)
def decompose_additive(spark: SparkSession, sf: str) -> DataFrame:
    return T.decompose_additive(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "value", U, O_, 4).select("event_id", _r("trend"), _r("seasonal"), _r("residual"))


@query(f"SELECT event_id, round(sum(d) OVER ({_W} ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS cusum FROM (SELECT *, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events)")
def cusum(spark: SparkSession, sf: str) -> DataFrame:
    return T.cusum(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "value", U, O_).select("event_id", _r("cusum"))


@query(
    f"""WITH RECURSIVE n AS (SELECT user_id, ts, row_number() OVER ({_W}) AS i FROM events),
    r AS (SELECT user_id, ts, i, ts AS start FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.ts, n.i, CASE WHEN n.ts - r.ts > INTERVAL 6 HOUR OR n.ts - r.start > INTERVAL 12 HOUR THEN n.ts ELSE r.start END FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
    SELECT user_id, start, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, start"""
)
def session_max_duration(spark: SparkSession, sf: str) -> DataFrame:
    got = T.sessions_limited(table(spark, sf, "events"), "ts", U, 6 * 3600, 12 * 3600)
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("SELECT count(*) AS n, round(sum(value), 4) AS total, round(stddev_pop(value), 6) AS std FROM events")
def global_window(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("SELECT start, event_type, s[CAST(round(0.9 * (len(s) - 1)) AS INT) + 1] AS p90 FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, list(value ORDER BY value) AS s FROM events GROUP BY ALL)")
def window_percentile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return T.tumbling(table(spark, sf, "events"), "ts", "1 day", ["event_type"], p90=T.percentile_nearest("value", 0.9))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def multi_column_window(spark: SparkSession, sf: str) -> DataFrame:
    df = T.tumbling(table(spark, sf, "events"), "ts", "6 hours", [], total=F.sum("value"), users=F.countDistinct("user_id"))
    return df.withColumn("total", F.round("total", 4))


@query(f"SELECT user_id, step, round(avg(value) + 1e-9, 6) AS forecast FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events), (SELECT unnest([1, 2]) AS step) WHERE k <= 5 GROUP BY user_id, step")
def forecast_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return FC.moving_average(table(spark, sf, "events"), U, O_, "value", 5, 2).select("user_id", "step", _r("forecast"))


@query(
    f"""SELECT user_id, step, round(coalesce(a * (n + step) + b, m) + 1e-9, 6) AS forecast FROM (SELECT user_id, regr_slope(value, t) AS a, regr_intercept(value, t) AS b, count(*) AS n, avg(value) AS m
    FROM (SELECT user_id, value, row_number() OVER ({_W}) AS t FROM events) GROUP BY user_id), (SELECT unnest([1, 2, 3]) AS step)"""
)
def forecast_linear_trend(spark: SparkSession, sf: str) -> DataFrame:
    return FC.linear_trend(table(spark, sf, "events"), U, O_, "value", 3).select("user_id", "step", _r("forecast"))


@query(
    f"""WITH RECURSIVE n AS (SELECT user_id, value, row_number() OVER ({_W}) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    r AS (SELECT user_id, i, n, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.n, 0.25 * n.value + 0.75 * r.y FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
    SELECT user_id, 1 AS step, round(y + 1e-9, 6) AS forecast FROM r WHERE i = n"""
)
def forecast_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    return FC.exponential_smoothing(table(spark, sf, "events").select("user_id", "ts", "value"), U, O_, "value", 1, alpha=0.25).select("user_id", "step", _r("forecast"))


@query(
    f"""WITH a AS (SELECT user_id, ts, value, row_number() OVER ({_W}) AS t, value - lag(value) OVER ({_W}) AS d, value > avg(value) OVER (PARTITION BY user_id) AS up FROM events),
    b AS (SELECT *, CASE WHEN up <> lag(up) OVER ({_W}) THEN 1 ELSE 0 END AS c FROM a)
    SELECT user_id, count(*) AS n, min(value) AS min, max(value) AS max, round(regr_slope(value, t) + 1e-9, 6) AS slope, round(avg(d) + 1e-9, 6) AS mean_change, round(avg(abs(d)) + 1e-9, 6) AS mean_abs_change, count(*) FILTER (up) AS above_mean, CAST(sum(c) AS BIGINT) AS crossings FROM b GROUP BY user_id"""
)
def series_features(spark: SparkSession, sf: str) -> DataFrame:
    return FC.features(table(spark, sf, "events"), U, O_, "value").select("user_id", "n", "min", "max", _r("slope"), _r("mean_change"), _r("mean_abs_change"), "above_mean", "crossings")
