"""Queries of joins, sets, order, windows and time series, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import columns as C
from ..operators import combine as M
from ..operators import timeseries as T
from ..operators import windows as W
from .registry import query, table

#: Added before rounding, here and in the SQL: means of cents fall on halves, which the engines round apart.
NUDGE = 1e-9
GAP = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"
U, O_ = ["user_id"], ["ts"]
WIN = "PARTITION BY user_id ORDER BY ts"


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return M.merge(table(spark, sf, "supplier"), table(spark, sf, "nation"), left_on=["s_nationkey"], right_on=["n_nationkey"]).select("s_suppkey", "s_name", "n_name")


@query("SELECT documents.doc_id, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id")
def join_left_fill(spark: SparkSession, sf: str) -> DataFrame:
    out = M.merge(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), on=["doc_id"], how="left")
    return C.fillna(out, "toxic", 0).select("doc_id", "toxic")


@query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    out = M.merge(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), table(spark, sf, "customer").select("c_custkey"), how="right", left_on=["o_custkey"], right_on=["c_custkey"])
    return out.withColumnRenamed("o_custkey", "c_custkey")


@query("SELECT coalesce(a.k, b.k) AS k, a.v AS v_x, b.v AS v_y FROM (SELECT s_nationkey AS k, count(*) AS v FROM supplier WHERE s_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS v FROM customer WHERE c_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def merge_outer_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").where("s_nationkey < 15").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v"))
    b = table(spark, sf, "customer").where("c_nationkey > 5").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v"))
    return M.merge(a, b, on=["k"], how="outer")


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def lookup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return M.lookup(e.select("user_id").distinct(), "user_id", e, "user_id", "event_type", ["event_id"], "last_type")


@query("SELECT c_custkey, 'c_acctbal' AS column_name, CAST(c_custkey % 10 AS VARCHAR) AS left_value, CAST(c_nationkey % 10 AS VARCHAR) AS right_value FROM customer WHERE c_custkey % 10 <> c_nationkey % 10")
def compare_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    a, b = c.select("c_custkey", (F.col("c_custkey") % 10).alias("c_acctbal")), c.select("c_custkey", (F.col("c_nationkey") % 10).alias("c_acctbal"))
    return M.compare(a, b, "c_custkey", ["c_acctbal"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    new = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"))
    return M.update(c.select("c_custkey", "c_acctbal"), new, "c_custkey", ["c_acctbal"])


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return M.union_distinct(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf, "customer").select("c_nationkey"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def intersect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, sf, "nation").where("n_regionkey = 1").select("n_nationkey"))


@query('SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0')
def except_(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@query("SELECT k, name, extra FROM (SELECT r_regionkey AS k, r_name AS name, NULL AS extra FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation)")
def concat_rows(spark: SparkSession, sf: str) -> DataFrame:
    return M.concat_rows(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("extra")))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def distinct_subset_first(spark: SparkSession, sf: str) -> DataFrame:
    return M.distinct_subset(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def distinct_subset_last(spark: SparkSession, sf: str) -> DataFrame:
    return M.distinct_subset(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "last")


@query("SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AS dup, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS later FROM documents")
def duplicated(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.select("doc_id", M.duplicated(["h"], ["doc_id"], keep=False).alias("dup"), M.duplicated(["h"], ["doc_id"]).alias("later"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def nlargest(spark: SparkSession, sf: str) -> DataFrame:
    return M.nlargest(table(spark, sf, "orders"), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def nsmallest(spark: SparkSession, sf: str) -> DataFrame:
    return M.nsmallest(table(spark, sf, "orders"), 25, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    """SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r_avg, CAST(rank() OVER (ORDER BY p_size) AS DOUBLE) AS r_min,
    CAST(rank() OVER (ORDER BY p_size) + count(*) OVER (PARTITION BY p_size) - 1 AS DOUBLE) AS r_max, CAST(dense_rank() OVER (ORDER BY p_size) AS DOUBLE) AS r_dense, CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS DOUBLE) AS r_first FROM part"""
)
def rank_methods(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    for m, out in (("average", "r_avg"), ("min", "r_min"), ("max", "r_max"), ("dense", "r_dense")):
        df = M.rank(df, "p_size", out, m)
    return M.rank(df, "p_size", "r_first", "first", ties=["p_partkey"]).drop("p_size")


@query("SELECT event_id, (rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2) / count(*) OVER (PARTITION BY user_id) AS pr FROM events")
def pct_rank_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return M.rank(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", "pr", "average", by=U, pct=True).select("event_id", "pr")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_per_group(table(spark, sf, "events").select("user_id", "event_id", "value"), U, [F.desc("value"), F.asc("event_id")], 2).select("user_id", "event_id")


# --- windows ---


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.expr(GAP).alias("v"), "value")


_SRC = f"(SELECT event_id, user_id, ts, {GAP} AS v, value FROM events)"


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN sum(v) OVER w END AS cs, CASE WHEN v IS NOT NULL THEN max(v) OVER w END AS mx, CASE WHEN v IS NOT NULL THEN min(v) OVER w END AS mn FROM {_SRC} WINDOW w AS ({WIN} ROWS UNBOUNDED PRECEDING)")
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", W.cumsum("v", U, O_).alias("cs"), W.cummax("v", U, O_).alias("mx"), W.cummin("v", U, O_).alias("mn"))


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN product(1 + v / 1000) OVER ({WIN} ROWS UNBOUNDED PRECEDING) END AS cp FROM {_SRC}")
def cumprod(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).withColumn("g", 1 + F.col("v") / 1000).select("event_id", W.cumprod("g", U, O_).alias("cp"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def cumsum_global(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    return W.cumulative_global(df, "value", "t", "running").select("event_id", F.round("running", 4).alias("running"))


@query(f"SELECT event_id, lag(value, 2) OVER w AS lg, lead(value, 1) OVER w AS ld, value - lag(value, 1) OVER w AS df, (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) AS pc FROM events WINDOW w AS ({WIN})")
def shift_diff_pct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", W.shift("value", 2, U, O_).alias("lg"), W.shift("value", -1, U, O_).alias("ld"), W.diff("value", 1, U, O_).alias("df"), W.pct_change("value", 1, U, O_).alias("pc"))


@query(f"SELECT event_id, last_value(v IGNORE NULLS) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS ff, first_value(v IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM {_SRC}")
def ffill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", W.ffill("v", U, O_).alias("ff"), W.bfill("v", U, O_).alias("bf"))


@query(
    f"""WITH n AS (SELECT *, row_number() OVER ({WIN}) AS i FROM {_SRC}),
    k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS bi, last_value(v IGNORE NULLS) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS bv,
    first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai, first_value(v IGNORE NULLS) OVER ({WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM n)
    SELECT event_id, coalesce(v, bv + (av - bv) * (i - bi) / nullif(ai - bi, 0)) AS filled FROM k"""
)
def interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    return W.interpolate(_events(spark, sf), "v", U, O_, "filled").select("event_id", "filled")


_ROLL = {"sum": "sum(v)", "mean": "avg(v)", "min": "min(v)", "max": "max(v)", "std": "stddev_samp(v)", "var": "var_samp(v)", "median": "median(v)", "count": "count(v)"}


@query(f"SELECT event_id, {', '.join(f'CASE WHEN count(v) OVER w >= 2 THEN round({e} OVER w, 6) END AS r_{k}' for k, e in _ROLL.items())} FROM {_SRC} WINDOW w AS ({WIN} ROWS 3 PRECEDING)")
def rolling_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", *[F.round(W.rolling("v", k, 4, U, O_, 2), 6).alias(f"r_{k}") for k in _ROLL])


@query(f"SELECT event_id, CASE WHEN count(value) OVER c >= 3 THEN round(avg(value) OVER c, 6) END AS c3, CASE WHEN count(value) OVER w >= 5 THEN round(quantile_cont(value, 0.25) OVER w, 6) END AS q25 FROM events WINDOW c AS ({WIN} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), w AS ({WIN} ROWS 4 PRECEDING)")
def rolling_center_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(W.rolling("value", "mean", 3, U, O_, center=True), 6).alias("c3"), F.round(W.rolling("value", "quantile", 5, U, O_, q=0.25), 6).alias("q25"))


@query(f"SELECT event_id, {', '.join(f'CASE WHEN count(v) OVER w >= 2 THEN round({_ROLL[k]} OVER w + 1e-9, 6) END AS e_{k}' for k in ('sum', 'mean', 'std', 'min', 'max'))} FROM {_SRC} WINDOW w AS ({WIN} ROWS UNBOUNDED PRECEDING)")
def expanding_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", *[F.round(W.expanding("v", k, U, O_, 2) + NUDGE, 6).alias(f"e_{k}") for k in ("sum", "mean", "std", "min", "max")])


@query("SELECT event_id, round(sum(value) OVER w, 6) AS s, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)")
def rolling_time_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(W.rolling_time("value", "sum", 86400, U, "ts"), 6).alias("s"), W.rolling_time("value", "count", 86400, U, "ts").alias("n"))


@query(
    f"""WITH RECURSIVE n AS (SELECT event_id, user_id, value, row_number() OVER ({WIN}) AS i FROM events),
    r AS (SELECT event_id, user_id, i, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.user_id, n.i, 0.5 * n.value + 0.5 * r.y FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
    SELECT event_id, round(y + 1e-9, 6) AS ewm FROM r"""
)
def ewm_by_group(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return W.ewm(df, "value", U, O_, "ewm", alpha=0.5).select("event_id", F.round(F.col("ewm") + NUDGE, 6).alias("ewm"))


@query(f"SELECT event_id, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, percent_rank() OVER v AS pr, ntile(4) OVER w AS nt, nth_value(value, 2) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2 FROM events WINDOW w AS ({WIN}), v AS (PARTITION BY user_id ORDER BY event_type)")
def sql_window_functions(spark: SparkSession, sf: str) -> DataFrame:
    w, v = Window.partitionBy("user_id").orderBy("ts"), Window.partitionBy("user_id").orderBy("event_type")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf, "events").select("event_id", F.row_number().over(w).cast("long").alias("rn"), F.rank().over(v).cast("long").alias("rk"), F.dense_rank().over(v).cast("long").alias("dr"), F.percent_rank().over(v).alias("pr"), F.ntile(4).over(w).cast("long").alias("nt"), F.nth_value("value", 2).over(whole).alias("n2"))


@query("SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS z, round((value - min(value) OVER (PARTITION BY event_type)) / (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type)), 6) AS mm FROM events")
def zscore_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(C.zscore("value", "event_type"), 6).alias("z"), F.round(C.minmax("value", "event_type"), 6).alias("mm"))


# --- time series and windows of streams (batch form) ---


@query("SELECT CAST(floor((epoch_us(ts) - t0) / 86400000000) AS BIGINT) AS bucket, avg(value) AS m, sum(value) AS s, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events, (SELECT min(epoch_us(ts)) AS t0 FROM events) GROUP BY bucket")
def resample_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return T.resample_anchored(table(spark, sf, "events"), "ts", 86400, m=F.avg("value"), s=F.sum("value"), lo=F.min("value"), hi=F.max("value"), n=F.count("*"))


@query("SELECT date_trunc('month', o_orderdate) AS period, sum(o_totalprice) AS total FROM orders GROUP BY period")
def resample_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return T.resample_calendar(table(spark, sf, "orders"), "o_orderdate", "month", total=F.sum("o_totalprice"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return T.tumbling(table(spark, sf, "events"), "ts", "6 hours", ["event_type"], n=F.count("*"), s=F.sum("value"))


@query("SELECT b + INTERVAL (k) HOUR - INTERVAL 3 HOUR AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY start")
def sliding(spark: SparkSession, sf: str) -> DataFrame:
    return T.sliding(table(spark, sf, "events"), "ts", "4 hours", "1 hour", [], n=F.count("*"))


@query(f"SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER ({WIN} ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER ({WIN}) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid")
def session_gap(spark: SparkSession, sf: str) -> DataFrame:
    return T.sessions(table(spark, sf, "events"), "ts", "12 hours", U, last=F.max("ts"), n=F.count("*"))


@query(f"SELECT user_id, CAST((r - 1) // 5 AS BIGINT) AS w, count(*) AS n, sum(value) AS s FROM (SELECT *, row_number() OVER ({WIN}) AS r FROM events) GROUP BY ALL")
def count_window(spark: SparkSession, sf: str) -> DataFrame:
    return T.count_windows(table(spark, sf, "events"), U, O_, 5, n=F.count("*"), s=F.sum("value"))


@query("SELECT user_id, regr_slope(value, epoch_us(ts) / 1e6) * 86400 AS slope, corr(value, epoch_us(ts) / 1e6) AS r FROM events GROUP BY user_id")
def trend_slope(spark: SparkSession, sf: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").withColumn("t", t).groupBy("user_id").agg((F.regr_slope("value", "t") * 86400).alias("slope"), F.corr("value", "t").alias("r"))


@query(f"WITH n AS (SELECT value - avg(value) OVER () AS d, row_number() OVER (ORDER BY ts) AS i FROM events), v AS (SELECT sum(d * d) AS v FROM n) {' UNION ALL '.join(f'SELECT {k} AS lag, round((SELECT sum(a.d * b.d) FROM n a JOIN n b ON a.i = b.i + {k}) / v, 8) AS acf FROM v' for k in (1, 2, 3))}")
def acf_lags(spark: SparkSession, sf: str) -> DataFrame:
    return T.acf(table(spark, sf, "events"), "value", ["ts"], [1, 2, 3]).select("lag", F.round("acf", 8).alias("acf"))
