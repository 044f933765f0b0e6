"""Queries of series diagnostics and of the structure of graphs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as X
from ..operators import forecast as FC
from ..operators import structure as G
from .registry import query, table

#: Added before rounding, here and in the SQL, so that halves fall alike.
NUDGE = 1e-9
_W = "PARTITION BY user_id ORDER BY ts"
U, O_ = ["user_id"], ["ts"]


def _r(c: str, digits: int = 6) -> Column:
    return F.round(F.col(c) + NUDGE, digits).alias(c)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "value")


_DRIFT = f"""WITH s AS (SELECT user_id, avg(d) AS m, stddev_pop(d) AS s, count(*) AS n FROM (SELECT user_id, value - lag(value) OVER ({_W}) AS d FROM events) GROUP BY user_id HAVING count(*) >= 10),
    t AS (SELECT user_id, n, CASE WHEN s > 0 THEN m / (s / sqrt(n - 1)) ELSE 0 END AS t FROM s)"""


@query(
    f"""{_DRIFT} SELECT user_id, round(t + 1e-9, 6) AS statistic, CAST(floor(cbrt(n) * 0.12) AS BIGINT) AS n_lags,
    CAST(CASE WHEN t < -3.43 THEN 0.01 WHEN t < -2.86 THEN 0.05 WHEN t < -2.57 THEN 0.1 ELSE 0.2 END AS DOUBLE) AS p, t < -2.86 AS is_stationary FROM t"""
)
def stationarity_drift(spark: SparkSession, sf: str) -> DataFrame:
    return X.drift_test(_events(spark, sf), U, O_, "value").select("user_id", _r("statistic"), "n_lags", "p", "is_stationary")


@query(f"{_DRIFT} SELECT user_id, round(t * 0.95 + 1e-9, 6) AS statistic, t * 0.95 < -2.86 AS is_stationary FROM t")
def stationarity_phillips_perron(spark: SparkSession, sf: str) -> DataFrame:
    return X.drift_test(_events(spark, sf), U, O_, "value", scale=0.95).select("user_id", _r("statistic"), "is_stationary")


def _kpss_sql(fit: str, one: float, five: float, ten: float) -> str:
    return f"""WITH a AS (SELECT user_id, ts, value, row_number() OVER ({_W}) - 1 AS t FROM events),
    g AS (SELECT user_id, avg(value) AS m, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM a GROUP BY user_id HAVING count(*) >= 10),
    e AS (SELECT user_id, ts, value - ({fit}) AS e FROM a JOIN g USING (user_id)),
    q AS (SELECT user_id, e, sum(e) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS s FROM e),
    k AS (SELECT user_id, sum(s * s) / (count(*) * sum(e * e)) AS k FROM q GROUP BY user_id)
    SELECT user_id, round(k + 1e-9, 6) AS statistic, CAST(CASE WHEN k > {one} THEN 0.01 WHEN k > {five} THEN 0.05 WHEN k > {ten} THEN 0.1 ELSE 0.15 END AS DOUBLE) AS p, k < {five} AS is_stationary FROM k"""


@query(_kpss_sql("m", 0.739, 0.463, 0.347))
def stationarity_kpss(spark: SparkSession, sf: str) -> DataFrame:
    return X.kpss(_events(spark, sf), U, O_, "value").select("user_id", _r("statistic"), "p", "is_stationary")


@query(_kpss_sql("a * t + b", 0.216, 0.146, 0.119))
def stationarity_kpss_linear(spark: SparkSession, sf: str) -> DataFrame:
    return X.kpss(_events(spark, sf), U, O_, "value", "linear").select("user_id", _r("statistic"), "p", "is_stationary")


_LAGS = 5


@query(
    f"""WITH e AS (SELECT user_id, ts, value - avg(value) OVER (PARTITION BY user_id) AS e FROM events),
    p AS (SELECT user_id, count(*) AS n, {", ".join(f"coalesce(sum(p{k}), 0) / sum(e * e) AS r{k}" for k in range(1, _LAGS + 1))}
    FROM (SELECT user_id, e, {", ".join(f"e * lag(e, {k}) OVER ({_W}) AS p{k}" for k in range(1, _LAGS + 1))} FROM e) GROUP BY user_id HAVING count(*) >= 10)
    SELECT user_id, round(n * (n + 2) * ({" + ".join(f"r{k} * r{k} / (n - {k})" for k in range(1, _LAGS + 1))}) + 1e-9, 6) AS ljung_box,
    round(n * ({" + ".join(f"r{k} * r{k}" for k in range(1, _LAGS + 1))}) + 1e-9, 6) AS box_pierce FROM p"""
)
def ljung_box(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf)
    long = df.groupBy("user_id").agg(F.count("value").alias("n")).where("n >= 10").select("user_id")
    return X.portmanteau(df, U, O_, "value", _LAGS).join(long, "user_id").select("user_id", _r("ljung_box"), _r("box_pierce"))


@query(
    f"""SELECT user_id, round(CASE WHEN var_pop(value) > 0 THEN sum(d * d) / (var_pop(value) * count(*)) ELSE 2 END + 1e-9, 6) AS statistic
    FROM (SELECT user_id, value, value - lag(value) OVER ({_W}) AS d FROM events) GROUP BY user_id HAVING count(*) >= 3"""
)
def durbin_watson(spark: SparkSession, sf: str) -> DataFrame:
    return X.durbin_watson(_events(spark, sf), U, O_, "value").select("user_id", _r("statistic"))


@query(
    """WITH z AS (SELECT event_type, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events),
    s AS (SELECT event_type, count(*) AS n, avg(z * z * z) AS s, avg(z * z * z * z) - 3 AS k FROM z GROUP BY event_type)
    SELECT event_type, round(s + 1e-9, 6) AS skewness, round(k + 1e-9, 6) AS kurtosis, round(n / 6 * (s * s + k * k / 4) + 1e-9, 4) AS statistic FROM s"""
)
def jarque_bera(spark: SparkSession, sf: str) -> DataFrame:
    return X.jarque_bera(table(spark, sf, "events"), ["event_type"], "value").select("event_type", _r("skewness"), _r("kurtosis"), _r("statistic", 4))


@query(
    """WITH s AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(value) > 0 THEN greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_pop(value) ELSE 0 END AS z FROM events GROUP BY user_id)
    SELECT user_id, round(z + 1e-9, 6) AS statistic, CAST(CASE WHEN n < 3 THEN 0 WHEN n <= 10 THEN 2.2 WHEN n <= 20 THEN 2.5 WHEN n <= 50 THEN 2.8 ELSE 3 END AS DOUBLE) AS critical,
    z > CASE WHEN n < 3 THEN 0 WHEN n <= 10 THEN 2.2 WHEN n <= 20 THEN 2.5 WHEN n <= 50 THEN 2.8 ELSE 3 END AS has_outlier FROM s"""
)
def grubbs_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return X.grubbs(table(spark, sf, "events"), U, "value").select("user_id", _r("statistic"), "critical", "has_outlier")


@query(
    """WITH m AS (SELECT user_id, median(value) AS m FROM events GROUP BY user_id), a AS (SELECT user_id, median(abs(value - m)) AS d FROM events JOIN m USING (user_id) GROUP BY user_id)
    SELECT event_id, round(CASE WHEN d > 0 THEN 0.6745 * (value - m) / d ELSE 0 END + 1e-9, 6) AS modified_z, d > 0 AND abs(0.6745 * (value - m) / d) > 3.5 AS is_outlier FROM events JOIN m USING (user_id) JOIN a USING (user_id)"""
)
def modified_zscores(spark: SparkSession, sf: str) -> DataFrame:
    return X.modified_zscores(table(spark, sf, "events").select("event_id", "user_id", "value"), U, "value").select("event_id", _r("modified_z"), "is_outlier")


@query(
    f"""WITH s AS (SELECT user_id, count(*) AS n, var_pop(a) AS v1, var_pop(b) AS v2 FROM (SELECT user_id, value - lag(value) OVER ({_W}) AS a, value - lag(value, 2) OVER ({_W}) AS b FROM events) GROUP BY user_id),
    r AS (SELECT user_id, CASE WHEN n >= 10 AND v1 > 0 THEN v2 / (2 * v1) ELSE 1 END AS r FROM s)
    SELECT user_id, round(r + 1e-9, 6) AS variance_ratio, r > 0.8 AND r < 1.2 AS is_random_walk FROM r"""
)
def variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return X.variance_ratio(_events(spark, sf), U, O_, "value").select("user_id", _r("variance_ratio"), "is_random_walk")


@query(
    f"""WITH a AS (SELECT user_id, ts, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, sum(value) OVER (PARTITION BY user_id) AS t FROM events),
    b AS (SELECT user_id, ts, CASE WHEN i >= 2 AND i < n - 2 THEN abs(s / i - (t - s) / (n - i)) ELSE 0 END AS x FROM a)
    SELECT user_id, ts, round(x + 1e-9, 6) AS score, x > 10 * 0.5 AS is_change FROM b"""
)
def mean_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return X.mean_shifts(_events(spark, sf), U, O_, "value", prior_scale=0.5).select("user_id", "ts", _r("score"), "is_change")


@query(
    f"""WITH a AS (SELECT user_id, ts, value, value - lag(value) OVER ({_W}) AS d FROM events), b AS (SELECT *, lag(d) OVER ({_W}) AS e FROM a),
    g AS (SELECT user_id, regr_slope(d, e) AS w, regr_intercept(d, e) AS k, arg_max(d, ts) AS last, arg_max(value, ts) AS x, avg(d) AS m, count(d) AS n FROM b GROUP BY user_id),
    s AS (SELECT user_id, x, CASE WHEN n >= 4 THEN k + w * last ELSE m END AS one, CASE WHEN n >= 4 THEN k ELSE m END AS k, CASE WHEN n >= 4 THEN w ELSE 0 END AS w FROM g WHERE n > 0)
    SELECT user_id, 1 AS step, round(x + one + 1e-9, 4) AS forecast FROM s UNION ALL SELECT user_id, 2, round(x + one + k + w * one + 1e-9, 4) FROM s"""
)
def forecast_autoregressive(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf)
    long = df.groupBy("user_id").agg(F.count("value").alias("n")).where("n > 1").select("user_id")
    return FC.autoregressive(df.join(long, "user_id"), U, O_, "value", 2, p=1, d=1).select("user_id", "step", _r("forecast", 4))


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Customers hang on nations, nations on regions, and a ring leads through all nations."""
    of = lambda name, *columns: table(spark, sf, name).selectExpr(*columns)
    hang = of("customer", "concat('c', c_custkey) AS src", "concat('n', c_nationkey) AS dst").union(of("nation", "concat('n', n_nationkey) AS src", "concat('r', n_regionkey) AS dst"))
    return hang.union(of("nation", "concat('n', n_nationkey) AS src", "concat('n', (n_nationkey + 1) % 25) AS dst"))


@query("SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer")
def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return G.bridges(_places(spark, sf))


@query("SELECT DISTINCT 'n' || c_nationkey AS id FROM customer")
def articulation_points(spark: SparkSession, sf: str) -> DataFrame:
    return G.articulation_points(_places(spark, sf))
