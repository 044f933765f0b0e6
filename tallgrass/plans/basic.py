"""Queries of projection, filters, strings and dates, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as S
from ..functions.expression import evaluate, query_filter
from ..operators import columns as C
from ..operators import combine as M
from .registry import query, table

GAPPY = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_cols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_cols(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").drop("c_mktsegment")


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation")
def rename_cols(spark: SparkSession, sf: str) -> DataFrame:
    return C.rename(table(spark, sf, "nation"), {"n_nationkey": "key", "n_name": "name"})


@query("SELECT r_regionkey AS x_r_regionkey, r_name AS x_r_name FROM region")
def add_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return C.add_prefix(table(spark, sf, "region"), "x_")


@query("SELECT r_regionkey AS r_regionkey_y, r_name AS r_name_y FROM region")
def add_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return C.add_suffix(table(spark, sf, "region"), "_y")


@query("SELECT p_partkey, CAST(NULL AS DOUBLE) AS missing FROM part")
def reindex_columns(spark: SparkSession, sf: str) -> DataFrame:
    return C.reindex_columns(table(spark, sf, "part"), ["p_partkey", "missing"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem")
def assign_expr(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    df = C.assign(df, net=lambda d: d["l_extendedprice"] * (1 - d["l_discount"]))
    return C.assign(df, gross=lambda d: d["net"] * (1 + d["l_tax"])).select("l_orderkey", "l_linenumber", "net", "gross")


@query("SELECT s_suppkey, s_acctbal + s_suppkey AS a, s_acctbal - s_suppkey AS s, s_acctbal * s_suppkey AS m, s_acctbal / s_suppkey AS d FROM supplier WHERE s_suppkey > 0")
def arith_cols(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("s_acctbal"), F.col("s_suppkey")
    return table(spark, sf, "supplier").where("s_suppkey > 0").select("s_suppkey", (a + b).alias("a"), (a - b).alias("s"), (a * b).alias("m"), C.div(a, b.cast("double")).alias("d"))


@query("SELECT event_id, floor(value / 3.0) AS fd, value % 3.0 AS md FROM events")
def floordiv_mod(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.floordiv(F.col("value"), 3).alias("fd"), (F.col("value") % 3.0).alias("md"))


@query("SELECT p_partkey, pow(p_size, 2) AS p2, sqrt(p_size) AS sq, ln(p_size) AS lg, exp(p_size / 50.0) AS ex FROM part WHERE p_size > 0")
def pow_sqrt_log_exp(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    return table(spark, sf, "part").where("p_size > 0").select("p_partkey", F.pow(s, 2.0).alias("p2"), F.sqrt(s).alias("sq"), F.ln(s).alias("lg"), F.exp(s / 50.0).alias("ex"))


@query("SELECT c_custkey, CAST(floor(c_acctbal) AS DOUBLE) AS fl, CAST(ceil(c_acctbal) AS DOUBLE) AS ce, CAST(trunc(c_acctbal) AS DOUBLE) AS tr, c_acctbal - trunc(c_acctbal) AS fr FROM customer")
def floor_ceil_trunc_fract(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.floor(a).cast("double").alias("fl"), F.ceil(a).cast("double").alias("ce"), C.trunc(a).alias("tr"), C.fract(a).alias("fr"))


@query("SELECT c_custkey, round(c_acctbal, 1) AS r FROM customer")
def round_half_up(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 1).alias("r"))


@query("SELECT c_custkey, CAST(sign(c_acctbal) AS INT) AS sg, -c_acctbal AS ng, abs(c_acctbal) AS ab FROM customer")
def sign_neg_abs(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", C.sign(a).alias("sg"), (-a).alias("ng"), F.abs(a).alias("ab"))


@query(f"SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE least(greatest(v, 10.0), 50.0) END AS v FROM (SELECT event_id, {GAPPY} AS v FROM events)")
def clip_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.clip(F.expr(GAPPY), 10, 50).alias("v"))


@query("SELECT event_id, CASE WHEN value > 50 THEN value END AS w, CASE WHEN value > 50 THEN -1.0 ELSE value END AS m FROM events")
def where_mask(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", C.where_mask(v, v > 50).alias("w"), C.mask(v, v > 50, -1.0).alias("m"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS st, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
def replace_values(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").select("o_orderkey", C.replace_values(s, {"F": "final", "O": "open"}).alias("st"), C.map_values(s, {"F": 1, "O": 2}, 0).alias("code"))


@query(f"SELECT event_id, coalesce({GAPPY}, 0.0) AS v FROM events")
def coalesce_cols(spark: SparkSession, sf: str) -> DataFrame:
    return C.fillna(table(spark, sf, "events").select("event_id", F.expr(GAPPY).alias("v")), "v", 0.0)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def isin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def between_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(C.between(F.col("l_quantity"), 10, 20)).select("l_orderkey", "l_quantity")


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20")
def between_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(C.between(F.col("l_quantity"), 10, 20, "neither")).select("l_orderkey", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def query_simple(spark: SparkSession, sf: str) -> DataFrame:
    return query_filter(table(spark, sf, "part"), "p_size > 25").select("p_partkey", "p_size")


@query("SELECT p_partkey FROM part WHERE (p_size > 25 AND p_retailprice < 1500) OR NOT (p_size >= 5)")
def query_bool_logic(spark: SparkSession, sf: str) -> DataFrame:
    return query_filter(table(spark, sf, "part"), "(p_size > 25 and p_retailprice < 1500) or not (p_size >= 5)").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE pow(p_size, 2) + 3 * p_size - 1 > 500 AND p_size % 2 = 0")
def query_arith_power(spark: SparkSession, sf: str) -> DataFrame:
    return query_filter(table(spark, sf, "part"), "p_size ** 2 + 3 * p_size - 1 > 500 && p_size % 2 == 0").select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE abs(c_acctbal) > 500 AND sqrt(abs(c_acctbal)) < 60 AND c_mktsegment = 'BUILDING'")
def query_functions(spark: SparkSession, sf: str) -> DataFrame:
    return query_filter(table(spark, sf, "customer"), "abs(c_acctbal) > @low and sqrt(abs(c_acctbal)) < 60 and c_mktsegment == 'BUILDING'", {"low": 500}).select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / 2 AS half FROM lineitem")
def eval_column(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", evaluate(df, "l_extendedprice * (1 - l_discount) / 2").alias("half"))


@query(f"SELECT 'event_id' AS column_name, CAST(0 AS BIGINT) AS n_null, count(*) AS n_total FROM events UNION ALL SELECT 'v', count(*) FILTER (v IS NULL), count(*) FROM (SELECT {GAPPY} AS v FROM events)")
def isna_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.isna_counts(table(spark, sf, "events").select("event_id", F.expr(GAPPY).alias("v")))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events ORDER BY event_id LIMIT 10")
def head_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return M.head_tail(table(spark, sf, "events"), ["event_id"], 10)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events ORDER BY event_id DESC LIMIT 10")
def tail_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return M.head_tail(table(spark, sf, "events"), ["event_id"], 10, tail=True)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 30")
def iloc_slice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").offset(30).limit(20).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5('0:' || o_orderkey), 1, 8) AS BIGINT) < 429496729")
def sample_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return M.sample_by_hash(table(spark, sf, "orders"), "o_orderkey", 0.1).select("o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'mid' WHEN p_size > 30 AND p_size <= 50 THEN 'big' END AS bin FROM part")
def cut_bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", C.cut(F.col("p_size"), [0, 10, 30, 50], ["small", "mid", "big"]).alias("bin"))


@query("SELECT c_custkey, CAST((c_acctbal > q[1])::INT + (c_acctbal > q[2])::INT + (c_acctbal > q[3])::INT AS INT) AS bin FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q FROM customer)")
def qcut_bins(spark: SparkSession, sf: str) -> DataFrame:
    return C.qcut(table(spark, sf, "customer"), "c_acctbal", 4).select("c_custkey", "bin")


@query("SELECT user_id, event_id, CAST(dense_rank() OVER (ORDER BY f) - 1 AS DOUBLE) AS code FROM (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS f FROM events)")
def to_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return C.first_appearance_codes(table(spark, sf, "events"), "event_type", ["event_id"]).select("user_id", "event_id", "code")


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders")
def onehot(spark: SparkSession, sf: str) -> DataFrame:
    return C.dummies(table(spark, sf, "orders"), "o_orderstatus", ["F", "O", "P"]).select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P")


# --- strings ---


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS c FROM part")
def upper_lower_capitalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), S.capitalize(F.col("p_type")).alias("c"))


@query("SELECT p_partkey, contains(p_name, 'a.') AS lit, regexp_matches(p_name, 'P.*1', 'i') AS re, starts_with(p_name, 'p') AS sw, ends_with(p_name, '1') AS ew FROM part")
def contains_starts_ends(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", S.contains(n, "a.", regex=False).alias("lit"), S.contains(n, "P.*1", case=False).alias("re"), n.startswith("p").alias("sw"), n.endswith("1").alias("ew"))


@query(r"SELECT p_partkey, replace(p_name, 'a', '<>') AS r, regexp_replace(p_name, '[0-9]+', '#', 'g') AS rx FROM part")
def replace_literal_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit("a"), F.lit("<>")).alias("r"), F.regexp_replace("p_name", "[0-9]+", "#").alias("rx"))


@query(r"SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS n_p FROM pages")
def extract_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "https?://([^/]+)/", 1).alias("host"), F.regexp_count("html", F.lit("<p>")).alias("n_p"))


@query(r"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[0-9]+'), 1, 5), '|') AS found FROM documents")
def findall(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), 1, 5), "|").alias("found"))


@query("SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(strlen(text) AS INT) AS bytes FROM documents")
def char_vs_byte_len(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


@query("SELECT c_custkey, trim(c_name, 'C0') AS b, ltrim(c_name, 'Cu') AS l, rtrim(c_name, '0123456789') AS r FROM customer")
def strip_chars(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", F.btrim(n, F.lit("C0")).alias("b"), F.ltrim(n, F.lit("Cu")).alias("l"), F.rtrim(n, F.lit("0123456789")).alias("r"))


@query("""SELECT n_nationkey, CASE WHEN length(n_name) >= 12 THEN n_name ELSE lpad(n_name, 12, '*') END AS l, CASE WHEN length(n_name) >= 12 THEN n_name ELSE rpad(n_name, 12, '*') END AS r,
CASE WHEN length(n_name) >= 12 THEN n_name ELSE repeat('*', (12 - length(n_name)) // 2) || n_name || repeat('*', 12 - length(n_name) - (12 - length(n_name)) // 2) END AS c,
lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS z FROM nation""")
def pad_center_zfill(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_nationkey", S.pad(n, 12, "left", "*").alias("l"), S.pad(n, 12, "right", "*").alias("r"), S.center(n, 12, "*").alias("c"), S.zfill(F.col("n_nationkey").cast("string"), 5).alias("z"))


@query("SELECT p_partkey, substr(p_name, 2, 3) AS s, repeat(p_brand, 2) AS rp, reverse(p_name) AS rv FROM part")
def slice_repeat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.slice_(F.col("p_name"), 1, 4).alias("s"), F.repeat("p_brand", 2).alias("rp"), F.reverse("p_name").alias("rv"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS s FROM part")
def swapcase(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.swapcase(F.col("p_name")).alias("s"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-zA-Z]+') AS al, regexp_full_match(p_name, '[0-9]+') AS dg, regexp_full_match(p_name, '[a-zA-Z0-9]+') AS an, (p_name = lower(p_name) AND p_name <> upper(p_name)) AS lo FROM part")
def is_classes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", S.isalpha(n).alias("al"), S.isdigit(n).alias("dg"), S.isalnum(n).alias("an"), S.islower(n).alias("lo"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[1] AS first FROM part")
def split_array(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("p_name", " ", -1)
    return table(spark, sf, "part").select("p_partkey", F.size(parts).cast("long").alias("n"), parts[0].alias("first"))


# --- dates ---


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(week(o_orderdate) AS INT) AS wk FROM orders")
def date_parts(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.year(o).alias("y"), F.month(o).alias("m"), F.dayofmonth(o).alias("d"), F.quarter(o).alias("q"), F.weekday(o).alias("wd"), F.dayofyear(o).alias("dy"), F.weekofyear(o).alias("wk"))


@query("SELECT o_orderkey, isodow(o_orderdate) >= 6 AS weekend, isodow(o_orderdate) < 6 AS business FROM orders")
def is_weekend_business(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", D.is_weekend(o).alias("weekend"), D.is_business_day(o).alias("business"))


@query("SELECT event_id, date_trunc('hour', ts) AS fl, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS ro FROM events")
def floor_round_hour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", D.floor(F.col("ts"), "hour").alias("fl"), D.round_hour(F.col("ts")).alias("ro"))


@query("SELECT event_id, ts + INTERVAL 5 DAY AS d5, ts + INTERVAL 7 HOUR AS h7, ts + INTERVAL 1 MONTH AS m1 FROM events")
def add_days_hours_months(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, sf, "events").select("event_id", D.add_days(t, 5).alias("d5"), D.add_hours(t, 7).alias("h7"), D.add_months(t, 1).alias("m1"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(last_day(o_orderdate)) AS INT) AS n, (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 AS leap FROM orders")
def days_in_month_leap(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderdate")
    return table(spark, sf, "orders").select(F.year(o).alias("y"), F.month(o).alias("m"), D.days_in_month(o).alias("n"), D.is_leap_year(o).alias("leap")).distinct()


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, CAST(sum((SELECT count(*) FROM generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + INTERVAL 10 DAY, INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6)) AS BIGINT) AS days FROM (SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL")
def business_day_count(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    df = M.join_in_parts(lines, orders, "l_orderkey", "o_orderkey")
    d = F.col("o_orderdate").cast("date")
    return df.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_rows"), F.sum(D.business_days(d, F.date_add(d, 10))).cast("long").alias("days"))


@query("SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2023-01-01', DATE '2023-01-10', INTERVAL 1 DAY) t(d)")
def date_range_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.date_range(spark, "2023-01-01", "2023-01-10", "1 day").select(F.col("value").cast("date").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS s FROM orders")
def strftime(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", D.strftime(F.col("o_orderdate"), "%Y/%m/%d").alias("s"))


@query("SELECT event_id, ts + INTERVAL 9 HOUR AS tokyo FROM events")
def tz_offset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", D.to_zone(F.col("ts"), "+09:00").alias("tokyo"))
