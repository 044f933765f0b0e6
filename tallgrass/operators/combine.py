"""Joins, set operations, ordering, duplicates and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import cumulative_global

# --- joins ---


def merge(left: DataFrame, right: DataFrame, on: list[str] | None = None, how: str = "inner", left_on: list[str] | None = None, right_on: list[str] | None = None, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A join with one copy of the keys, and suffixes for other columns that both sides have.

    Keys of a right or outer join are coalesced. With keys of different names the left name is kept. NULL keys meet nothing.
    """
    lk = left_on or on or [c for c in left.columns if c in right.columns]
    rk = right_on or on or lk
    clash = (set(left.columns) - set(lk)) & (set(right.columns) - set(rk))
    l_ = left.select(*[F.col(c).alias(f"l{i}") for i, c in enumerate(left.columns)])
    r_ = right.select(*[F.col(c).alias(f"r{i}") for i, c in enumerate(right.columns)])
    li, ri = {c: f"l{i}" for i, c in enumerate(left.columns)}, {c: f"r{i}" for i, c in enumerate(right.columns)}
    condition = None
    for a, b in zip(lk, rk, strict=True):
        e = l_[li[a]] == r_[ri[b]]
        condition = e if condition is None else condition & e
    joined = l_.join(r_, condition, {"outer": "full_outer"}.get(how, how)) if how != "cross" else l_.crossJoin(r_)
    out = []
    for c in left.columns:
        key = F.coalesce(li[c], ri[rk[lk.index(c)]]) if c in lk and how in ("right", "outer") else F.col(li[c])
        out.append(key.alias(c + suffixes[0] if c in clash else c))
    out += [F.col(ri[c]).alias(c + suffixes[1] if c in clash else c) for c in right.columns if c not in rk]
    return joined.select(*out)


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: list[str], out: str) -> DataFrame:
    """The value of the last row (in the given order) of table for each key; NULL without one."""
    last = table.groupBy(F.col(table_key).alias("_key")).agg(F.max_by(value, F.struct(*order)).alias(out))
    return df.join(last, df[key] == last["_key"], "left").drop("_key")


def compare(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column_name, left and right value (as text) of each cell that differs."""
    both = left.alias("l").join(right.alias("r"), key)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"l.{c}").cast("string").alias("left_value"), F.col(f"r.{c}").cast("string").alias("right_value")) for c in columns])
    return both.select(key, F.explode(cells).alias("x")).where(~F.col("x.left_value").eqNullSafe(F.col("x.right_value"))).select(key, "x.*")


def update(left: DataFrame, right: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """left with the values of right where right has one. Of several rows of a key in right the last in the order
    counts (without one, the greatest values in the order of columns), so left keeps its rows."""
    last = F.max_by(F.struct(*columns), F.struct(*(order or columns)))
    one = right.groupBy(key).agg(last.alias("_last"))
    other = one.select(key, *[F.col(f"_last.{c}").alias(f"_{c}") for c in columns])
    joined = left.join(other, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in left.columns])


def combine_first(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of left, and those of right where left has none; rows of both."""
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return left.select(key, *columns).join(other, key, "full_outer").select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all, columns by name; missing ones NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def concat_columns(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their place in an order; NULL where one side is shorter.

    The numbering is global: for frames as small as a report.
    """
    number = lambda d, o: d.withColumn("_n", F.row_number().over(Window.orderBy(*o)))
    return number(left, left_order).join(number(right, right_order), "_n", "full_outer").orderBy("_n").drop("_n")


# --- sets ---


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def distinct_subset(df: DataFrame, subset: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """The first or last row of each key in the order: a pre-aggregated minimum, not a window."""
    rest = [c for c in df.columns if c not in subset]
    row = F.struct(*rest)
    best = (F.min if keep == "first" else F.max)(F.struct(F.struct(*order).alias("o"), row.alias("r"))).alias("b")
    kept = df.groupBy(*subset).agg(best)
    return kept.select(*[F.col(c) if c in subset else F.col(f"b.r.{c}").alias(c) for c in df.columns])


def duplicated(by: list[str], order: list[str], keep: str | bool = "first") -> Column:
    """Whether a row is a repeat; keep=False marks all rows of a repeated key."""
    if keep is False:
        return F.count("*").over(Window.partitionBy(*by)) > 1
    key = [F.asc(c) for c in order] if keep == "first" else [F.desc(c) for c in order]
    return F.row_number().over(Window.partitionBy(*by).orderBy(*key)) > 1


# --- order ---


def sort_nulls_last(df: DataFrame, by: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in by])


def nlargest(df: DataFrame, n: int, c: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(c).desc_nulls_last(), *ties).limit(n)


def nsmallest(df: DataFrame, n: int, c: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(c).asc_nulls_last(), *ties).limit(n)


def rank(df: DataFrame, c: str, out: str, method: str = "average", by: list[str] | None = None, ties: list[str] | None = None, pct: bool = False, ascending: bool = True) -> DataFrame:
    """Ranks from 1; NULL has none. method: average, min, max, first, dense.

    Distinct values with their counts are numbered by a running sum and joined back, so the window is over
    distinct values; only `first` numbers the rows themselves.
    """
    by = by or []
    key = F.asc(c) if ascending else F.desc(c)
    if not by and dict(df.dtypes)[c] in WIDE and _leaf_bytes(df) > ONE_TASK_BYTES:
        return _rank_all(df, c, out, method, ties or [], pct, ascending)
    if method == "first":
        n = F.count(c).over(Window.partitionBy(*by))
        r = F.row_number().over(Window.partitionBy(*by, F.col(c).isNull()).orderBy(key, *(ties or []))).cast("double")
        return df.withColumn(out, F.when(F.col(c).isNotNull(), r / n if pct else r))
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(key)
    upto = F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))
    r = {"average": upto - (F.col("_k") - 1) / 2, "min": upto - F.col("_k") + 1, "max": upto, "dense": F.row_number().over(w)}[method].cast("double")
    if pct:
        r = r / (F.max(F.row_number().over(w)).over(Window.partitionBy(*by)) if method == "dense" else F.sum("_k").over(Window.partitionBy(*by)))
    ranked = counts.select(*[F.col(x).alias(f"_b{i}") for i, x in enumerate(by)], F.col(c).alias("_v"), r.alias(out))
    condition = df[c] == ranked["_v"]
    for i, x in enumerate(by):
        condition = condition & df[x].eqNullSafe(ranked[f"_b{i}"])
    return df.join(ranked, condition, "left").drop("_v", *[f"_b{i}" for i in range(len(by))])


#: Types over whose values a running sum can be taken by slices.
WIDE = frozenset({"tinyint", "smallint", "int", "bigint", "float", "double"})


#: Tables of more than this are ranked by slices; of smaller ones a task can order all distinct values.
ONE_TASK_BYTES = 64 << 20


def _leaf_bytes(df: DataFrame) -> int:
    """The size that Spark reckons for the largest table df reads; no job is run."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)


#: Of larger tables each task of a join in parts gets about this much of the files.
PART_BYTES = 8 << 20


def join_in_parts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """An inner join whose rows lie in parts by the key: what is grouped by the key and more is grouped where it lies.

    The number of parts grows with the larger table that is read. By the planner's own size of a part, which is of compressed
    rows, a task may get millions of them to sort and group.
    """
    size = max(_leaf_bytes(left), _leaf_bytes(right))
    if size > ONE_TASK_BYTES:
        parts = max(-(-size // PART_BYTES), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left, right = left.repartition(parts, left_key), right.repartition(parts, right_key)
    return left.join(right, F.col(left_key) == F.col(right_key))


def _rank_all(df: DataFrame, c: str, out: str, method: str, ties: list[str], pct: bool, ascending: bool) -> DataFrame:
    """rank without groups: distinct values are numbered by slices and offsets, so that no task holds them all."""
    sign = F.lit(1) if ascending else F.lit(-1)
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_k")).withColumn("_at", F.col("_v") * sign).withColumn("_one", F.lit(1))
    placed = cumulative_global(counts, "_one" if method == "dense" else "_k", "_at", "_upto")
    r = {"average": F.col("_upto") - (F.col("_k") - 1) / 2, "max": F.col("_upto"), "dense": F.col("_upto")}.get(method, F.col("_upto") - F.col("_k") + 1).cast("double")
    ranked = placed.select("_v", r.alias("_r"))
    joined = df.join(ranked, df[c] == ranked["_v"], "left")
    r = F.col("_r")
    if method == "first":  # equal values in the order of ties
        r = r + F.when(r.isNotNull(), F.row_number().over(Window.partitionBy(c).orderBy(*(ties or [F.lit(0)]))) - 1)
    if pct:
        total = counts.agg((F.count("*") if method == "dense" else F.sum("_k")).alias("_n"))
        joined, r = joined.crossJoin(F.broadcast(total)), r / F.col("_n")
    return joined.withColumn(out, r).drop("_v", "_r", "_n")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def head_tail(df: DataFrame, order: list[str], n: int, tail: bool = False) -> DataFrame:
    keys = [F.desc(c) for c in order] if tail else [F.asc(c) for c in order]
    return df.orderBy(*keys).limit(n)


def sample_by_hash(df: DataFrame, key: str, part: float, seed: int = 0) -> DataFrame:
    """A reproducible sample: rows whose hash (the first 32 bits of the md5 of seed and key) falls in the given part."""
    head = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.where(head < int(part * (1 << 32)))
