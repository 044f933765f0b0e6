"""Statistical tests and metrics as aggregates: one pass over the data, one row out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions as P
from . import windows as W


def welch_t(df: DataFrame, c: str, group: str, a: object, b: object) -> DataFrame:
    """t and degrees of freedom of Welch's test."""
    part = lambda f, g: f(F.when(F.col(group) == g, F.col(c)))
    m = df.agg(part(F.avg, a).alias("ma"), part(F.avg, b).alias("mb"), (part(F.var_samp, a) / part(F.count, a)).alias("va"), (part(F.var_samp, b) / part(F.count, b)).alias("vb"), part(F.count, a).alias("na"), part(F.count, b).alias("nb"))
    s = F.col("va") + F.col("vb")
    return m.select(((F.col("ma") - F.col("mb")) / F.sqrt(s)).alias("t"), (s * s / (F.col("va") ** 2 / (F.col("na") - 1) + F.col("vb") ** 2 / (F.col("nb") - 1))).alias("dof"))


def anova_f(df: DataFrame, c: str, group: str) -> DataFrame:
    """F of a one-way analysis of variance, from the sums of groups."""
    g = df.where(F.col(c).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(c).alias("m"), F.var_pop(c).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("v")).alias("inside"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    between = F.col("s2") - F.col("s") * F.col("s") / F.col("n")
    return t.select(((between / (F.col("k") - 1)) / (F.col("inside") / (F.col("n") - F.col("k")))).alias("f"))


def chi2(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence and Cramér's V of two columns, absent pairs included."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    w = n.withColumn("ra", F.sum("n").over(Window.partitionBy(a))).withColumn("rb", F.sum("n").over(Window.partitionBy(b)))
    # sum of (n - e)^2 / e over all pairs is N * (sum of n^2 / (ra * rb) - 1)
    t = w.agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))).alias("q"), F.sum("n").alias("total"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    return t.select((F.col("total") * (F.col("q") - 1)).alias("chi2"), F.sqrt((F.col("q") - 1) / F.least(F.col("ka") - 1, F.col("kb") - 1)).alias("cramers_v"))


def ols_simple(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def iqr_outliers(df: DataFrame, c: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the whiskers; the quartiles are one row."""
    q = df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    spread = F.col("_q")[1] - F.col("_q")[0]
    return df.crossJoin(F.broadcast(q)).where((F.col(c) < F.col("_q")[0] - factor * spread) | (F.col(c) > F.col("_q")[1] + factor * spread)).drop("_q")


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    d = F.col(truth) - F.col(guess)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), (1 - F.sum(d * d) / (F.var_pop(truth) * F.count(truth))).alias("r2"))


def classification_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """accuracy, precision, recall and f1 of label 1."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    m = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return m.select(((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


# --- tests with p-values: statistics by aggregation, the p-value on their one row ---


def one_sample_t(df: DataFrame, c: str, mean: float, alternative: str = "two-sided") -> DataFrame:
    m = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.count(c).alias("n"))
    out = m.select(F.try_divide(F.col("m") - mean, F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).cast("double").alias("dof"))
    return out.withColumn("p", P.p_t(F.col("t"), F.col("dof"), alternative))


def paired_t(df: DataFrame, before: str, after: str, alternative: str = "two-sided") -> DataFrame:
    """Of before - after, over rows that have both."""
    return one_sample_t(df.select((F.col(before) - F.col(after)).alias("d")), "d", 0.0, alternative)


def pooled_t(df: DataFrame, c: str, group: str, a: object, b: object, alternative: str = "two-sided") -> DataFrame:
    """Student's test of two groups of equal variance."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(c)))
    m = df.agg(of(F.avg, a).alias("ma"), of(F.avg, b).alias("mb"), of(F.var_samp, a).alias("va"), of(F.var_samp, b).alias("vb"), of(F.count, a).alias("na"), of(F.count, b).alias("nb"))
    dof = F.col("na") + F.col("nb") - 2
    s = F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), dof)
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(s * (F.try_divide(F.lit(1.0), F.col("na")) + F.try_divide(F.lit(1.0), F.col("nb")))))
    return m.select(t.alias("t"), dof.cast("double").alias("dof")).withColumn("p", P.p_t(F.col("t"), F.col("dof"), alternative))


def correlation_t(df: DataFrame, x: str, y: str, alternative: str = "two-sided") -> DataFrame:
    """Pearson's r, its t with n - 2 degrees of freedom and p."""
    m = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.corr(x, y).alias("r"), (F.count("*") - 2).cast("double").alias("dof"))
    t = F.try_divide(F.col("r") * F.sqrt("dof"), F.sqrt(1 - F.col("r") * F.col("r")))
    return m.withColumn("t", t).withColumn("p", P.p_t(F.col("t"), F.col("dof"), alternative))


def value_ranks(df: DataFrame, c: str) -> DataFrame:
    """c, n and rank: distinct values, their counts and their average ranks over the whole table.

    Values are pre-aggregated, then ranked by a distributed running sum: no window over all rows.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    upto = W.cumulative_global(counts, "n", c, "_upto")
    return upto.select(c, "n", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank"))


def mann_whitney(df: DataFrame, c: str, group: str, a: object, b: object, alternative: str = "two-sided") -> DataFrame:
    """u1, u2, u (the less of both), z with a correction of a half, p."""
    two = df.where(F.col(c).isNotNull() & F.col(group).isin(a, b))
    sizes = two.groupBy(c).agg(F.count_if(F.col(group) == a).alias("_a"), F.count("*").alias("_k"))
    upto = W.cumulative_global(sizes, "_k", c, "_upto")
    # counts as doubles: their threefold product passes a long from 3.4 million rows on
    m = upto.agg(F.sum(F.col("_a") * (F.col("_upto") - (F.col("_k") - 1) / 2)).alias("r1"), F.sum("_a").cast("double").alias("n1"), (F.sum("_k") - F.sum("_a")).cast("double").alias("n2"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    m = m.withColumn("u1", u1).withColumn("u2", F.col("n1") * F.col("n2") - F.col("u1")).withColumn("u", F.least("u1", "u2"))
    middle = F.col("n1") * F.col("n2") / 2
    spread = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    z = F.try_divide(F.col("u") - middle + F.when(F.col("u") > middle, -0.5).otherwise(0.5), spread)
    return m.select("u1", "u2", "u", z.alias("z")).withColumn("p", P.p_normal(F.col("z"), alternative))


def kruskal(df: DataFrame, c: str, group: str) -> DataFrame:
    """h over average ranks (no correction for ties), dof and p."""
    known = df.where(F.col(c).isNotNull() & F.col(group).isNotNull())
    ranks = value_ranks(known, c).select(F.col(c).alias("_v"), "rank")
    sums = known.groupBy(c, group).agg(F.count("*").alias("_k")).join(ranks, F.col(c) == F.col("_v")).groupBy(group).agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("rank")).alias("r"))
    t = sums.agg(F.sum("n").cast("double").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    h = F.try_divide(12 * F.col("s"), F.col("n") * (F.col("n") + 1)) - 3 * (F.col("n") + 1)
    return t.select(h.alias("h"), (F.col("k") - 1).cast("double").alias("dof")).withColumn("p", P.p_chi2(F.col("h"), F.col("dof")))


def wilcoxon(df: DataFrame, before: str, after: str, alternative: str = "two-sided") -> DataFrame:
    """w_plus, w_minus, w (the less), z and p of the signed ranks of differences other than 0."""
    d = df.select((F.col(before) - F.col(after)).alias("d")).where("d != 0")
    sizes = d.groupBy(F.abs("d").alias("_v")).agg(F.count_if(F.col("d") > 0).alias("_plus"), F.count("*").alias("_k"))
    upto = W.cumulative_global(sizes, "_k", "_v", "_upto").withColumn("rank", F.col("_upto") - (F.col("_k") - 1) / 2)
    m = upto.agg(F.sum(F.col("_plus") * F.col("rank")).alias("w_plus"), F.sum((F.col("_k") - F.col("_plus")) * F.col("rank")).alias("w_minus"), F.sum("_k").cast("double").alias("n"))
    # the cube of a count passes a long from 1.7 million rows on
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    z = F.try_divide(w - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return m.select("w_plus", "w_minus", w.alias("w"), z.alias("z")).withColumn("p", P.p_normal(F.col("z"), alternative))


def ks_two_sample(df: DataFrame, c: str, group: str, a: object, b: object) -> DataFrame:
    """d, the greatest distance between the two empirical distribution functions, and the asymptotic p."""
    two = df.where(F.col(c).isNotNull() & F.col(group).isin(a, b))
    sizes = two.groupBy(c).agg(F.count_if(F.col(group) == a).alias("_a"), F.count_if(F.col(group) == b).alias("_b"))
    total = sizes.agg(F.sum("_a").alias("na"), F.sum("_b").alias("nb"))
    gaps = sizes.crossJoin(F.broadcast(total)).withColumn("_gap", F.try_divide("_a", "na") - F.try_divide("_b", "nb"))
    at = W.cumulative_global(gaps, "_gap", c, "_at")
    m = at.agg(F.max(F.abs("_at")).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    scale = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    x = (scale + 0.12 + 0.11 / scale) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return m.select("d", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms))).alias("p"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows that have both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = both.groupBy("_x", "_y").agg(F.count("*").alias("_n"))
    a = value_ranks(both, "_x").select("_x", F.col("rank").alias("_rx"))
    b = value_ranks(both, "_y").select("_y", F.col("rank").alias("_ry"))
    ranked = pairs.join(a, "_x").join(b, "_y")
    # ranks are centred before they are squared, for they grow with the table
    mean = pairs.agg(((F.sum("_n") + 1) / 2).alias("_m"))
    r = ranked.crossJoin(F.broadcast(mean)).select("_n", (F.col("_rx") - F.col("_m")).alias("a"), (F.col("_ry") - F.col("_m")).alias("b"))
    s = lambda u, v: F.sum(F.col("_n") * F.col(u) * F.col(v))
    return r.agg(F.try_divide(s("a", "b"), F.sqrt(s("a", "a")) * F.sqrt(s("b", "b"))).alias("rho"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi in nats and nmi = mi / sqrt(entropy of a * entropy of b)."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = n.groupBy(a).agg(F.sum("n").alias("ra")), n.groupBy(b).agg(F.sum("n").alias("rb"))
    total = n.agg(F.sum("n").alias("t"))
    entropy = lambda r, c: r.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias("h" + c))
    w = n.join(ra, a).join(rb, b).crossJoin(F.broadcast(total))
    mi = w.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ra") * F.col("rb")))).alias("mi"))
    out = mi.crossJoin(F.broadcast(entropy(ra, "ra"))).crossJoin(F.broadcast(entropy(rb, "rb")))
    return out.select("mi", F.coalesce(F.try_divide(F.col("mi"), F.sqrt(F.col("hra") * F.col("hrb"))), F.lit(0.0)).alias("nmi"))


def runs_test(df: DataFrame, flag: str, by: list[str], order: list[str]) -> DataFrame:
    """Wald-Wolfowitz runs of a boolean in the order of each group: by, runs, z, p."""
    w = Window.partitionBy(*by).orderBy(*order)
    begins = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    m = df.where(F.col(flag).isNotNull()).withColumn("_begins", begins).groupBy(*by).agg(F.sum("_begins").alias("runs"), F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    n, ab = F.col("a") + F.col("b"), 2.0 * F.col("a") * F.col("b")
    gap = F.col("runs") - (ab / n + 1)
    z = F.try_divide(F.when(gap > 0, gap - 0.5).otherwise(gap + 0.5), F.sqrt(F.try_divide(ab * (ab - n), n * n * (n - 1))))
    return m.withColumn("z", z).withColumn("p", P.p_normal(F.col("z"))).select(*by, "runs", "z", "p")


def friedman(df: DataFrame, block: str, treatment: str, c: str) -> DataFrame:
    """Friedman's chi-square over ranks inside blocks (a block is a few treatments), dof and p."""
    w = Window.partitionBy(block)
    average = F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(block, c)) - 1) / 2
    sums = df.withColumn("_r", average).groupBy(treatment).agg(F.sum("_r").alias("r"), F.count("*").alias("n"))
    t = sums.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"))
    k, n = F.col("k"), F.col("n")
    return t.select((12 * F.col("s") / (n * k * (k + 1)) - 3 * n * (k + 1)).alias("chi2"), (k - 1).cast("double").alias("dof")).withColumn("p", P.p_chi2(F.col("chi2"), F.col("dof")))


def adjust_p_values(df: DataFrame, p: str, method: str = "holm", out: str = "adjusted") -> DataFrame:
    """bonferroni, holm or fdr (Benjamini-Hochberg). A row is a test: the list is small, so one task orders it."""
    n = F.count(p).over(Window.partitionBy())
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))
    w = Window.orderBy(p)
    i = F.row_number().over(w)
    if method == "holm":
        return df.withColumn("_q", F.col(p) * (n - i + 1)).withColumn(out, F.least(F.lit(1.0), F.max("_q").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_q")
    return df.withColumn("_q", F.col(p) * n / i).withColumn(out, F.least(F.lit(1.0), F.min("_q").over(w.rowsBetween(0, Window.unboundedFollowing)))).drop("_q")


def zscore_outliers(df: DataFrame, c: str, bound: float = 3.0) -> DataFrame:
    """Rows further than bound standard deviations from the mean."""
    m = df.agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    return df.crossJoin(F.broadcast(m)).where(F.abs(F.col(c) - F.col("_m")) > bound * F.col("_s")).drop("_m", "_s")


def bootstrap_means(df: DataFrame, c: str, samples: int = 200, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """sample and mean of so many resamples: each row counts Poisson(1) times in each, so one pass suffices.

    The draws are a hash of the key (all columns by default), so a lost task draws the same again; rows of equal key are
    drawn together, so name one that tells rows apart.
    """
    # the distribution function of Poisson(1), to where a hash of 40 bits tells no more
    steps = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(15)]
    known = df.where(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_v"), F.xxhash64(F.lit(seed), *(key or df.columns)).alias("_r"))
    each = known.select("_v", "_r", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    u = F.pmod(F.xxhash64("_r", "sample"), F.lit(1 << 40)) / float(1 << 40)
    times = sum(((u > s).cast("int") for s in steps), F.lit(0))
    return each.withColumn("_w", times).groupBy("sample").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("mean"))


def bootstrap_interval(df: DataFrame, c: str, level: float = 0.95, samples: int = 200, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    q = F.percentile("mean", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return bootstrap_means(df, c, samples, seed, key).agg(q.alias("_q")).select(F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def stratified_sample(df: DataFrame, stratum: str, part: float, key: str, seed: int = 0) -> DataFrame:
    """The given part of each stratum, to the nearest row, in the order of a hash of the key: reruns agree."""
    w = Window.partitionBy(stratum)
    kept = F.row_number().over(w.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)) <= F.round(F.count("*").over(w) * part)
    return df.withColumn("_kept", kept).where("_kept").drop("_kept")
