"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a hash-random key. A source's documents, sorted by key, form one sequence, which
the mix reads from the start until the source's budget of words is used up, beginning anew as often
as needed; the last document is cut at the exact word.

The running sum is distributed: keys are dealt into slices of the hash range, so a source of any size is spread
over as many slices as its rows ask for (SLICE_ROWS rows a slice on average); sums of slices are pre-aggregated,
their own prefix sums are taken over slices, and each slice adds its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import checkpoint

#: Rows of a source in a slice, on average; slices are at most 16**MAX_DIGITS a source.
SLICE_ROWS, MAX_DIGITS = 64, 7
#: Copies of one row that are dealt out at once.
CHUNK = 4096

#: A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: str = "") -> DataFrame:
    """id, source, size, source_size, target, taken and start of every row of docs.

    Sources in code point order, null last, have the weights in turn and share `share` times all words; a
    source's target stops at max_epochs times its size, and the excess is shared out among the others by
    weight until none is above. taken counts the words the mix takes from the document, repeats
    included: whole passes over the source first, then a prefix of it in hash order, its last document cut
    at the exact word. start is the document's first word in the source's sequence. The sum of
    taken is each source's target rounded down.

    The key is the md5 of seed, id and text (null: empty): runs agree. Rows of one key and size are interchangeable; they are counted as one row
    and dealt out again at the end, so that copies of one row never meet. Texts without words take
    nothing. Other columns are left aside, whatever their names; an empty table gives an empty result.
    """
    size = word_count(F.col(text_col)) if size is None else size
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), key.alias("key"))
    rows = checkpoint(rows.groupBy("id", "src", "size", "key").agg(F.count("*").alias("k")))
    most = rows.agg(F.max("k")).first()[0] or 0

    # one row a source: targets by water-filling over sources sorted by the level at which they are full
    own = rows.groupBy("src").agg(F.sum(F.col("size") * F.col("k")).alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    filled = own.withColumn("w", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    everything = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    filled = filled.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    filled = filled.withColumn("below", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    # a source is full if its even share of what fuller ones leave is at least its cap
    filled = filled.withColumn("full", F.col("cap") * F.col("rest") <= (F.col("total") - F.col("below")) * F.col("w"))
    open_ = ~F.col("full")
    filled = filled.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))).withColumn("sharing", F.sum(F.when(open_, F.col("w"))).over(everything))
    filled = filled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("left") * F.col("w") / F.col("sharing"))))
    digits = F.least(F.lit(MAX_DIGITS), F.ceil(F.log(16.0, F.greatest(F.col("n") / SLICE_ROWS, F.lit(1.0))))).cast("int")
    sources = checkpoint(filled.select("src", "source_size", "target", digits.alias("digits")))

    # slices of the hash range, and what stands before each
    def named(x: DataFrame) -> DataFrame:
        return x.select(F.col("src").alias("of"), "source_size", "target", "digits")

    sliced = rows.join(named(sources), F.col("src").eqNullSafe(F.col("of"))).drop("of").withColumn("slice", F.expr("left(key, digits)"))
    # sums by slice, then offsets by the leading digits of the slice, so that no window holds all slices of a source
    parts = sliced.groupBy("src", "slice").agg(F.sum(F.col("size") * F.col("k")).alias("sum")).withColumn("head", F.expr("left(slice, 3)"))
    heads = parts.groupBy("src", "head").agg(F.sum("sum").alias("sum"))
    before = lambda by, at: F.coalesce(F.sum("sum").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(F.col("src").alias("hs"), F.col("head").alias("hh"), before(["src"], "head").alias("offset"))
    offsets = parts.withColumn("inner", before(["src", "head"], "slice")).join(heads, F.col("src").eqNullSafe(F.col("hs")) & (F.col("head") == F.col("hh"))).select(F.col("src").alias("os"), F.col("slice").alias("oslice"), (F.col("inner") + F.col("offset")).alias("offset"))
    running = F.coalesce(F.sum(F.col("size") * F.col("k")).over(Window.partitionBy("src", "slice").orderBy("key", "size", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sliced.withColumn("inside", running).join(offsets, F.col("src").eqNullSafe(F.col("os")) & (F.col("slice") == F.col("oslice"))).withColumn("start", F.col("inside") + F.col("offset"))
    # a row for each copy, in chunks, which of very many copies go to several tasks
    last = ((F.col("k") - 1) / CHUNK).cast("int")
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    if most > 64 * CHUNK:
        placed = placed.repartition("key", "chunk")
    copy = F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("k").cast("int")) - 1)
    placed = placed.withColumn("copy", F.explode(copy)).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size") - F.col("start")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(F.col("id").alias(id_col), F.col("src").alias(source_col), "size", F.col("source_size"), "target", taken.cast("long").alias("taken"), F.col("start").cast("long").alias("start"))


#: The same in SQL: a plain running sum over each source.
SQL = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
u AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, cap * rest <= (total - below) * w AS is_full FROM u),
t AS (SELECT *, CASE WHEN is_full THEN cap ELSE least(cap, (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w / sum(CASE WHEN NOT is_full THEN w END) OVER ()) END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, budget - passes * source_size - start)) AS BIGINT) AS taken FROM q"""
