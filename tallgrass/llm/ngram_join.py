"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text is a set of hashed word shingles. All sets are put in one global order, rare shingles
first. With a similarity of at least t, a set of n shingles shares at least ceil(t * n) with any
partner, so both share at least l shingles of their first n - ceil(t * n) + l (the l-prefix). Each
document takes the l from 1 to MAX_MATCHES whose estimated cost is least: entries to be read in the prefix,
and sets to be compared, of which a longer prefix with more matches leaves fewer. Two sets of n and m
are compared if they share at least the smaller of their two l in their first n - a + l and m - a + l, where
a is the overlap that sets of these two sizes need; this is exact, and a part of both prefixes.

Rare-first needs frequencies. They come from a sketch of fixed size over all texts; as any order
that all documents share is right, collisions in the sketch cost time and never a link.

Documents of equal sets are one class. In each prefix entry's list the pivot is the class whose prefix entries are
shared most (of near copies, the one edited least); a class is compared with the pivot it shares most entries with, and classes linked so are labelled
alike. Only pairs of different labels need the full join: pairs inside a label are connected
already, so a large group of near copies costs as many comparisons as it has members.

Sets are compared by 64-bit hashes; a class is its (64-bit sum of hashes, set size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, least_of_component
from .session import BROADCAST_ROWS, Written, bounded_batches, checkpoint, dealt
from .textblock import LOWER, NOT_SPACE, U, blocks, distinct, mix, prefix_hash, shingles, span_hash, words

#: The sketch has 2**SKETCH_BITS counters (4 bytes each: 4 MB), sent about in CHUNKS parts.
SKETCH_BITS, CHUNKS = 20, 64
#: Longest multi-match: l goes from 1 to this.
MAX_MATCHES = 4
#: Cost of comparing two sets, in prefix entries read.
COMPARE_COST = 20.0
#: Rows of one class, pairs of one class and entries of one token that meet in a task; what is more is dealt into parts.
PART = 512


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, the distinct shingle hashes of these rows, and how many up to each row."""
    for i, j, part, offsets in blocks(column):
        low = LOWER[part]
        start, end, per_row = words(low, offsets, NOT_SPACE)
        h, row = shingles(span_hash(prefix_hash(low), start, end), per_row, n)
        yield i, j, *distinct(h, row, j - i)


def fingerprints(h: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x5851F42D4C957F2D)), dtype=U)])
    return (sums[per_row[1:]] - sums[per_row[:-1]]).view(np.int64)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles that a set of n shares at least with any partner of that similarity."""
    return -(-n * percent // 100)


def choose_prefixes(counts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """The l of each row. counts: of the first n - least_overlap(n) + MAX_MATCHES entries of each row in the
    global order, as a matrix padded with 0; sizes: n."""
    # against a partner of its own size only so many entries count, less l
    base = sizes + -2 * sizes * percent // (100 + percent)
    best = np.ones(len(sizes), np.int64)
    read = np.concatenate([np.zeros((len(sizes), 1)), np.cumsum(counts, axis=1)], axis=1)
    least = None
    for l in range(1, MAX_MATCHES + 1):  # noqa: E741
        fits = base + l <= sizes
        scanned = read[np.arange(len(sizes)), np.minimum(base + l, counts.shape[1])]
        # a candidate takes at least l of the entries read
        cost = scanned + COMPARE_COST * scanned / l
        if least is None:
            least = cost
        else:
            better = fits & (cost < least)
            best[better], least = l, np.where(better, cost, least)
    return best


def _sketch(docs: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Counters of all shingles of all texts (each once a text), summed on the executors in two steps."""
    size = 1 << SKETCH_BITS
    width = size // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint32)
        some = 0
        for batch in batches:
            for _, _, h, _ in sets_of(batch.column(0), n):
                table += np.bincount((h >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
                some += len(h)
        if some:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "slot": pa.array([some % 16] * CHUNKS, pa.int32()), "part": pa.array([table[k * width : (k + 1) * width].tobytes() for k in range(CHUNKS)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, s, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                got = np.frombuffer(part, np.uint32).astype(np.uint32)
                # counters stop at the largest value: an order needs no more
                sums[k, s] = np.minimum(got.astype(np.uint64) + sums[k, s], 2**32 - 1).astype(np.uint32) if (k, s) in sums else got
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k for k, _ in sums], pa.int32()), "slot": pa.array([s for _, s in sums], pa.int32()), "part": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    kind = "chunk int, slot int, part binary"
    parts = docs.select(text_col).mapInArrow(count, kind)
    table = np.zeros(size, np.uint64)
    # no more than 16 sums of each chunk reach the driver
    for row in parts.repartition("chunk", "slot").mapInArrow(add, kind).toLocalIterator():
        table[row.chunk * width : (row.chunk + 1) * width] += np.frombuffer(row.part, np.uint32)
    return np.minimum(table, 2**32 - 1).astype(np.uint32)


def _postings(docs: DataFrame, text_col: str, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """token, s (fingerprint), nl (set size times 8, plus l) and p (rank in the order) of every prefix entry of every class."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for _, _, h, per_row in sets_of(batch.column(0), n):
                print_, size = fingerprints(h, per_row), np.diff(per_row)
                _, once = np.unique(print_, return_index=True)  # copies in one block are one class
                once = np.sort(once[size[once] > 0])
                if not len(once):
                    continue
                row = np.repeat(np.arange(len(size)), size)
                count = table[(h >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
                order = np.lexsort((h, count, row))
                h, count = h[order], count[order]
                longest = np.minimum(size - least_overlap(size, percent) + MAX_MATCHES, size)
                rank = np.arange(len(h)) - np.repeat(per_row[:-1], size)
                kept = rank < longest[row]
                l_of = np.ones(len(size), np.int64)
                # rows of like prefix lengths share a matrix
                for step in np.split(once[np.argsort(longest[once], kind="stable")], np.arange(256, len(once), 256)):
                    matrix = np.zeros((len(step), int(longest[step].max())))
                    for k, r in enumerate(step.tolist()):
                        matrix[k, : longest[r]] = count[per_row[r] : per_row[r] + longest[r]]
                    l_of[step] = choose_prefixes(matrix, size[step], percent)
                length = np.minimum(size - least_overlap(size, percent) + l_of, size)
                chosen = np.zeros(len(size), bool)
                chosen[once] = True
                kept = kept & (rank < length[row]) & chosen[row]
                at = row[kept]
                yield pa.RecordBatch.from_arrays([pa.array(h[kept].view(np.int64)), pa.array(print_[at]), pa.array(size[at] * 8 + l_of[at]), pa.array(rank[kept].astype(np.int32))], names=["token", "s", "nl", "p"])

    return docs.select(text_col).mapInArrow(emit, "token long, s long, nl long, p int")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b: structs s, n; checkpointed) whose sets are similar enough, by comparing whole sets. sets has a row a class."""
    # a class of very many pairs, as is the pivot of a large group, is dealt into parts on either side
    salted, copied_a = dealt(pairs, ["a"], PART, F.xxhash64("b"))
    salted, copied_b = dealt(salted.withColumnRenamed("salt", "sa"), ["b"], PART, F.xxhash64("a"))
    left = copied_a(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))).withColumnRenamed("salt", "sa")
    right = copied_b(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")))
    both = salted.join(left, ["a", "sa"]).join(right, ["b", "salt"]).select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    node = "struct<s:bigint,n:int>"
    return both.mapInArrow(compare, f"a {node}, b {node}")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """id, n_shingles and component_id (least id reachable by links) of every row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text's set is its
    distinct shingles of n words; with fewer words the whole sequence is one shingle. Two texts link
    when 100 * intersection >= percent * union. Null and empty texts have no shingles and link with nothing.
    Rows of one id are rows of their own texts and get a row each. A null id is the component only if no
    row reachable has an id. Other columns are left aside, whatever their names; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, per_row in sets_of(batch.column(1), n):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints(h, per_row)), pa.array(np.diff(per_row).astype(np.int32))], names=["id", "s", "n"])

    rows = checkpoint(docs.mapInArrow(describe, f"id {kind}, s long, n int"))
    classes = rows.where("n > 0").groupBy("s", "n").agg(F.min("id").alias("least"), F.count("*").alias("count"))

    # entries that stand alone meet no other; the rest is small. Of all entries there is one shuffle, and no table
    entries = _postings(docs, "text", n, percent, _sketch(docs, "text", n))
    often = entries.withColumn("entries", F.count("*").over(Window.partitionBy("token"))).where("entries > 1")
    node = F.struct("s", F.shiftright("nl", 3).cast("int").alias("n"))
    met = Written(often.select("token", node.alias("node"), F.col("nl").bitwiseAND(7).cast("int").alias("l"), "p").distinct())
    # how many of a class's prefix entries are shared, as a part of all
    length = F.col("node.n") - F.ceil(F.col("node.n") * percent / 100) + F.col("l")
    hub = met.df.groupBy("node").agg((F.count("*") / F.max(length)).alias("hub"))
    scored = met.df.join(hub, "node")
    lists = scored.groupBy("token").agg(F.max(F.struct("hub", "node")).alias("top"), F.count("*").alias("c")).where("c > 1")
    shared = Written(met.df.join(lists.select("token", F.col("top.node").alias("pivot")), "token"))
    met.drop()

    # each class and the pivot with which it shares most
    fits = F.col("b.n") * 100 >= F.col("a.n") * percent
    pair = lambda x, y: F.when(F.struct(x["n"], x["s"]) >= F.struct(y["n"], y["s"]), F.struct(x.alias("a"), y.alias("b"))).otherwise(F.struct(y.alias("a"), x.alias("b")))
    near = shared.df.where("node != pivot").groupBy("node", "pivot").count()
    near = near.groupBy("node").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot")).select(pair(F.col("node"), F.col("pivot")).alias("p")).select("p.a", "p.b").where(fits)
    near = checkpoint(near.distinct())

    def sets(pairs: DataFrame) -> DataFrame:
        """The sets of the classes in pairs, from one text of each."""
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        asked = checkpoint(asked.join(classes.select(F.struct("s", "n").alias("node"), "least"), "node").select("least").distinct())
        if asked.count() <= BROADCAST_ROWS:
            texts = docs.join(F.broadcast(asked), docs["id"].eqNullSafe(asked["least"]), "left_semi")
        else:  # rows of one id are dealt into parts by their place in the table, which a lost task finds again
            salted, copied = dealt(docs, ["id"], PART, F.monotonically_increasing_id())
            asked = copied(asked.withColumnRenamed("least", "id"))
            texts = salted.join(asked, salted["id"].eqNullSafe(asked["id"]) & (salted["salt"] == asked["salt"]), "left_semi")

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, h, per_row in sets_of(batch.column(0), n):
                    print_ = fingerprints(h, per_row)
                    once = np.sort(np.unique(print_, return_index=True)[1])  # copies in one block
                    yield pa.RecordBatch.from_arrays([pa.array(print_[once]), pa.array(np.diff(per_row)[once].astype(np.int32)), pa.array([h[s:e].tobytes() for s, e in zip(per_row[once], per_row[once + 1], strict=True)], pa.binary())], names=["s", "n", "hashes"])

        # rows of one id and copies of one text give a class's set more than once
        return texts.select("text").mapInArrow(emit, "s long, n int, hashes binary").groupBy(F.struct("s", "n").alias("node")).agg(F.first("hashes").alias("hashes"))

    first = Written(_verified(near, sets(near), percent))
    edge = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = connected_components(edge(first.df))

    # the full join, between classes of different labels
    marked = shared.df.select("token", "node", "l", "p").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = marked.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("low != high").select("token", "parts")
    marked = checkpoint(marked.join(mixed, "token").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int")))
    shared.drop()
    # a long list is dealt into parts, and any two parts (or one) are joined by themselves
    block = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    left = block.select("token", "low", "high", F.col("own").alias("oa"), F.col("node").alias("a"), F.col("l").alias("la"), F.col("p").alias("pa"), F.col("component").alias("ca"))
    right = block.select("token", "low", "high", F.col("own").alias("ob"), F.col("node").alias("b"), F.col("l").alias("lb"), F.col("p").alias("pb"), F.col("component").alias("cb"))
    # what sets of these sizes must share, and so how far into both prefixes shared entries count
    overlap = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    reach = (F.col("pa") < F.col("a.n") - overlap + F.least("la", "lb")) & (F.col("pb") < F.col("b.n") - overlap + F.least("la", "lb"))
    same = (left["token"] == right["token"]) & (left["low"] == right["low"]) & (left["high"] == right["high"]) & ((left["low"] == left["high"]) | (F.col("oa") != F.col("ob")))
    met = left.join(right, same & (F.col("ca") != F.col("cb")) & fits & reach & ((F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.s") > F.col("b.s")))))
    # sketch order, sizes and l are functions of the class, so counting tokens counts shared prefix entries
    rest = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.least("la", "lb")).alias("l")).where("c >= l").select("a", "b")
    rest = checkpoint(rest.join(near, ["a", "b"], "left_anti"))
    second = _verified(rest, sets(rest), percent)
    whole = connected_components(edge(first.df).union(edge(second)))
    first.drop()

    # of a component of classes, the least id of all its rows
    member = classes.select(F.struct("s", "n").alias("node"), "least").join(whole, "node").select("node", "component", "least")
    named = least_of_component(member).select(F.col("node.s").alias("s"), F.col("node.n").alias("n"), "component_id")
    alone = classes.join(named, ["s", "n"], "left").select("s", "n", F.coalesce("component_id", "least").alias("component_id"))
    # copies of one text can be a large part of all rows: they are dealt into parts by their place among the checkpointed rows
    salted, copied = dealt(rows.where("n > 0"), ["s", "n"], PART, F.monotonically_increasing_id(), classes)
    single = rows.where("n = 0").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return salted.join(copied(alone), ["s", "n", "salt"]).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id").union(single)
