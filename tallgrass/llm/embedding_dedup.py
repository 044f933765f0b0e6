"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Unit vectors at cosine c are sqrt(2 - 2c) apart. A hash is floor((a . v + b) / w) with Gaussian a and uniform b;
two vectors at distance d agree in it with the probability p(d / w) of Datar et al. K such hashes are
a bucket key, and T tables have independent keys. K grows with the logarithm of the number of vectors, so that a
bucket holds a few unrelated vectors; T is set so that a pair at the threshold itself meets
in some table with probability `recall`, and nearer pairs almost surely.

Vectors of a bucket are compared by blocks of BLOCK: a bucket of more is dealt into parts, and each pair
of parts is a block of its own, so no task holds a whole large bucket and no pair is left out. A block gives,
for each of its vectors, how many links it found, and the component of the links inside the block; a pair is
counted in the first table in which it meets. Equal vectors are one vector with a count.

Near vectors share many tables. A bucket that holds the very vectors of a bucket in an earlier table (told by their number
and two sums of hashes) is left out before any vector is sent, and a block whose vectors all met in one earlier bucket is not
compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, least_of_component
from .session import bounded_batches, checkpoint, dealt

#: Width of a hash's steps, for unit vectors.
STEP = 2.0
#: Vectors of a part of a bucket.
BLOCK = 256
#: Rows of one vector that meet in a task when results go back to rows.
PART = 512


def agree(distance: float, step: float = STEP) -> float:
    """Probability that two vectors so far apart have the same p-stable hash."""
    r = step / distance
    cdf = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """K and T for n vectors: unrelated (orthogonal) ones meet about once in a table of n."""
    near, far = agree(math.sqrt(2 - 2 * cosine)), agree(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**k))))


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows whose vector has a direction, and these in double precision at length 1."""
    rows, units = [], []
    for i, x in enumerate(column):
        if not x.is_valid:
            continue
        v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not len(v) or not np.isfinite(v).all():
            continue
        top = np.abs(v).max()
        if top > 0:
            v = v / top
            rows.append(i)
            units.append(v / np.sqrt(v @ v))
    return np.array(rows, np.int64), units


def _keys(units: list[np.ndarray], k: int, t: int, seed: int) -> np.ndarray:
    """The T bucket keys of each vector; they depend on the vector's length too."""
    out = np.zeros((len(units), t), np.int64)
    size = np.array([len(u) for u in units])
    for d in np.unique(size).tolist():
        of = np.flatnonzero(size == d)
        rng = np.random.default_rng([seed, d])
        a, b = rng.normal(size=(d, k * t)), rng.uniform(0, STEP, k * t)
        factor = rng.integers(1, 2**62, size=(t, k)) | 1
        for lo in range(0, len(of), 512):
            part = of[lo : lo + 512]
            cell = np.floor((np.stack([units[i] for i in part]) @ a + b) / STEP).astype(np.int64).reshape(len(part), t, k)
            h = (cell * factor).sum(2).astype(np.uint64) ^ np.uint64(d * 0x9E3779B1)
            out[part] = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)).astype(np.int64)
    return out


def _links(x: np.ndarray, y: np.ndarray | None, kx: np.ndarray, ky: np.ndarray | None, table: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of x (or of x and y) at that cosine or above that met in no table before this one."""
    every = kx[:, :table] if ky is None else np.concatenate([kx[:, :table], ky[:, :table]])
    if table and (every == every[0]).all(0).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = x @ (x if y is None else y).T
    i, j = np.nonzero(c >= cosine)
    if y is None:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        new = np.ones(len(i), bool)
        for lo in range(0, len(i), 4096):
            s = slice(lo, lo + 4096)
            new[s] = ~(kx[i[s], :table] == (kx if ky is None else ky)[j[s], :table]).any(1)
        i, j = i[new], j[new]
    return i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.995, seed: int = 11) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (least id reachable) and kept of every row.

    Two rows link if their cosine, in double precision, is at least `cosine` and they meet in a table.
    A vector that is null, empty, zero or holds a null or non-finite component links with nothing, and vectors of different
    lengths don't link. Repeated ids are rows of their own. A null id is a component only if no row reachable has an
    id. Other columns are left aside, whatever their names; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # equal vectors are one node
    rows = checkpoint(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("more", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))))
    nodes = rows.where("node is not null").groupBy("node", "more").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes = checkpoint(nodes.select(F.struct("node", "more").alias("node"), "copies", "least", "v"))
    k, t = plan(nodes.count(), cosine, recall)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, units = _unit(batch.column(2))
            if len(at):
                keys = _keys(units, k, t, seed)
                node, copies = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([node, copies, pa.array([u.tobytes() for u in units], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "copies", "u", "keys"])

    hashed = checkpoint(nodes.select("node", "copies", "v").mapInArrow(hash_, "node struct<node:bigint,more:bigint>, copies long, u binary, keys array<bigint>"))
    placed = hashed.select("node", F.posexplode("keys").alias("table", "key"))
    # buckets of one vector link nothing; larger ones are dealt into parts
    sums = [F.bit_xor(F.xxhash64("node")).alias("s1"), F.sum(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 32))).alias("s2")]
    crowded = placed.groupBy("table", "key").agg(F.count("*").alias("count"), *sums).where("count > 1")
    # of buckets of the same vectors, that of the first table
    crowded = crowded.groupBy("count", "s1", "s2").agg(F.min(F.struct("table", "key")).alias("b"))
    crowded = crowded.select("b.table", "b.key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    member = placed.join(crowded, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    member = member.select("node", "table", "key", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    member = member.select("node", "table", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    blocks = member.join(hashed, "node").withColumn("block", F.xxhash64("table", "key", "low", "high"))
    blocks = blocks.select("block", "table", "key", "low", "high", "own", "node", "copies", "u", "keys").repartition("block").sortWithinPartitions("block", "table", "key", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        last = None

        def block_of(batch: pa.RecordBatch) -> np.ndarray:
            return np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)

        def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            name = np.stack([whole.column(c).to_numpy() for c in range(5)], axis=1)
            edge = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
            out_at, out_root, out_n = [], [], []
            copies_of = whole.column("copies").to_numpy()
            own_of = whole.column("own").to_numpy()
            u, keys = whole.column("u").combine_chunks(), whole.column("keys").combine_chunks()
            keys = keys.flatten().to_numpy().reshape(len(name), t)
            for lo, hi in zip(np.append(0, edge).tolist(), np.append(edge, len(name)).tolist(), strict=True):
                n = hi - lo
                if n < 2:
                    continue
                x = np.stack([np.frombuffer(u[r].as_buffer(), np.float64) for r in range(lo, hi)])
                table, low, high = int(name[lo, 1]), name[lo, 3], name[lo, 4]
                if low == high:
                    i, j = _links(x, None, keys[lo:hi], None, table, cosine)
                else:
                    a, b = np.flatnonzero(own_of[lo:hi] == low), np.flatnonzero(own_of[lo:hi] == high)
                    i, j = _links(x[a], x[b], keys[lo:hi][a], keys[lo:hi][b], table, cosine)
                    i, j = a[i], b[j]
                if len(i):
                    copies = copies_of[lo:hi]
                    links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
                    some = np.flatnonzero(links)
                    out_at.append(some + lo)
                    out_root.append(_roots(n, i, j)[some] + lo)
                    out_n.append(links[some])
            if out_at:
                node = whole.column("node").combine_chunks()
                at, root = np.concatenate(out_at), np.concatenate(out_root)
                yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(root)), pa.array(np.concatenate(out_n).astype(np.int64))], names=["node", "root", "links"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                name = block_of(part)
                # all but the last block of what was read so far is complete
                change = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
                cut = int(change[-1]) if len(change) else 0
                if last is not None and (name[0] != last).any() and open_:
                    yield from work(open_)
                    open_ = []
                if cut:
                    yield from work([*open_, part.slice(0, cut)])
                    open_ = []
                open_.append(part.slice(cut))
                last = name[-1]
        if open_:
            yield from work(open_)

    kind = "struct<node:bigint,more:bigint>"
    found = checkpoint(blocks.mapInArrow(compare, f"node {kind}, root {kind}, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = least_of_component(nodes.select("node", "least").join(whole, "node")).select("node", "component_id", F.lit(True).alias("linked"))
    # a vector with a direction also links with its own copies
    turned = hashed.select("node").withColumn("turned", F.lit(True))
    member = nodes.select("node", "copies", "least").join(links, "node", "left").join(named, "node", "left").join(turned, "node", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least"))
    member = member.select("node.node", "node.more", "turned", component.alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # copies of one vector can be a large part of all rows: they are dealt into parts by their place among the checkpointed rows
    salted, copied = dealt(rows.where("node is not null").select("id", "node", "more"), ["node", "more"], PART, F.monotonically_increasing_id(), nodes.select("node.node", "node.more", F.col("copies").alias("count")))
    full = salted.join(copied(member), ["node", "more", "salt"]).select("id", "turned", "component_id", "links")
    full = full.union(rows.where("node is null").select("id", F.lit(None), "id", F.lit(0)))
    component = F.when(F.col("turned"), F.col("component_id")).otherwise(F.col("id"))
    return full.select(F.col("id").alias(id_col), F.when(F.col("turned"), F.col("links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
