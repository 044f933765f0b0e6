"""Graph analytics on edge tables (src, dst, optional weight). Iterations are checkpointed, so lineage stays short."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def _grown(seen: DataFrame, front: DataFrame) -> DataFrame:
    """Both, cut; in no more parts than a shuffle has, as unions of many rounds would add up theirs."""
    return _cut(seen.unionByName(front).coalesce(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src != dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree and degree, by one aggregation of both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count("*").alias("degree"))


def bfs_levels(edges: DataFrame, start: object, directed: bool = True, limit: int | None = None) -> DataFrame:
    """id and level of all vertices reached from start, in at most limit steps if one is given."""
    e = edges.select("src", "dst").distinct() if directed else undirected(edges)
    seen = _cut(vertices(edges).where(F.col("id") == start).withColumn("level", F.lit(0)))
    front = seen
    for k in count(1) if limit is None else range(1, limit + 1):
        new = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = _cut(new.withColumn("level", F.lit(k)))
        if front.isEmpty():
            break
        seen = _grown(seen, front)
    return seen


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (its least vertex), by labels that spread and jump to the label's label."""
    e = _cut(undirected(edges))
    labels = _cut(vertices(edges).withColumn("component", F.col("id")))
    while True:
        near = e.join(labels, e["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("m"))
        low = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("j"), F.col("component").alias("to"))
        new = _cut(low.join(jump, low["component"] == jump["j"], "left").select("id", F.least("component", "to").alias("component"), "old"))
        changed = not new.where("component != old").isEmpty()
        labels = new.select("id", "component")
        if not changed:
            return labels


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """id and rank after a fixed number of rounds; ranks sum to 1, and vertices without out-edges give theirs to all."""
    v = _cut(vertices(edges))
    n = v.count()
    out = edges.groupBy("src").agg(F.count("*").alias("k"))
    e = _cut(edges.select("src", "dst").join(out, "src"))
    ranks = v.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        given = e.join(ranks, e["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        lost = ranks.join(out, ranks["id"] == out["src"], "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = v.join(given, v["id"] == given["dst"], "left").crossJoin(F.broadcast(lost))
        ranks = _cut(new.select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank")))
    return ranks


def triangles(edges: DataFrame) -> DataFrame:
    """id and the number of triangles through it; edges point from lower to higher degree, which bounds the join."""
    e = undirected(edges)
    d = e.groupBy("src").agg(F.count("*").alias("d"))
    a = e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    up = _cut(a.where((F.col("d") < F.col("d2")) | ((F.col("d") == F.col("d2")) & (F.col("src") < F.col("dst")))).select("src", "dst"))
    # a pair of ends is closed by the one edge between them, whichever way it points: ends are joined in one order
    x, y = up.alias("x"), up.alias("y")
    found = x.join(y, F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("top"), F.col("x.dst").alias("low"), F.col("y.dst").alias("high"))
    sides = up.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    corners = found.join(sides, ["low", "high"]).select(F.explode(F.array("top", "low", "high")).alias("id"))
    return corners.groupBy("id").agg(F.count("*").alias("triangles"))


# --- centralities ---


def degree_centrality(edges: DataFrame) -> DataFrame:
    """id and the three degrees over n - 1; a lone vertex has 1."""
    d = degrees(edges)
    n = vertices(edges).agg((F.count("*") - 1).alias("_n"))
    part = lambda c: F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.col(c) / F.col("_n")).alias(c)
    return d.crossJoin(F.broadcast(n)).select("id", part("out_degree"), part("in_degree"), part("degree"))


def _iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, tolerance: float | None) -> DataFrame:
    """Repeats a step on (id, x), each round checkpointed; stops early when the L1 change falls below the tolerance."""
    now = _cut(start)
    for _ in range(rounds):
        new = _cut(step(now))
        if tolerance is not None:
            before = now.select("id", F.col("x").alias("_x"))
            if (new.join(before, "id").agg(F.sum(F.abs(F.col("x") - F.col("_x")))).first()[0] or 0.0) < tolerance:
                return new
        now = new
    return now


def _from_neighbours(v: DataFrame, e: DataFrame, x: DataFrame) -> DataFrame:
    """id and the sum of x over the vertices that its out-edges lead to (0 without any)."""
    got = e.join(x, e["dst"] == x["id"]).groupBy("src").agg(F.sum("x").alias("got"))
    return v.join(got, v["id"] == got["src"], "left").select("id", F.coalesce("got", F.lit(0.0)).alias("x"))


def _scaled(df: DataFrame, by: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(by.alias("_by")))).select("id", F.when(F.col("_by") > 0, F.col("x") / F.col("_by")).otherwise(F.col("x")).alias("x"))


def _length() -> Column:
    return F.sqrt(F.sum(F.col("x") * F.col("x")))


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """id and score: power iteration over out-neighbours, of length 1 after each round."""
    v, e = _cut(vertices(edges)), _cut(edges.select("src", "dst").distinct())
    start = _scaled(v.withColumn("x", F.lit(1.0)), _length())
    return _iterate(start, lambda x: _scaled(_from_neighbours(v, e, x), _length()), rounds, tolerance).withColumnRenamed("x", "score")


def katz(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """id and score, the greatest being 1: beta plus alpha times the scores of out-neighbours, from 0 on."""
    v, e = _cut(vertices(edges)), _cut(edges.select("src", "dst").distinct())
    step = lambda x: _from_neighbours(v, e, x).select("id", (beta + alpha * F.col("x")).alias("x"))
    return _scaled(_iterate(v.withColumn("x", F.lit(0.0)), step, rounds, tolerance), F.max("x")).withColumnRenamed("x", "score")


def hits(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """id, hub and authority, each of length 1."""
    v, e = _cut(vertices(edges)), _cut(edges.select("src", "dst").distinct())
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    start = _scaled(v.withColumn("x", F.lit(1.0)), _length())
    authority = lambda hubs: _from_neighbours(v, back, hubs)
    step = lambda hubs: _scaled(_from_neighbours(v, e, authority(hubs)), _length())
    before = _iterate(start, step, rounds - 1, tolerance)
    last = _cut(_scaled(authority(before), _length()))
    hubs = _scaled(_from_neighbours(v, e, last), _length())
    return hubs.withColumnRenamed("x", "hub").join(last.withColumnRenamed("x", "authority"), "id")


# --- distances ---


def distances_from(edges: DataFrame, starts: DataFrame | None = None, directed: bool = True, limit: int | None = None) -> DataFrame:
    """start, id and distance in edges for all vertices reached from each start (all vertices by default), up to a limit if given.

    One row per pair that is reached, on disk and dealt over all tasks: a tree's are few, but where most vertices reach each
    other they grow with the square of the vertices.
    """
    e = _cut(edges.select("src", "dst").distinct() if directed else undirected(edges))
    chosen = vertices(edges) if starts is None else starts.select("id").distinct()
    seen = front = _cut(chosen.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")))
    for k in count(1) if limit is None else range(1, limit + 1):
        new = front.join(e, front["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        front = _cut(new.withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = _grown(seen, front)
    return seen


def closeness(edges: DataFrame, directed: bool = True) -> DataFrame:
    """id and (r / (n - 1)) * (r / sum of distances), r vertices being reached; 0 when there are none."""
    n = vertices(edges).agg((F.count("*") - 1).alias("_n"))
    d = distances_from(edges, directed=directed).groupBy(F.col("start").alias("id")).agg((F.count("*") - 1).alias("_r"), F.sum("distance").alias("_d"))
    score = F.coalesce(F.try_divide(F.col("_r") * F.col("_r"), F.col("_n") * F.col("_d")).cast("double"), F.lit(0.0))
    return d.crossJoin(F.broadcast(n)).select("id", score.alias("closeness"))


def eccentricity(edges: DataFrame, directed: bool = False) -> DataFrame:
    """id and the greatest distance from it; its maximum is the diameter, its minimum the radius."""
    return distances_from(edges, directed=directed).groupBy(F.col("start").alias("id")).agg(F.max("distance").alias("eccentricity"))


def shortest_paths(edges: DataFrame, start: object, rounds: int | None = None) -> DataFrame:
    """id, distance and parent (NULL at the start) over weighted edges, by relaxation until nothing changes.

    Only vertices whose distance fell pass it on. A negative cycle that is reached raises an error.
    """
    e = _cut(edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight")))
    v = vertices(edges)
    n = v.count() if rounds is None else rounds
    best = front = _cut(v.where(F.col("id") == start).select("id", F.lit(0.0).alias("distance"), F.lit(None).cast(v.schema["id"].dataType).alias("parent")))
    for _ in range(n + 1):
        if front.isEmpty():
            return best
        step = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("d"), F.col("src").alias("p"))
        near = step.groupBy("id").agg(F.min(F.struct("d", "p")).alias("_s")).select("id", "_s.d", "_s.p")
        joined = _cut(best.join(near, "id", "full").withColumn("fell", F.col("d").isNotNull() & (F.col("distance").isNull() | (F.col("d") < F.col("distance")))))
        best = joined.select("id", F.when(F.col("fell"), F.col("d")).otherwise(F.col("distance")).alias("distance"), F.when(F.col("fell"), F.col("p")).otherwise(F.col("parent")).alias("parent"))
        front = joined.where("fell").select("id", F.col("d").alias("distance"), F.col("p").alias("parent"))
    if not front.isEmpty() and rounds is None:
        raise ValueError("a negative cycle is reached")
    return best


# --- order and communities ---


def topological_levels(edges: DataFrame) -> DataFrame:
    """id and level: vertices without in-edges have 0, others one more than the last of their predecessors.

    Vertices on or behind a cycle have none and are left out: `has_cycle` asks for them.
    """
    left = _cut(edges.select("src", "dst").distinct())
    rest = _cut(vertices(edges))
    done, k = None, 0
    while True:
        free = _cut(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(k)))
        if free.isEmpty():
            return free if done is None else done
        done = free if done is None else _cut(done.unionByName(free))
        gone = free.select("id")
        rest = _cut(rest.join(gone, "id", "left_anti"))
        left = _cut(left.join(gone, left["src"] == gone["id"], "left_anti"))
        k += 1


def has_cycle(edges: DataFrame) -> bool:
    return topological_levels(edges).count() < vertices(edges).count()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id and label: all vertices take at once their neighbours' most frequent label, the least on ties."""
    e, labels = _cut(undirected(edges)), _cut(vertices(edges).withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = e.join(labels, e["dst"] == labels["id"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        won = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("new"))
        new = _cut(labels.join(won, labels["id"] == won["src"], "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("old")))
        labels = new.select("id", "label")
        if new.where("label != old").isEmpty():
            break
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, q, of undirected edges and (id, community): by sums of communities, never by pairs of vertices."""
    e = undirected(edges)
    a, b = communities.select(F.col("id").alias("src"), F.col("community").alias("ca")), communities.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    sums = e.join(a, "src").join(b, "dst").groupBy("ca").agg(F.count("*").alias("k"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    total = sums.agg(F.sum("k").alias("m2"))
    return sums.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), F.lit(2.0))), F.lit(0.0)).alias("q"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """id and component (least vertex of its strongly connected component).

    Rounds of colouring: each vertex takes the least vertex that reaches it; those that reach back to their colour
    inside it are a component and leave the graph.
    """
    rest, live = _cut(vertices(edges)), _cut(edges.select("src", "dst").where("src != dst").distinct())
    done = None
    while not rest.isEmpty():
        colour = _cut(rest.withColumn("c", F.col("id")))
        while True:
            got = live.join(colour, live["src"] == colour["id"]).groupBy("dst").agg(F.min("c").alias("m"))
            new = _cut(colour.join(got, colour["id"] == got["dst"], "left").select("id", F.least("c", "m").alias("c"), F.col("c").alias("old")))
            colour = new.select("id", "c")
            if new.where("c != old").isEmpty():
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        inside = _cut(live.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"))
        found = front = _cut(colour.where("id = c"))
        while True:
            back = front.join(inside, front["id"] == inside["dst"]).select(F.col("src").alias("id"), "c").distinct().join(found, ["id", "c"], "left_anti")
            front = _cut(back)
            if front.isEmpty():
                break
            found = _cut(found.unionByName(front))
        part = found.select("id", F.col("c").alias("component"))
        done = part if done is None else _cut(done.unionByName(part))
        gone = part.select("id")
        rest = _cut(rest.join(gone, "id", "left_anti"))
        live = _cut(live.join(gone, live["src"] == gone["id"], "left_anti").join(gone.withColumnRenamed("id", "_g"), F.col("dst") == F.col("_g"), "left_anti"))
    return rest.withColumn("component", F.col("id")) if done is None else done


def betweenness(edges: DataFrame, directed: bool = True) -> DataFrame:
    """id and betweenness scaled by 1 / ((n - 1)(n - 2)); counts of shortest paths are joined, so it is for small graphs."""
    n = vertices(edges).count()
    e = _cut(edges.select("src", "dst").where("src != dst").distinct() if directed else undirected(edges))
    d = distances_from(edges, directed=directed)
    paths = front = _cut(d.where("distance = 0").select("start", "id", "distance", F.lit(1.0).alias("paths")))
    while True:
        step = front.join(e, front["id"] == e["src"]).groupBy("start", F.col("dst").alias("id"), (F.col("distance") + 1).alias("distance")).agg(F.sum("paths").alias("paths"))
        front = _cut(step.join(d, ["start", "id", "distance"], "left_semi"))
        if front.isEmpty():
            break
        paths = _grown(paths, front)
    a = paths.select("start", F.col("id").alias("mid"), F.col("distance").alias("da"), F.col("paths").alias("pa"))
    b = paths.select(F.col("start").alias("mid"), F.col("id").alias("end"), F.col("distance").alias("db"), F.col("paths").alias("pb"))
    whole = paths.select("start", F.col("id").alias("end"), F.col("distance").alias("dw"), F.col("paths").alias("pw"))
    on = a.join(b, "mid").join(whole, ["start", "end"]).where("da > 0 and db > 0 and da + db = dw").groupBy(F.col("mid").alias("id")).agg(F.sum(F.col("pa") * F.col("pb") / F.col("pw")).alias("b"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return vertices(edges).join(on, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))
