"""Structure of graphs: blocks, bridges, articulation points, Louvain communities, best paths between two vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut, connected_components, undirected, vertices


def _forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, parent (NULL at a root) and level of breadth-first trees, one in each component; the edges both ways."""
    e = _cut(undirected(edges))
    kind = vertices(edges).schema["id"].dataType
    seen = front = _cut(connected_components(edges).where("id = component").select("id", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("level")))
    k = 0
    while True:
        k += 1
        step = front.select(F.col("id").alias("at")).join(e, F.col("at") == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("at").alias("parent"))
        front = _cut(step.join(seen, "id", "left_anti").withColumn("level", F.lit(k)))
        if front.isEmpty():
            return seen, e
        seen = _cut(seen.unionByName(front))


def blocks(edges: DataFrame) -> DataFrame:
    """id, parent, block and on_cycle of each edge of a spanning forest (id is the lower end).

    Tree edges on the cycle that an edge outside the forest closes belong together; classes of that relation are the
    biconnected components. Cycles are walked from both ends up to where they meet, all at once, and a pair of
    ends that was met before is not walked again: rounds are bounded by the forest's depth.
    """
    tree, e = _forest(edges)
    low, high = tree.select(F.col("id").alias("src"), F.col("parent").alias("ps"), F.col("level").alias("ls")), tree.select(F.col("id").alias("dst"), F.col("parent").alias("pd"), F.col("level").alias("ld"))
    outside = e.where("src < dst").join(low, "src").join(high, "dst").where("NOT (ps <=> dst OR pd <=> src)")
    # breadth-first: the ends are at most one level apart, and the deeper one goes up first
    steps = outside.selectExpr("CASE WHEN ls > ld THEN src WHEN ld > ls THEN dst END AS deep", "CASE WHEN ls > ld THEN ps ELSE src END AS a", "CASE WHEN ld > ls THEN pd ELSE dst END AS b")
    steps = _cut(steps.select("deep", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("deep").isNotNull(), F.lit(True)).alias("_up")))
    up = tree.select("id", "parent")
    links = _cut(steps.where("deep IS NOT NULL").select(F.col("deep").alias("id")).join(up, "id").selectExpr("id AS src", "parent AS dst"))
    front = seen = _cut(steps.select("a", "b").distinct())
    while not front.isEmpty():
        lifted = front.join(up.selectExpr("id AS a", "parent AS pa"), "a").join(up.selectExpr("id AS b", "parent AS pb"), "b")
        lifted = _cut(lifted)
        apart = lifted.where("pa != pb")
        links = _cut(links.union(lifted.selectExpr("a AS src", "b AS dst")).union(apart.selectExpr("a AS src", "pa AS dst")).distinct())
        front = _cut(apart.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"))
        seen = _cut(seen.union(front))
    classes = connected_components(links).select("id", "component")
    return tree.where("parent IS NOT NULL").join(classes, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("block"), F.col("component").isNotNull().alias("on_cycle"))


def bridges(edges: DataFrame) -> DataFrame:
    """src and dst (src < dst) of undirected edges on no cycle."""
    return blocks(edges).where("NOT on_cycle").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))


def articulation_points(edges: DataFrame) -> DataFrame:
    """id of vertices in more than one block: without one, its component falls apart."""
    ends = blocks(edges).select(F.explode(F.array("id", "parent")).alias("id"), "block")
    return ends.groupBy("id").agg(F.countDistinct("block").alias("n")).where("n > 1").select("id")


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 12, levels: int = 6) -> tuple[DataFrame, float]:
    """(id, community: its least vertex) and the modularity, of undirected edges.

    In a round, of the vertices that gain by moving to a neighbouring community, those that a hash picks move, so that
    neighbours seldom swap places; the best round is kept. Communities then become vertices, until modularity no longer grows.
    """
    e = _cut(undirected(edges).withColumn("w", F.lit(1.0)))
    whole = _cut(vertices(edges).withColumn("c", F.col("id")))
    m2 = float(e.count())
    if m2 == 0:
        return whole.withColumnRenamed("c", "community"), 0.0

    def quality(labels: DataFrame) -> float:
        a, b = labels.select(F.col("id").alias("src"), F.col("c").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        sums = e.join(a, "src").join(b, "dst").groupBy("ca").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
        return sums.agg(F.sum(F.col("inside") / m2 - resolution * F.col("k") * F.col("k") / (m2 * m2))).first()[0]

    last = None
    for _ in range(levels):
        degree = _cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        labels = _cut(degree.withColumn("c", F.col("id")))
        best, best_q, stale = labels, quality(labels), 0
        last = best_q if last is None else last
        for r in range(rounds):
            total = labels.groupBy("c").agg(F.sum("k").alias("tot"))
            near = e.where("src != dst").join(labels.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c", "w")
            options = near.union(labels.select("id", "c", F.lit(0.0))).groupBy("id", "c").agg(F.sum("w").alias("kin"))
            own = labels.select("id", "k", F.col("c").alias("own"))
            scored = options.join(own, "id").join(total, "c").withColumn("gain", F.col("kin") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2)
            chosen = scored.groupBy("id", "k", "own").agg(F.min(F.struct((-F.col("gain")).alias("g"), (F.col("c") != F.col("own")).alias("o"), F.col("c").alias("c"))).alias("s"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
            wish = _cut(chosen.withColumn("gains", -F.col("s.g") > F.col("stay") + 1e-9))
            if wish.where("gains").isEmpty():
                break
            go = F.col("gains") & (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0)
            labels = _cut(wish.select("id", "k", F.when(go, F.col("s.c")).otherwise(F.col("own")).alias("c")))
            q = quality(labels)
            best, best_q, stale = (labels, q, 0) if q > best_q + 1e-12 else (best, best_q, stale + 1)
            if stale > 3:
                break
        if best_q <= last + 1e-9:
            break
        last = best_q
        to = best.select(F.col("id").alias("_from"), F.col("c").alias("_to"))
        whole = _cut(whole.join(to, whole["c"] == F.col("_from"), "left").select("id", F.coalesce("_to", "c").alias("c")))
        e = _cut(e.join(best.select(F.col("id").alias("src"), F.col("c").alias("ca")), "src").join(best.select(F.col("id").alias("dst"), F.col("c").alias("cb")), "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("w").alias("w")))
    names = whole.groupBy("c").agg(F.min("id").alias("community"))
    return whole.join(names, "c").select("id", "community"), last


def _best_paths(e: DataFrame, starts: list[tuple], banned: list[tuple], target: object, heuristic: DataFrame | None) -> list[tuple[float, list, list]]:
    """(distance, path, costs) of the shortest path of each start (key, path, costs) to target, if there is one.

    States that cannot beat the best path of their key so far, by distance and heuristic, are not carried on.
    """
    spark, kind = e.sparkSession, e.schema["src"].dataType.simpleString()
    front = spark.createDataFrame([(k, p[-1], c[-1], p, c) for k, p, c in starts], f"key int, id {kind}, d double, path array<{kind}>, costs array<double>")
    no = F.broadcast(spark.createDataFrame(banned, f"key int, src {kind}, dst {kind}"))
    best = front = _cut(front)
    while not front.isEmpty():
        step = front.join(e, front["id"] == e["src"]).where(~F.array_contains("path", F.col("dst"))).join(no, ["key", "src", "dst"], "left_anti")
        d = F.col("d") + F.col("weight")
        moved = step.select("key", F.col("dst").alias("id"), d.alias("d"), F.array_append("path", F.col("dst")).alias("path"), F.array_append("costs", d).alias("costs"))
        near = moved.groupBy("key", "id").agg(F.min(F.struct("d", "path", "costs")).alias("s"))
        old = best.select("key", "id", F.struct("d", "path", "costs").alias("o"))
        both = _cut(near.join(old, ["key", "id"], "full").withColumn("fell", F.col("s").isNotNull() & (F.col("o").isNull() | (F.col("s.d") < F.col("o.d")))))
        best = both.select("key", "id", F.when(F.col("fell"), F.col("s")).otherwise(F.col("o")).alias("x")).select("key", "id", "x.*")
        bound = best.where(F.col("id") == target).select("key", F.col("d").alias("_bound"))
        fell = both.where("fell").select("key", "id", "s.*").where(F.col("id") != target).join(F.broadcast(bound), "key", "left")
        if heuristic is not None:
            fell = fell.join(heuristic.select("id", "h"), "id", "left")
        rest = F.coalesce(F.col("h"), F.lit(0.0)) if heuristic is not None else F.lit(0.0)
        front = _cut(fell.where(F.col("_bound").isNull() | (F.col("d") + rest < F.col("_bound"))).select("key", "id", "d", "path", "costs"))
    # at most one row for each key
    return [(r.d, r.path, r.costs) for r in best.where(F.col("id") == target).collect()]


def _weighted(edges: DataFrame) -> DataFrame:
    e = _cut(edges.where("src != dst").groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight")))
    if not e.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    return e


def shortest_path_to(edges: DataFrame, start: object, target: object, heuristic: DataFrame | None = None) -> DataFrame:
    """distance and path (an array of vertices); no row if target is not reached.

    heuristic (id, h), if given, must never exceed the distance from id to target; it keeps states away that cannot win, as A* does.
    """
    e = _weighted(edges)
    return _paths(e, _best_paths(e, [(0, [start], [0.0])], [], target, heuristic)).drop("rank")


def _paths(e: DataFrame, found: list[tuple]) -> DataFrame:
    kind = e.schema["src"].dataType.simpleString()
    return e.sparkSession.createDataFrame([(i + 1, float(d), list(p)) for i, (d, p, *_) in enumerate(found)], f"rank int, distance double, path array<{kind}>")


def k_shortest_paths(edges: DataFrame, start: object, target: object, k: int) -> DataFrame:
    """rank, distance and path of the k shortest paths without loops, ties by path; fewer if there are fewer.

    The detours of one path are all searched at once, keyed by where they leave it; the driver holds the k paths and the detours found so far.
    """
    e = _weighted(edges)
    found = _best_paths(e, [(0, [start], [0.0])], [], target, None)
    waiting: dict[tuple, tuple] = {}
    while found and len(found) < k:
        _, path, costs = found[-1]
        starts = [(i, path[: i + 1], costs[: i + 1]) for i in range(len(path) - 1)]
        banned = sorted({(i, p[i], p[i + 1]) for i in range(len(path) - 1) for _, p, _ in found if p[: i + 1] == path[: i + 1] and len(p) > i + 1})
        for d, p, c in _best_paths(e, starts, banned, target, None) if starts else []:
            waiting[tuple(p)] = (d, p, c)
        if not waiting:
            break
        best = min(waiting.values(), key=lambda x: (x[0], x[1]))
        found.append(waiting.pop(tuple(best[1])))
    return _paths(e, found[:k])
