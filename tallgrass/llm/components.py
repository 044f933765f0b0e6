"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpoint, dealt

#: Nodes that are broadcast, of about 100 bytes each; edges of a node that meet in one task.
SMALL, PART = 200_000, 4096


def least_of_component(member: DataFrame) -> DataFrame:
    """member (node, component, least; a row a node) with component_id, the least `least` of its component (null last).

    A component of very many nodes is dealt into parts, unless the components are few enough to be broadcast.
    """
    ids = checkpoint(member.groupBy("component").agg(F.min("least").alias("component_id")))
    if ids.count() <= SMALL:
        return member.join(F.broadcast(ids), "component")
    salted, copied = dealt(member, ["component"], PART, F.xxhash64("node"))
    return salted.join(copied(ids), ["component", "salt"]).drop("salt")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v), any order, of one orderable type -> (node, component), component the smallest node reached.

    Every node that stands in an edge u != v gets one row; nodes without such an edge get none. Null
    ends, loops and repeated edges are ignored. No edge list, component or neighbourhood is ever gathered in one
    place: a star's centre is a minimum (pre-aggregated), and is joined back on the node, by a broadcast of up to SMALL
    nodes, or else with the edges of a node of more than PART dealt into parts. Each step is checkpointed.
    """
    e = checkpoint(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def measure(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    def centred(x: DataFrame, least: DataFrame, edges: int) -> DataFrame:
        if 2 * edges <= SMALL:
            return x.join(F.broadcast(least), "u")
        salted, copied = dealt(x, ["u"], PART, F.xxhash64("v"))
        return salted.join(copied(least), ["u", "salt"]).drop("salt")

    state = measure(e)
    while state[0]:
        # large star: every larger neighbour of a node goes to the least of its neighbourhood
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = centred(both, least, state[0]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if 2 * state[0] > SMALL:
            large = checkpoint(large)
        # small star: every smaller neighbour of a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = centred(large, least, state[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        e = checkpoint(small)
        before, state = state, measure(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
