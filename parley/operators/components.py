"""Connected components by star contraction.

Alternating large-star and small-star steps hook every node to the least neighbour it knows
until each component is one star around its least node. A chain of n nodes takes about
log(n) rounds, a star takes one. Only end points of edges take part; isolated nodes are for
the caller to add. Every round is a group-by and a join on the node, both of which combine
or split hot nodes, and ends in a table in the shared folder, so lineage stays short and a
lost executor costs one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep

#: Far beyond what contraction needs for any graph that fits on disk; reaching it is a bug.
MAX_ROUNDS = 200


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, component) for every end point of ``edges``; component is the least node that
    can be reached. Null ends and loops are ignored; an empty table gives no row. Runs until
    a round changes nothing and raises if that never happens. ``rows`` is about the number of
    edges, if known: few edges then make few files."""
    e = keep(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), rows)
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hub, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = keep(small.unionByName(hub.select("u", F.col("m").alias("v"))).distinct(), rows=2 * state[0])
        before, state = state, _state(e)
        if state == before:
            roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
