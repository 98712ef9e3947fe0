"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.scratch import drop, stash
from fathom.operators import small
from fathom.operators.small import fits, in_one_task


def _mark(edges: DataFrame) -> tuple:
    """Row count and an order-free digest; equal marks mean an unchanged edge set."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every pair (u, v) with the least label among u and its neighbours, and the stash of the labels.

    The labels are written, so that the join has two plain exchanges below it and
    a hub's pairs can be split by adaptive execution.
    """
    low = stash(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.join(low, "u"), low


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, component): component is the least node id reachable over undirected edges.

    Only nodes that have an edge to another node appear; null ends and self
    edges are passed over.  Each round halves the height of every tree, so the
    rounds grow with the logarithm of the largest diameter.  A round is two
    grouped minima with map-side combining and two joins on the node.  Every
    round is written to the shared folder, so a lost executor costs at most one
    round.  A graph of at most ``rows`` rows is done in one task.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    cur = stash(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    if fits(cur, rows=rows):
        kind = cur.schema["u"].dataType.simpleString()
        out = stash(in_one_task(cur, small.components, f"node {kind}, component {kind}"))
        drop(cur)
        return out
    mark = _mark(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, low = _least(both)
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        tight, lower = _least(large)
        nxt = stash(
            tight.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(tight.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        for x in (cur, low, lower):
            drop(x)
        cur, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    leaves = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
