"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Edges are (u, v) with u > v, written before and after.

    large: every node sends its larger neighbours to its least neighbour (or itself). small: every node sends its smaller
    neighbours, and itself, to the least of them. The least neighbours are a table of their own, so that both sides of the join
    are plain exchanges and a node with very many edges is split over tasks.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", narrow=True)
        sent = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least", narrow=True)
        sent = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialise(sent.where("u != v").distinct(), "edges", narrow=True)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component): the least id that can be reached, for every node with an edge. `edges`: (a, b) in any order; loops and
    repeated edges are allowed, edges with a null end are not edges; no edges give no rows; other columns are ignored.

    The tables of all rounds but the last stay until the `scratch` around the call ends; each is at most as large as the edges.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u != v")
    now = materialise(pairs.distinct(), "edges", narrow=True)
    state = _state(now)
    for _ in range(most):
        if not state[0]:
            break
        now = _star(_star(now, True), False)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
