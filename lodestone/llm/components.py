"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace

MOST_ROUNDS = 40


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc", rounds: int | None = None) -> DataFrame:
    """``edges``: a, b (orderable, one type).  Returns node, component (its smallest node).

    Alternates large and small star steps: every node hangs its larger, then its smaller
    neighbours on the smallest it knows.  Edges never become more than they were, and a
    node with many neighbours costs one minimum, computed map-side first.  Nodes
    without an edge to another node are not returned.  With ``rounds``, it stops after so
    many: nodes of one label are then connected, but a component may still have several.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, mark = ws.save(now, f"{name}0"), None
    for k in range(1, (rounds or MOST_ROUNDS) + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = ws.save(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"{name}{k}large")
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        step = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        step = ws.save(step, f"{name}{k}")
        seen = step.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        ws.drop(f"{name}{k - 1}", f"{name}{k}large")
        if (seen["n"], seen["h"]) == mark:
            break
        now, mark = step, (seen["n"], seen["h"])
    else:
        if not rounds:
            raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
        step = step.groupBy("a").agg(F.min("b").alias("b"))
    stars = step.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots if not rounds else roots.join(stars, "node", "left_anti"))
