"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: a node's larger (or else its smaller and itself) neighbours are hung on the least of all."""
    if large:
        seen = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = seen.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge (u, v): root is the least node that can be reached.

    Takes logarithmically many rounds; each is written to the shared folder, which cuts lineage.
    Loops and repeated edges are allowed; no edges give no rows; nulls are left out.
    """
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False), "edges")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            least = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return least.unionByName(roots)
        mark = tuple(row)
    raise RuntimeError(f"no fixed point in {rounds} rounds")
