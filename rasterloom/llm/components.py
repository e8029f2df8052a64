"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two partial minimums and two joins, so a node of any degree only sends minimums;
joins are left to adaptive execution, which splits a hot node's rows. Rounds are written to the
shared folder, so lineage stays short and executors may be lost."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges has u > v. Links every (larger, or smaller) neighbour to the least of the closed neighbourhood."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    out = out.select("u", "v", "m")
    if small:
        linked = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        linked = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v) with the least node that it reaches.
    Loops are ignored; no edges give no rows. Raises ``RuntimeError`` if ``rounds`` do not do."""
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = common.materialize(now, "edges")
    state, n = None, now.count()
    for _ in range(rounds):
        large = common.materialize(_star(now, small=False), "large-star", 2 * n)
        step = common.materialize(_star(large, small=True), "small-star", 2 * n)
        common.discard(now, large)
        now = step
        mark = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == state:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = mark
    raise RuntimeError("components did not settle")
