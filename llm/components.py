"""Connected components of an edge table in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written

MAX_ROUNDS = 100
"""Far above any log of a node count; passing it is an error, never a partial result."""


def connected(edges: DataFrame) -> DataFrame:
    """Each linked node beside the smallest node it reaches.

    ``edges`` has long columns ``u`` and ``v``.  Returns ``node, root`` with
    one row per node of any edge between different nodes.  Alternating
    large-star and small-star rounds: every round joins edges with one
    minimum per node, so a hub's edges are split by adaptive execution rather
    than gathered.  Each round is a written table.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(lowest.select("u", F.least("u", "m").alias("m")), "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = written(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(),
            "small",
        )
        then, seen = seen, _state(now)
        if then == seen:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
