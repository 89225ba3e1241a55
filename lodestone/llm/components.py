"""Connected components by alternating large-star and small-star steps, each step's edges written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace


def _mins(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, ws: Workspace, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long): the smallest node that links reach.

    A node's neighbours are never gathered: their minimum is a partial aggregate, joined back.
    """
    now = ws.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges0", narrow=True)
    before = None
    for k in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = ws.save(large, f"large{k}", narrow=True)
        small = large.join(_mins(large), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = ws.save(small, f"edges{k}", narrow=True)
        ws.drop(f"large{k}")
        ws.drop(f"edges{k - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise ValueError(f"components aren't settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
