"""Retrieval quality: recall at k and mean reciprocal rank, averaged within and over classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, relevant: DataFrame, recall_at: int = 5, rank_at: int = 10) -> DataFrame:
    """class, recall, mrr, queries from ranked (query_id, id, rank) and relevant (query_id, class, id)."""
    hits = relevant.join(ranked, ["query_id", "id"], "left")
    each = hits.groupBy("class", "query_id").agg(
        (F.count(F.when(F.col("rank") <= recall_at, 1)) / F.count("*")).alias("recall"),
        F.coalesce(F.max(F.when(F.col("rank") <= rank_at, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
    )
    return each.groupBy("class").agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.count("*").alias("queries"))


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, middle: each group's upper median from the counts of its distinct values, running in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    running = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", running).withColumn("all", F.sum("n").over(w))
    return placed.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(group).agg(F.min(value).alias("middle"))
