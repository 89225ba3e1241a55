"""Which texts contain which of a stated set of needles, without meeting every text with every needle.

A word of a needle that has other words, or gaps, on both sides stands as a whole word in every text that
contains the needle. Each needle is anchored at the rarest such word of the corpus; texts meet needles
by it, and only those pairs are compared as text. Needles without such a word (one or two words) have no
anchor: they, and only they, are compared with every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import words_of

#: Rows of words that are sent to every task; more are joined by key.
SMALL = 50_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def containing(texts: DataFrame, id_col: str, text_col: str, needles: DataFrame, needle_id: str, needle_col: str) -> DataFrame:
    """id, needle_id for every text that contains a needle; nulls contain nothing and are contained nowhere."""
    from lodestone.operators.stored import stored

    t = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = needles.where(F.col(needle_col).isNotNull()).select(F.col(needle_id).alias("needle_id"), F.col(needle_col).alias("needle"))
    inner = F.slice(words_of(F.col("needle")), 2, F.greatest(F.size(words_of(F.col("needle"))) - 2, F.lit(0)))
    words = stored(n.select("needle_id", F.explode(F.array_distinct(inner)).alias("word")))
    held = t.select("id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).join(_small(words.select("word").distinct()), "word", "left_semi")
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    # a word that no text holds is the rarest of all: its needle is in no text
    rarest = words.join(df, "word", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("best"))
    anchors = stored(rarest.where("best.df > 0").select("needle_id", F.col("best.word").alias("word")))
    met = stored(held.join(_small(anchors), "word").select("id", "needle_id").distinct())
    pairs = t.join(_small(met), "id").join(_small(n), "needle_id").where(F.contains("text", "needle")).select("id", "needle_id").distinct()
    short = stored(n.join(words.select("needle_id").distinct(), "needle_id", "left_anti"))
    if short.isEmpty():
        return pairs
    return pairs.unionByName(t.join(_small(short), F.contains("text", "needle")).select("id", "needle_id").distinct())
