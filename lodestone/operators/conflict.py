"""Contradictions: pairs among candidates, classes of records that all contradict each other, obligations of an answer, and the gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import live


def contradictions(edges: DataFrame) -> DataFrame:
    """me, other for each contradicts edge, in both directions."""
    e = edges.where("edge_kind = 'contradicts'")
    return e.select(F.col("src").alias("me"), F.col("dst").alias("other")).union(e.select(F.col("dst"), F.col("src"))).distinct()


def classes(records: DataFrame, id_col: str, topic: str, side: str) -> DataFrame:
    """id, class, members, conflicts: records of one ``topic`` contradict each other where their ``side`` differs.

    A class of n records would be up to n * n / 2 pairs; here it is n rows. ``class`` is its smallest id,
    ``members`` its records and ``conflicts`` the records that contradict this one: the class less its own
    side. Records without a contradiction, or without a topic, aren't returned; a null side is one of its own.
    Sides are counted before they meet their class, so that a topic that many records share is no hot key.
    """
    sides = records.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic"), F.col(side).alias("side")).agg(F.count("*").alias("own"), F.min(id_col).alias("first"))
    whole = sides.groupBy("topic").agg(F.sum("own").alias("members"), F.min("first").alias("class"), F.count("*").alias("sides")).where("sides > 1")
    met = sides.join(whole.drop("sides"), "topic").select(F.col("topic").alias("__topic"), F.col("side").alias("__side"), "class", "members", (F.col("members") - F.col("own")).alias("conflicts"))
    mine = records.select(F.col(id_col).alias("id"), F.col(topic).alias("__topic"), F.col(side).alias("side"))
    return mine.join(met, (mine["__topic"] == met["__topic"]) & mine["side"].eqNullSafe(met["__side"])).select("id", "class", "side", "members", "conflicts")


def members(classed: DataFrame, asked: DataFrame) -> DataFrame:
    """id, other: what contradicts the ``asked`` ids (column id), from their classes; the answer of one question, not of all."""
    mine = classed.join(asked.select("id").distinct(), "id", "left_semi").select("id", "class", F.col("side").alias("mine"))
    return mine.join(classed.select("class", "side", F.col("id").alias("other")), "class").where(~F.col("mine").eqNullSafe(F.col("side"))).select("id", "other")


def conflicts_of(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """record_digest, conflicts: every record that contradicts a hit."""
    c = contradictions(edges)
    return hits.select("record_digest").distinct().join(c, F.col("record_digest") == F.col("me")).groupBy("record_digest").agg(F.sort_array(F.collect_set("other")).alias("conflicts"))


def conflicting_pairs(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b (a < b): contradictions with both sides among the candidates, before any truncation."""
    ids = candidates.select(F.col("record_digest").alias("id")).distinct()
    c = contradictions(edges).where("me < other")
    return c.join(ids, c["me"] == ids["id"], "left_semi").join(ids, c["other"] == ids["id"], "left_semi").select(F.col("me").alias("a"), F.col("other").alias("b"))


def obligations(cited: DataFrame, edges: DataFrame, memories: DataFrame) -> DataFrame:
    """cited, other, claim: live records that contradict a cited one."""
    m = memories.where(live(F.col("superseded_at"), F.col("retracted_at"))).select(F.col("record_digest").alias("other"), "claim")
    me = memories.select(F.col("record_digest").alias("me"))
    c = contradictions(edges).join(me, "me", "left_semi")
    return cited.select(F.col("digest").alias("me")).distinct().join(c, "me").join(m, "other").select(F.col("me").alias("cited"), "other", "claim").dropDuplicates(["cited", "other"]).orderBy("cited", "other")


def unmet(owed: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Obligations without an acknowledgement (a, b, resolution) of the pair, either way round and not blank."""
    pair = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    done = acknowledged.where(F.trim(F.coalesce("resolution", F.lit(""))) != "").select(*pair(F.col("a"), F.col("b"))).distinct()
    return owed.withColumn("lo", F.least("cited", "other")).withColumn("hi", F.greatest("cited", "other")).join(done, ["lo", "hi"], "left_anti").drop("lo", "hi")


def gate(owed: DataFrame, acknowledged: DataFrame) -> tuple[bool, list]:
    """Whether an answer may go out, and what it still owes; the obligations of one answer are few."""
    rows = unmet(owed, acknowledged).collect()
    return not rows, rows
