"""Two time axes: belief as of a sequence, instants resolved to sequences, stale citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import belief_state, believed_at


def seq_at(memories: DataFrame, instant: str) -> DataFrame:
    """One row: outcome Resolved (sequence), BeforeFirst or Unresolvable (an untimed row comes before any timed one).

    Times are compared as text, as they are stored.
    """
    m = memories.agg(
        F.max(F.when(F.col("recorded_at") <= instant, F.col("recorded_seq"))).alias("sequence"),
        F.min(F.when(F.col("recorded_at").isNull(), F.col("recorded_seq"))).alias("first_untimed"),
        F.count("*").alias("rows"),
    )
    outcome = F.when(F.col("sequence").isNotNull(), "Resolved").when(F.col("first_untimed").isNotNull(), "Unresolvable").otherwise("BeforeFirst")
    return m.select(outcome.alias("outcome"), "sequence", "first_untimed")


def belief_at(memories: DataFrame, digests: DataFrame, sequence: int) -> DataFrame:
    m = digests.select(F.col("digest").alias("record_digest")).distinct().join(memories, "record_digest")
    return m.select("record_digest", belief_state(F.lit(sequence), F.col("recorded_seq"), F.col("superseded_seq"), F.col("retracted_seq")).alias("belief"))


#: Digests that a scan is told by name: as many as Spark turns into separate equalities.
NAMED = 10


def lookup(memories: DataFrame, digests: DataFrame) -> DataFrame:
    """The records of the given digests (column digest); unknown ones give no row.

    A few are named in the scan, so that a stored table's row groups are skipped; more are joined.
    """
    few = [r.digest for r in digests.select("digest").distinct().limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return memories.where(F.col("record_digest").isin(few))
    return memories.join(digests.select(F.col("digest").alias("record_digest")).distinct(), "record_digest", "left_semi")


def current_as_of(memories: DataFrame, sequence: int, limit: int | None = None) -> DataFrame:
    out = memories.where(believed_at(F.lit(sequence), F.col("recorded_seq"), F.col("superseded_seq"), F.col("retracted_seq"))).orderBy("recorded_seq")
    return out.limit(limit) if limit else out


def valid_in_window(memories: DataFrame, first: str, last: str, sequence: int, limit: int | None = None) -> DataFrame:
    """What was true in [first, last] and known by the sequence."""
    out = memories.where(F.col("occurred_at").between(first, last) & (F.col("recorded_seq") <= sequence)).orderBy("occurred_at", "recorded_seq")
    return out.limit(limit) if limit else out


def stale_citations(memories: DataFrame, edges: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """record_digest, cited, superseded_seq: edges to records that were retired before the citing one was written."""
    me = memories.select(F.col("record_digest").alias("src"), F.col("recorded_seq").alias("mine"))
    if digests is not None:
        me = me.join(digests.select(F.col("digest").alias("src")), "src", "left_semi")
    theirs = memories.where("superseded_seq IS NOT NULL").select(F.col("record_digest").alias("dst"), "superseded_seq")
    out = edges.join(me, "src").join(theirs, "dst").where("superseded_seq < mine")
    return out.select(F.col("src").alias("record_digest"), F.col("dst").alias("cited"), "superseded_seq").distinct()
