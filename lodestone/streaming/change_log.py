"""Change logs as streams: exactly-once merging by cursor, batch or Structured Streaming.

Each micro-batch goes through one function that reads the stored cursor, keeps what lies after it,
refuses gaps and equivocation, merges the batch's own rows by key, and writes them as a part with the new
cursor as the batch's commit. A batch that is played again finds its cursor and changes nothing.

Merging is associative (the earliest creation, any tombstone), so a batch neither reads nor writes a record
that it doesn't name; readers merge the parts, and after ``FOLD`` of them a batch folds them into a base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.scalar import cursor_after
from lodestone.operators.personal import PersonalState, gaps, merge_divergences, merged, missing_predecessors
from lodestone.schemas import ConstraintError
from lodestone.sources.envelope import transition_fingerprint

WIRE = "epoch long, sequence long, operation string, content_digest string, content string, occurred_at string, metadata string, created_at string, tombstoned boolean"


@dataclass
class ImportOutcome:
    applied: bool
    epoch: int
    sequence: int


def import_bundle(state: PersonalState, payload: dict, changes: DataFrame, divergences: DataFrame | None = None) -> tuple[PersonalState, ImportOutcome]:
    """A verified bundle on top of a state.

    Older than the cursor: nothing happens. At the cursor: the same transition is a no-op (its
    divergences still merge), another one is equivocation. Beyond it: it must start at the cursor.
    """
    row = state["replica_cursor"].where(F.col("device") == payload["sourceDevice"]).first()
    at = (row.epoch, row.sequence) if row else (0, 0)
    through = (payload["through"]["epoch"], payload["through"]["sequence"])
    start = (payload["fromExclusive"]["epoch"], payload["fromExclusive"]["sequence"])
    mark = transition_fingerprint(payload)
    if divergences is not None and through >= at:
        state = state.having(personal_divergences=merge_divergences(state["personal_divergences"], divergences))
    if through < at:
        return state, ImportOutcome(False, *at)
    if through == at:
        if row and row.transition_fingerprint and row.transition_fingerprint != mark and payload["changes"]:
            raise ConstraintError("the peer shows two histories for one cursor")
        return state, ImportOutcome(False, *at)
    if start != at and not (start == (0, 0) and row is None):
        raise ConstraintError(f"the bundle starts at {start}, the cursor is {at}")
    if not gaps(changes, *start).isEmpty() or not changes.where(~F.col("operation").isin("upsert", "tombstone")).isEmpty():
        raise ConstraintError("the bundle has a gap or an unknown operation")
    last = changes.agg(F.max(F.struct("epoch", "sequence")).alias("last")).first().last
    if last is None or (last.epoch, last.sequence) != through:
        raise ConstraintError("the bundle doesn't end where it says")
    records = changes.select("content_digest", "content", "occurred_at", "metadata", "created_at", (F.col("tombstoned") | (F.col("operation") == "tombstone")).alias("tombstoned"))
    cursor = changes.sparkSession.createDataFrame([(payload["sourceDevice"], *through, mark)], state["replica_cursor"].schema)
    out = state.having(
        canonical_records=merged(state["canonical_records"].unionByName(records)),
        replica_records=state["replica_records"].union(records.select("content_digest")).distinct(),
        replica_cursor=state["replica_cursor"].where(F.col("device") != payload["sourceDevice"]).unionByName(cursor),
    )
    return out, ImportOutcome(True, *through)


#: Parts that a reader merges before a batch folds them into one.
FOLD = 16
HEAD = "version long, epoch long, sequence long, base long"


def _head(spark: SparkSession, root: str) -> tuple[int, int, int, int]:
    """(version, epoch, sequence, base): versions from base on are parts; heads from before parts name a whole."""
    try:
        last = spark.read.schema(HEAD).parquet(f"{root}/head").orderBy(F.desc("version")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return (last.version, last.epoch, last.sequence, last.base or last.version) if last else (0, 0, 0, 1)


def _parts(spark: SparkSession, root: str, base: int, version: int) -> DataFrame:
    return spark.read.parquet(*(f"{root}/records/v{v}" for v in range(base, version + 1)))


def advance(spark: SparkSession, root: str, batch: DataFrame) -> bool:
    """Merge one batch of wire rows into the table at ``root``; late and repeated rows fall to the cursor filter."""
    version, epoch, sequence, base = _head(spark, root)
    fresh = batch.where(cursor_after(F.col("epoch"), F.col("sequence"), epoch, sequence))
    end = fresh.agg(F.max(F.struct("epoch", "sequence")).alias("end")).first().end
    if end is None:
        return False
    fresh = fresh.distinct()  # a change that is played twice in one batch
    if not missing_predecessors(fresh, epoch, sequence).isEmpty():
        raise ConstraintError("the batch has a gap, or two changes in one place")
    rows = fresh.select("content_digest", "content", "occurred_at", "metadata", "created_at", (F.col("tombstoned") | (F.col("operation") == "tombstone")).alias("tombstoned"))
    if version - base + 1 >= FOLD:
        rows, base = _parts(spark, root, base, version).unionByName(rows), version + 1
    merged(rows).write.mode("overwrite").parquet(f"{root}/records/v{version + 1}")
    # the head row is the commit: a batch that failed before it is merged again from the old version
    spark.createDataFrame([(version + 1, end.epoch, end.sequence, base)], HEAD).coalesce(1).write.mode("append").parquet(f"{root}/head")
    return True


def current(spark: SparkSession, root: str) -> DataFrame:
    version, _, _, base = _head(spark, root)
    parts = _parts(spark, root, base, version)
    return merged(parts) if version > base else parts


def follow(changes: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A stream of wire rows merged batch by batch; without ``every`` it takes what is there and ends."""
    writer = changes.writeStream.foreachBatch(lambda df, _: advance(df.sparkSession, root, df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def work_queue(rows: DataFrame, step: Callable[[DataFrame], None], checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """The periodic worker: each trigger hands its bounded batch to ``step``."""
    return rows.writeStream.foreachBatch(lambda df, _: step(df)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
