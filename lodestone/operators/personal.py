"""The personal store: captures, merges, tombstones, divergences, queues and views, as frames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalar import ascii_like, canonical_instant, cursor_after
from lodestone.functions.seal import divergence_id
from lodestone.operators.keyed import appended
from lodestone.operators.stored import numbered_from_one
from lodestone.schemas import PERSONAL, ConstraintError, empty

ORIGIN = ["origin_device", "origin_id"]


@dataclass(frozen=True)
class PersonalState:
    """Every table of a personal store; operations return a new state."""

    tables: dict[str, DataFrame]

    @classmethod
    def new(cls, spark: SparkSession) -> PersonalState:
        t = {name: empty(spark, name) for name in PERSONAL}
        t["promotion_state"] = spark.createDataFrame([(1, 0)], PERSONAL["promotion_state"])
        return cls(t)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def having(self, **tables: DataFrame) -> PersonalState:
        return replace(self, tables=self.tables | tables)


def merged(records: DataFrame) -> DataFrame:
    """One row for each digest: the earliest creation, the tombstone if any has it; it never comes back."""
    return records.groupBy("content_digest").agg(F.first("content", True).alias("content"), F.first("occurred_at", True).alias("occurred_at"), F.first("metadata", True).alias("metadata"), F.min("created_at").alias("created_at"), F.max("tombstoned").alias("tombstoned"))


def sighting_counts(sightings: DataFrame) -> DataFrame:
    """content_digest, sightings: how often each record was seen."""
    return sightings.groupBy(F.col("record_digest").alias("content_digest")).agg(F.count("*").alias("sightings"))


def _check_origins(sightings: DataFrame) -> None:
    if not sightings.groupBy(*ORIGIN).agg(F.countDistinct("record_digest").alias("n")).where("n > 1").isEmpty():
        raise ConstraintError("an origin points to two records")


def merge(state: PersonalState, records: DataFrame, sightings: DataFrame, tags: DataFrame, local: bool = False) -> PersonalState:
    """Union of records, sightings and tags; local captures also number changes for promotion. Replays change nothing."""
    bad = records.where(~canonical_instant(F.col("created_at")) | (F.col("occurred_at").isNotNull() & ~canonical_instant(F.col("occurred_at"))))
    if not bad.isEmpty():
        raise ConstraintError("a time is not canonical")
    seen = state["sightings"].unionByName(sightings)
    _check_origins(seen)
    seen = appended(state["sightings"], sightings, ORIGIN)
    before = state["canonical_records"]
    everything = merged(before.unionByName(records))
    out = {"canonical_records": everything, "sightings": seen, "record_tags": state["record_tags"].unionByName(tags).distinct()}
    if not local:
        out["replica_records"] = state["replica_records"].union(records.select("content_digest")).distinct()
        return state.having(**out)
    captures = sightings.select(*ORIGIN, "record_digest")
    fresh = captures.join(state["captures"], ORIGIN, "left_anti")
    out["captures"] = state["captures"].unionByName(fresh.distinct())
    new = fresh.select("record_digest").distinct()
    return _number(state.having(**out), new, "upsert")


def _number(state: PersonalState, digests: DataFrame, operation: str) -> PersonalState:
    """Changes and outbox rows for ``digests``, numbered on from the state's cursor by one committer."""
    at = state["promotion_state"]
    rows = numbered_from_one(digests.select("record_digest"), "n", "record_digest").join(F.broadcast(at)).select("epoch", (F.col("sequence") + F.col("n")).alias("sequence"), "record_digest")
    last = rows.agg(F.max("sequence").alias("last"))
    return state.having(
        promotion_changes=state["promotion_changes"].unionByName(rows.select("epoch", "sequence", F.lit(operation).alias("operation"), "record_digest")),
        promotion_outbox=state["promotion_outbox"].unionByName(rows.withColumn("state", F.lit("pending"))),
        promotion_state=at.join(F.broadcast(last)).select("epoch", F.coalesce("last", "sequence").alias("sequence")),
    )


def forget(state: PersonalState, digest: str) -> PersonalState:
    """Tombstone of a local record, one change; a replica's record is refused, a second time changes nothing."""
    row = state["canonical_records"].where(F.col("content_digest") == digest).first()
    if row is None:
        raise ConstraintError("unknown record")
    if state["captures"].where(F.col("record_digest") == digest).isEmpty():
        raise ConstraintError("the record belongs to another device")
    if row.tombstoned:
        return state
    gone = state["canonical_records"].withColumn("tombstoned", F.col("tombstoned") | (F.col("content_digest") == digest))
    one = state["captures"].where(F.col("record_digest") == digest).select("record_digest").distinct()
    return _number(state.having(canonical_records=gone), one, "tombstone")


def export_changes(changes: DataFrame, epoch: int, sequence: int) -> DataFrame:
    """The changes after a cursor in order, to the end of the first epoch that has any."""
    after = changes.where(cursor_after(F.col("epoch"), F.col("sequence"), epoch, sequence))
    first = after.agg(F.min("epoch").alias("first"))
    return after.join(F.broadcast(first), F.col("epoch") == F.col("first"), "left_semi").orderBy("epoch", "sequence")


def acknowledge(state: PersonalState, epoch: int, sequence: int) -> PersonalState:
    at = state["promotion_state"].first()
    if (epoch, sequence) > (at.epoch, at.sequence):
        raise ConstraintError("acknowledges what was never allocated")
    done = ~cursor_after(F.col("epoch"), F.col("sequence"), epoch, sequence)
    return state.having(promotion_outbox=state["promotion_outbox"].withColumn("state", F.when(done, "promoted").otherwise(F.col("state"))))


def missing_predecessors(changes: DataFrame, epoch: int, sequence: int) -> DataFrame:
    """Changes whose predecessor in their epoch is missing, and those that share a place: joins by (epoch, sequence).

    The first change of the cursor's epoch follows the cursor, that of any other epoch follows 0.
    """
    start = F.when(F.col("epoch") == epoch, F.lit(sequence)).otherwise(F.lit(0))
    places = changes.groupBy("epoch", "sequence").agg(F.count("*").alias("__n"))
    after = places.select("epoch", (F.col("sequence") + 1).alias("sequence"), F.lit(True).alias("__follows"))
    wrong = places.join(after, ["epoch", "sequence"], "left").where((F.col("__follows").isNull() & (F.col("sequence") != start + 1)) | (F.col("__n") > 1))
    return changes.join(wrong.select("epoch", "sequence"), ["epoch", "sequence"], "left_semi")


def gaps(changes: DataFrame, epoch: int, sequence: int) -> DataFrame:
    """Changes of a bundle that don't follow their predecessor (the first: the cursor) by one, or lie beyond its first epoch."""
    first = changes.agg(F.min("epoch").alias("__first"))
    later = changes.join(F.broadcast(first), F.col("epoch") > F.col("__first"), "left_semi")
    return missing_predecessors(changes, epoch, sequence).unionByName(later).distinct()


def flag_divergence(state: PersonalState, a: str, b: str) -> PersonalState:
    if a == b:
        raise ConstraintError("a record can't diverge from itself")
    spark = state["personal_divergences"].sparkSession
    new = spark.createDataFrame([(a, b)], "a string, b string").select(divergence_id(F.col("a"), F.col("b")).alias("id"), F.least("a", "b").alias("digest_a"), F.greatest("a", "b").alias("digest_b"), F.lit("flagged").alias("status"), F.lit(None).cast("string").alias("acknowledged_at"))
    return state.having(personal_divergences=appended(state["personal_divergences"], new, ["id"]))


def merge_divergences(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """An acknowledgement wins and stays; its earliest time is kept."""
    acked = F.max(F.col("status") == "acknowledged")
    return mine.unionByName(theirs).groupBy("id", "digest_a", "digest_b").agg(F.when(acked, "acknowledged").otherwise("flagged").alias("status"), F.min("acknowledged_at").alias("acknowledged_at"))


def acknowledge_divergence(state: PersonalState, pair: str, at: str) -> PersonalState:
    hit = (F.col("id") == pair) & (F.col("status") != "acknowledged")
    d = state["personal_divergences"]
    return state.having(personal_divergences=d.withColumn("acknowledged_at", F.when(hit, at).otherwise(F.col("acknowledged_at"))).withColumn("status", F.when(hit, "acknowledged").otherwise(F.col("status"))))


def active(state: PersonalState) -> DataFrame:
    """Records that are neither forgotten nor in an open divergence."""
    open_ = state["personal_divergences"].where("status <> 'acknowledged'").select(F.explode(F.array("digest_a", "digest_b")).alias("content_digest"))
    return state["canonical_records"].where(~F.col("tombstoned")).join(open_, "content_digest", "left_anti")


def recall(state: PersonalState, limit: int, query: str | None = None, tag: str | None = None) -> DataFrame:
    """Active records by recency, with their tags and number of sightings; the limit is held to 1..100."""
    limit = max(1, min(100, limit))
    r = active(state)
    if query is not None:
        r = r.where(ascii_like(F.col("content"), query))
    tags = state["record_tags"].withColumnRenamed("record_digest", "content_digest")
    if tag is not None:
        r = r.join(tags.where(F.col("tag") == tag), "content_digest", "left_semi")
    top = r.orderBy(F.desc("created_at"), "content_digest").limit(limit)
    t = tags.groupBy("content_digest").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    s = sighting_counts(state["sightings"])
    out = top.join(t, "content_digest", "left").join(s, "content_digest", "left")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("sightings", F.coalesce("sightings", F.lit(0))).orderBy(F.desc("created_at"), "content_digest")


def local_records(state: PersonalState) -> DataFrame:
    """The records that this device captured itself."""
    return state["canonical_records"].join(state["captures"].select(F.col("record_digest").alias("content_digest")), "content_digest", "left_semi")


def replica_only(state: PersonalState) -> DataFrame:
    """record_digest of what only other devices brought."""
    return state["replica_records"].join(state["captures"].select("record_digest"), "record_digest", "left_anti")


def reset_replica(state: PersonalState) -> PersonalState:
    """The state without what only replicas brought, cursor included."""
    gone = replica_only(state)
    out = {}
    for name, key in (("canonical_records", "content_digest"), ("sightings", "record_digest"), ("record_tags", "record_digest"), ("personal_embeddings", "record_digest"), ("personal_embedding_queue", "record_digest"), ("personal_embedding_failures", "record_digest")):
        out[name] = state[name].join(gone.select(F.col("record_digest").alias(key)), key, "left_anti").select(*state[name].columns)
    d = state["personal_divergences"]
    for end in ("digest_a", "digest_b"):
        d = d.join(gone.select(F.col("record_digest").alias(end)), end, "left_anti").select(*d.columns)
    return state.having(**out, personal_divergences=d, replica_records=state["replica_records"].limit(0), replica_cursor=state["replica_cursor"].limit(0))


def bump_epoch(state: PersonalState) -> PersonalState:
    """A new epoch whose changes are a whole snapshot of the local records, numbered from 1 in order of digest."""
    mine = local_records(state)
    at = state["promotion_state"].select((F.col("epoch") + 1).alias("epoch"))
    rows = numbered_from_one(mine.select("content_digest", "tombstoned"), "sequence", "content_digest").join(F.broadcast(at))
    changes = rows.select("epoch", "sequence", F.when(F.col("tombstoned"), "tombstone").otherwise("upsert").alias("operation"), F.col("content_digest").alias("record_digest"))
    return state.having(promotion_changes=changes, promotion_outbox=changes.select("epoch", "sequence", "record_digest", F.lit("pending").alias("state")), promotion_state=at.join(F.broadcast(rows.agg(F.count("*").alias("sequence")))))


def activate_profile(state: PersonalState, identity: str) -> PersonalState:
    """Make a space the active one; only a change queues the active records anew."""
    now = state["personal_active_profile"].first()
    if now is not None and now.identity == identity:
        return state
    spark = state["personal_active_profile"].sparkSession
    todo = active(state).join(state["personal_embeddings"].where(F.col("profile_identity") == identity).select(F.col("record_digest").alias("content_digest")), "content_digest", "left_anti")
    return state.having(personal_active_profile=spark.createDataFrame([(identity,)], "identity string"), personal_embedding_queue=todo.select(F.col("content_digest").alias("record_digest"), "created_at"))


def work_off(state: PersonalState, profile: str, embed: Column, batch: int) -> PersonalState:
    """One bounded batch of the queue: ``embed`` over content gives struct(vector, failure); failures are kept and skipped later."""
    q = state["personal_embedding_queue"].orderBy("created_at", "record_digest").limit(max(1, min(10_000, batch)))
    r = q.join(state["canonical_records"].withColumnRenamed("content_digest", "record_digest").select("record_digest", "content"), "record_digest").select("record_digest", embed.alias("e"))
    done = r.where("e.vector IS NOT NULL").select(F.lit(profile).alias("profile_identity"), "record_digest", F.col("e.vector").alias("vector"))
    poison = r.where("e.failure IS NOT NULL").select(F.lit(profile).alias("profile_identity"), "record_digest", F.col("e.failure").alias("reason"))
    left = state["personal_embedding_queue"].join(q.select("record_digest"), "record_digest", "left_anti").select("record_digest", "created_at")
    return state.having(personal_embeddings=appended(state["personal_embeddings"], done, ["profile_identity", "record_digest"]), personal_embedding_failures=appended(state["personal_embedding_failures"], poison, ["profile_identity", "record_digest"]), personal_embedding_queue=left)


def availability(state: PersonalState, profile: str) -> DataFrame:
    """content_digest, semantic: ready before failed before pending."""
    of = lambda t, flag: state[t].where(F.col("profile_identity") == profile).select(F.col("record_digest").alias("content_digest"), F.lit(True).alias(flag)).distinct()
    r = active(state).select("content_digest").join(of("personal_embeddings", "ready"), "content_digest", "left").join(of("personal_embedding_failures", "failed"), "content_digest", "left")
    return r.select("content_digest", F.when(F.col("ready"), "ready").when(F.col("failed"), "failed").otherwise("pending").alias("semantic"))


def status(state: PersonalState, profile: str) -> DataFrame:
    """Counters of the semantic side and one word on its health."""
    a = availability(state, profile).agg(F.count("*").alias("active"), *(F.count(F.when(F.col("semantic") == s, 1)).alias(s) for s in ("ready", "failed", "pending")))
    q = state["personal_embedding_queue"].agg(F.count("*").alias("queued"))
    d = state["personal_divergences"].agg(F.count("*").alias("divergences"), F.count(F.when(F.col("status") != "acknowledged", 1)).alias("open_divergences"))
    t = state["canonical_records"].agg(F.count(F.when(F.col("tombstoned"), 1)).alias("tombstoned"))
    health = F.when(F.col("failed") > 0, "degraded").when(F.col("pending") > 0, "catching-up").otherwise("healthy")
    return a.join(q).join(d).join(t).withColumn("health", health)
