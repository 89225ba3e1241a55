"""Explicit schemas of the evidence and personal stores, and the checks that every commit passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    """A frame holds rows that break a table's rules."""


#: Closed sets of the data model.
EVIDENCE_CLASSES = ["observed", "derived", "decision", "inference", "agentInference", "external"]
EDGE_KINDS = ["supersedes", "derivedFrom", "supports", "contradicts", "citesArtifact"]
QUANTITY_KINDS = ["absolute", "relative"]
OPERATIONS = ["upsert", "tombstone"]

EVIDENCE = {
    "memories": "recorded_seq long, record_digest string, claim string, evidence_class string, source_artifact_sha256 string, source_locator string, harness_run_id string, occurred_at string, recorded_at string, superseded_by string, superseded_at string, superseded_seq long, retracted_at string, retraction_reason string, retracted_seq long",
    "artifacts": "sha256_hex string, identity string, artifact_kind string, byte_size long, media_type string, source_uri string",
    "measurement_policies": "identity string, metric string, aggregation string, comparison_rule string, step_budget long, unit string",
    "evaluation_suites": "identity string, suite_name string, case_digests array<string>, tokenizer_identity string, context_cap long",
    "reference_executions": "identity string, runtime_identity string, backend_id string, artifact_sha256 string, suite_identity string, environment array<string>",
    "observations": "identity string, observation_kind string, quantity_kind string, value_text string, value_real double, policy_identity string, suite_identity string, reference_identity string, runtime_identity string, artifact_sha256 string",
    "memory_observations": "record_digest string, observation_identity string",
    "provenance_edges": "src string, dst string, edge_kind string, created_at string",
    "entities": "id string, canonical_name string, entity_type string, aliases array<string>",
    "mentions": "record_digest string, entity_id string, start_offset int, end_offset int, extractor_identity string",
    "embedding_profiles": "identity string, model_family string, model_revision string, weight_sha256 array<string>, tokenizer_sha256 array<string>, dimensions int, pooling string, normalization string, task_instruction string, backend string",
    "embeddings": "profile_identity string, record_digest string, vector array<float>, embedded_text string, embedded_at string",
    "sessions": "id string, created_at string",
    "session_emissions": "session_id string, position int, record_digest string, token_cost long",
    "relations": "subject string, predicate string, object string, valid_from string, valid_to string",
    "tags": "name string",
    "memory_tags": "record_digest string, tag string",
    "schema_migrations": "version int, applied_at string",
}
PERSONAL = {
    "canonical_records": "content_digest string, content string, occurred_at string, metadata string, created_at string, tombstoned boolean",
    "sightings": "origin_device string, origin_id string, record_digest string, created_at string, source string, conversation string",
    "captures": "origin_device string, origin_id string, record_digest string",
    "replica_records": "record_digest string",
    "record_tags": "record_digest string, tag string",
    "promotion_outbox": "epoch long, sequence long, record_digest string, state string",
    "promotion_changes": "epoch long, sequence long, operation string, record_digest string",
    "promotion_state": "epoch long, sequence long",
    "replica_cursor": "device string, epoch long, sequence long, transition_fingerprint string",
    "personal_embedding_profiles": "identity string, body string",
    "personal_active_profile": "identity string",
    "personal_embeddings": "profile_identity string, record_digest string, vector array<float>",
    "personal_embedding_queue": "record_digest string, created_at string",
    "personal_embedding_failures": "profile_identity string, record_digest string, reason string",
    "personal_divergences": "id string, digest_a string, digest_b string, status string, acknowledged_at string",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], EVIDENCE.get(table) or PERSONAL[table])


def _filled(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _paired(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def _digest(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))


def rules(table: str) -> dict[str, Column]:
    """What every row of a table must satisfy, by name."""
    known = {
        "memories": {
            "claim-filled": _filled("claim"),
            "digest": _digest("record_digest"),
            "evidence-class": F.col("evidence_class").isin(EVIDENCE_CLASSES),
            "superseded-paired": _paired("superseded_by", "superseded_at"),
            "retracted-paired": _paired("retracted_at", "retraction_reason"),
            "not-itself": F.coalesce(F.col("superseded_by") != F.col("record_digest"), F.lit(True)),
            "retired-after-written": F.coalesce(F.col("superseded_seq") >= F.col("recorded_seq"), F.lit(True)),
        },
        "artifacts": {"digest": _digest("sha256_hex"), "size": F.col("byte_size") >= 0},
        "measurement_policies": {"metric": _filled("metric"), "aggregation": _filled("aggregation"), "rule": _filled("comparison_rule"), "budget": F.col("step_budget").isNull() | (F.col("step_budget") > 0)},
        "evaluation_suites": {"cap": F.col("context_cap") > 0},
        "observations": {
            "quantity": F.col("quantity_kind").isin(QUANTITY_KINDS),
            "referent": (F.col("quantity_kind") == "relative") == F.col("reference_identity").isNotNull(),
            "decimal": F.col("value_text").rlike(r"^-?\d+(\.\d+)?$"),
        },
        "provenance_edges": {"kind": F.col("edge_kind").isin(EDGE_KINDS), "no-loop": F.col("src") != F.col("dst")},
        "mentions": {"span": F.col("end_offset") > F.col("start_offset"), "extractor": _filled("extractor_identity")},
        "embeddings": {"vector": F.size("vector") > 0, "finite": F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))},
        "session_emissions": {"cost": F.col("token_cost") >= 0},
        "promotion_changes": {"operation": F.col("operation").isin(OPERATIONS)},
        "personal_divergences": {"ordered": F.col("digest_a") < F.col("digest_b"), "acknowledged": (F.col("status") == "acknowledged") == F.col("acknowledged_at").isNotNull()},
        "personal_embedding_failures": {"reason": F.col("reason").isin("input-too-large")},
    }
    return known.get(table, {})


def violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a rule, with the names of the rules in ``broken``; a null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules(table).items())))
    return df.withColumn("broken", broken if rules(table) else F.array().cast("array<string>")).where(F.size("broken") > 0)


def assert_constraints(df: DataFrame, table: str) -> DataFrame:
    bad = violations(df, table).limit(5).collect()
    if bad:
        raise ConstraintError(f"{table}: {[r.broken for r in bad]}")
    return df


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The rows of ``child`` whose non-null ``column`` isn't a ``key`` of ``parent``."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def assert_references(child: DataFrame, column: str, parent: DataFrame, key: str, what: str) -> None:
    """Every non-null ``column`` of ``child`` is a ``key`` of ``parent``."""
    if not dangling(child, column, parent, key).isEmpty():
        raise ConstraintError(f"{what}: dangling {column}")
