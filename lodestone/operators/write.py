"""Writes as frames: validated, sealed, gated, inserted once; retirement as an appended fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import derive, last_decimal
from lodestone.functions.seal import NAMESPACE, seal_column
from lodestone.functions.text import fixed_text_udf
from lodestone.operators.keyed import insert_absent
from lodestone.operators.stored import numbered_from_one, parted, spread
from lodestone.schemas import EDGE_KINDS, ConstraintError

#: Which columns carry which seal's fields.
SEALED = {
    "measurement_policies": ("measurement-policy", {"metric": "metric", "aggregation": "aggregation", "comparisonRule": "comparison_rule", "stepBudget": "step_budget", "unit": "unit"}),
    "evaluation_suites": ("evaluation-suite", {"suiteName": "suite_name", "caseDigests": "case_digests", "tokenizerIdentity": "tokenizer_identity", "contextCap": "context_cap"}),
    "reference_executions": ("reference-execution", {"runtimeIdentity": "runtime_identity", "backendId": "backend_id", "artifactSha256": "artifact_sha256", "evaluationSuiteIdentity": "suite_identity", "environment": "environment"}),
    "observations": ("observation", {"observationKind": "observation_kind", "quantityKind": "quantity_kind", "valueText": "value_text", "measurementPolicyIdentity": "policy_identity", "evaluationSuiteIdentity": "suite_identity", "referenceExecutionIdentity": "reference_identity", "runtimeIdentity": "runtime_identity", "artifactSha256": "artifact_sha256"}),
    "artifacts": ("artifact", {"artifactKind": "artifact_kind", "sha256Hex": "sha256_hex", "byteSize": "byte_size", "mediaType": "media_type", "sourceUri": "source_uri"}),
    "entities": ("entity", {"canonicalName": "canonical_name", "entityType": "entity_type", "aliases": "aliases"}),
    "embedding_profiles": ("embedding-space", {"modelFamily": "model_family", "modelRevision": "model_revision", "weightSha256": "weight_sha256", "tokenizerSha256": "tokenizer_sha256", "dimensions": "dimensions", "pooling": "pooling", "normalization": "normalization", "taskInstruction": "task_instruction"}),
}


def sealed(df: DataFrame, table: str, namespace: str = NAMESPACE) -> DataFrame:
    """``df`` with its identity column (``id`` for entities) computed from its fields."""
    kind, fields = SEALED[table]
    return df.withColumn("id" if table == "entities" else "identity", seal_column(kind, namespace, **{k: F.col(c) for k, c in fields.items()}))


def put(store: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """``new`` with its outcome; artifacts are keyed by their bytes' digest, the rest by their seal."""
    key = {"artifacts": "sha256_hex", "entities": "id"}.get(table, "identity")
    return insert_absent(store, new, [key])


def register_spaces(store: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` embedding spaces under their seals, with their outcome: one that is known already stays as it was first registered.

    Lists of digests are sorted before sealing; the backend is noted, but no part of the identity. A space
    with anything else changed has another seal, so vectors of the two never meet.
    """
    lists = [c for c, t in new.dtypes if t == "array<string>"]
    tidy = new.select(*(F.array_sort(c).alias(c) if c in lists else F.col(c) for c in new.columns))
    return put(store, sealed(tidy, "embedding_profiles"), "embedding_profiles")


def observation_defects() -> Column:
    """Codes of what is wrong with an observation; empty if it is sound."""
    rel = F.col("quantity_kind") == "relative"
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.trim("observation_kind") != "", F.lit(False)), "blank-kind"),
        F.when(~F.coalesce(F.col("quantity_kind").isin("absolute", "relative"), F.lit(False)), "unknown-quantity"),
        F.when(~F.coalesce(F.col("value_text").rlike(r"^-?\d+(\.\d+)?$"), F.lit(False)), "not-a-decimal"),
        F.when(rel & F.col("reference_identity").isNull(), "relative-without-reference"),
        F.when((F.col("quantity_kind") == "absolute") & F.col("reference_identity").isNotNull(), "absolute-with-reference"),
    ))


def clamp_channel(evidence_class: Column, channel: Column) -> Column:
    """What an agent writes is an agent's inference, whatever it says; this comes before the seal."""
    return F.when(channel == "agent", "agentInference").otherwise(evidence_class)


def claims(new: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Claims clamped and sealed from (claim, evidence_class, channel, source_artifact_sha256, source_locator, observation_identities, harness_run_id, …)."""
    c = new.withColumn("evidence_class", clamp_channel(F.col("evidence_class"), F.col("channel")))
    fields = {"claim": "claim", "evidenceClass": "evidence_class", "sourceArtifactSha256": "source_artifact_sha256", "sourceLocator": "source_locator", "observationIdentities": "observation_identities", "harnessRunId": "harness_run_id"}
    return c.withColumn("record_digest", seal_column("memory-record", namespace, **{k: F.col(v) for k, v in fields.items()}))


def evidence_gate(new: DataFrame, artifacts: DataFrame, derivations: DataFrame) -> DataFrame:
    """``new`` with ``refusal``: observed needs a known artifact, derived a derivation that recomputes; nothing is downgraded."""
    known = artifacts.select(F.col("sha256_hex").alias("source_artifact_sha256"), F.lit(True).alias("__artifact")).distinct()
    proven = derivations.where("verified").select("record_digest", F.lit(True).alias("__derived")).distinct()
    out = new.join(known, "source_artifact_sha256", "left").join(proven, "record_digest", "left")
    refusal = F.when((F.col("evidence_class") == "observed") & F.col("__artifact").isNull(), "unknown-artifact").when((F.col("evidence_class") == "derived") & F.col("__derived").isNull(), "derivation-not-verified")
    return out.select(*new.columns, refusal.alias("refusal"))


def verify_derivations(specs: DataFrame, observations: DataFrame, memories_claims: DataFrame) -> DataFrame:
    """record_digest, verified, problem for specs (record_digest, transform, left, right, decimals).

    Inputs are observations; the stated value is the claim's last decimal, compared at the declared precision.
    Each join is dealt into parts of bounded rows.
    """
    value = observations.select("identity", F.expr("try_cast(value_text AS double)").alias("v"))
    told = memories_claims.select("record_digest", "claim")
    n, known, said = specs.count(), value.count(), told.count()
    s, a, b = parted(specs, max(n, known), "left"), value.toDF("left", "a"), value.toDF("right", "b")
    s = s.join(parted(a, max(n, known), "left"), "left", "left")
    s = parted(s, max(n, known), "right").join(parted(b, max(n, known), "right"), "right", "left")
    s = parted(s, max(n, said), "record_digest").join(parted(told, max(n, said), "record_digest"), "record_digest", "left")
    result = None
    for name in ("ratio", "delta", "percentChange"):
        d = derive(name, F.col("a"), F.col("b"))
        result = F.when(F.col("transform") == name, d) if result is None else result.when(F.col("transform") == name, d)
    s = s.withColumn("d", result).withColumn("made", fixed_text_udf(F.col("d.value"), "decimals")).withColumn("said", fixed_text_udf(F.expr("try_cast(said AS double)"), "decimals") if "said" in specs.columns else fixed_text_udf(last_decimal(F.col("claim")).cast("double"), "decimals"))
    problem = F.when(F.col("d").isNull(), "unknown-transform").when(F.col("d.problem").isNotNull(), F.col("d.problem")).when(F.col("said").isNull(), "no-stated-value").when(F.col("said") != F.col("made"), "mismatch")
    return s.select("record_digest", problem.isNull().alias("verified"), problem.alias("problem"), "made")


def watermark(memories: DataFrame) -> DataFrame:
    """sequence: the last one given, 0 for an empty store; one row."""
    return memories.agg(F.coalesce(F.max("recorded_seq"), F.lit(0)).cast("long").alias("sequence"))


def numbered(store: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` rows with recorded_seq going on from the store's last, in the order given; one committer allocates."""
    last = watermark(store).select(F.col("sequence").alias("last"))
    return numbered_from_one(new.drop("recorded_seq"), "__n", *order).join(F.broadcast(last)).withColumn("recorded_seq", F.col("last") + F.col("__n")).drop("__n", "last")


def supersede(memories: DataFrame, edges: DataFrame, retired: str, replacement: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) after a retirement at the present high-water mark, with the replacement's edge to it."""
    if retired == replacement:
        raise ConstraintError("a record can't supersede itself")
    have = {r.record_digest: r.superseded_at for r in memories.where(F.col("record_digest").isin(retired, replacement)).select("record_digest", "superseded_at").collect()}
    if set(have) != {retired, replacement}:
        raise ConstraintError("unknown record")
    if have[retired]:
        raise ConstraintError("already superseded")
    mark = memories.agg(F.max("recorded_seq").alias("mark"))
    hit = F.col("record_digest") == retired
    out = memories.join(F.broadcast(mark)).withColumn("superseded_by", F.when(hit, replacement).otherwise(F.col("superseded_by"))).withColumn("superseded_at", F.when(hit, at).otherwise(F.col("superseded_at"))).withColumn("superseded_seq", F.when(hit, F.col("mark")).otherwise(F.col("superseded_seq"))).drop("mark")
    return out, add_edge(edges, replacement, retired, "supersedes", at)


def add_edge(edges: DataFrame, src: str, dst: str, kind: str, at: str) -> DataFrame:
    if kind not in EDGE_KINDS or src == dst:
        raise ConstraintError("unknown edge kind or a loop")
    new = edges.sparkSession.createDataFrame([(src, dst, kind, at)], edges.schema)
    return edges.unionByName(insert_absent(edges, new, ["src", "dst", "edge_kind"]).where("outcome = 'inserted'").drop("outcome"))


def backfilled(memories: DataFrame) -> DataFrame:
    """superseded_seq of old rows: the replacement's sequence, as a lower bound."""
    r = memories.select(F.col("record_digest").alias("superseded_by"), F.col("recorded_seq").alias("__seq"))
    return memories.join(r, "superseded_by", "left").withColumn("superseded_seq", F.coalesce("superseded_seq", "__seq")).select(*memories.columns)


#: Rows up to which a table of names goes to every task.
NAMES = 1 << 16


def record_detail(memories: DataFrame, edges: DataFrame, bridge: DataFrame, observations: DataFrame, policies: DataFrame, suites: DataFrame, references: DataFrame, digests: DataFrame, rows: int | None = None) -> DataFrame:
    """Records with their observations (with policy, suite and reference) and edges, nested; missing parts are empty lists.

    Observations travel once to their bridge (not at all where both lie by identity), once to each large
    table of names, and once to their record; small tables of names are looked up there, so that only
    identities travel. Digests of most records needn't cut the bridge, as the records themselves do.
    ``rows``: about as many as the bridge has, counted if not given; parts are bounded by it.
    """
    many, asked = memories.count(), digests.count()
    rows = spread(memories.sparkSession, bridge.count() if rows is None else rows)
    most = max(rows, many, asked)
    d = parted(digests.select(F.col("digest").alias("record_digest")), most, "record_digest").distinct()
    b = bridge.join(d, "record_digest") if 2 * asked < many else bridge
    o = b.join(observations.withColumnRenamed("identity", "observation_identity"), "observation_identity")
    names = [
        (policies.select(F.col("identity").alias("policy_identity"), "metric", "unit"), "policy_identity", "inner"),
        (suites.select(F.col("identity").alias("suite_identity"), "suite_name"), "suite_identity", "inner"),
        (references.select(F.col("identity").alias("reference_identity"), F.col("runtime_identity").alias("reference_runtime")), "reference_identity", "left"),
    ]
    known = [df.count() for df, _, _ in names]
    for (df, key, how), n in zip(names, known):
        o = parted(o, max(rows, n), key).join(parted(df, max(rows, n), key), key, how) if n > NAMES else o
    o = parted(o, most, "record_digest")
    for (df, key, how), n in zip(names, known):
        o = o.join(F.broadcast(df), key, how) if n <= NAMES else o
    o = o.groupBy("record_digest").agg(F.sort_array(F.collect_list(F.struct("observation_identity", "value_text", "metric", "unit", "suite_name", "reference_runtime"))).alias("observations"))
    e = edges.select(F.col("src").alias("record_digest"), F.col("dst").alias("other"), "edge_kind", F.lit("out").alias("way")).union(edges.select("dst", "src", "edge_kind", F.lit("in")))
    e = parted(e, most, "record_digest").join(d, "record_digest").groupBy("record_digest").agg(F.sort_array(F.collect_list(F.struct("way", "edge_kind", "other"))).alias("edges"))
    return parted(memories, most, "record_digest").join(d, "record_digest").join(o, "record_digest", "left").join(e, "record_digest", "left")
