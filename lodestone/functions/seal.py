"""Sealed identities: SHA-256 of a compact JSON object whose first field is a versioned domain."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import canonical_json, nfc, strict_object

#: The fields of each seal in order; "*" marks lists that are sorted, "!" also distinct.
SEALS = {
    "measurement-policy": ("measurement-policy.v1", ["metric", "aggregation", "comparisonRule", "stepBudget", "unit"]),
    "evaluation-suite": ("evaluation-suite.v1", ["suiteName", "caseDigests*", "tokenizerIdentity", "contextCap"]),
    "reference-execution": ("reference-execution.v1", ["runtimeIdentity", "backendId", "artifactSha256", "evaluationSuiteIdentity", "environment*"]),
    "observation": ("observation.v1", ["observationKind", "quantityKind", "valueText", "measurementPolicyIdentity", "evaluationSuiteIdentity", "referenceExecutionIdentity", "runtimeIdentity", "artifactSha256"]),
    "artifact": ("artifact.v1", ["artifactKind", "sha256Hex", "byteSize", "mediaType", "sourceUri"]),
    "memory-record": ("memory-record.v1", ["claim", "evidenceClass", "sourceArtifactSha256", "sourceLocator", "observationIdentities*", "harnessRunId"]),
    "embedding-space": ("embedding-space.v1", ["modelFamily", "modelRevision", "weightSha256*", "tokenizerSha256*", "dimensions", "pooling", "normalization", "taskInstruction"]),
    "entity": ("entity.v1", ["canonicalName", "entityType", "aliases!"]),
    "entity-extractor": ("entity-extractor.v1", ["algorithm", "entityIdentities!"]),
    "session-prefix": ("session-prefix.v1", ["emitted"]),
}
DIVERGENCE = "personal-divergence.v1"
#: What stands before each domain; a store sealed under another name passes that name.
NAMESPACE = "lodestone"
PERSONAL = "personal.memory.v1"


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def seal(kind: str, fields: dict, namespace: str = NAMESPACE) -> str:
    """The identity of a record on the driver; absent fields are null."""
    domain, names = SEALS[kind]
    out = {"domain": f"{namespace}.{domain}"}
    for name in names:
        key = name.rstrip("*!")
        v = fields.get(key)
        if name.endswith("*"):
            v = sorted(v or [])
        elif name.endswith("!"):
            v = sorted(set(v or []))
        out[key] = v
    return sha256_hex(json.dumps(out, ensure_ascii=False, separators=(",", ":")))


def seal_column(kind: str, namespace: str = NAMESPACE, **fields: Column) -> Column:
    """The same identity as an expression over a frame's columns."""
    domain, names = SEALS[kind]
    parts = [F.lit(f"{namespace}.{domain}").alias("domain")]
    for name in names:
        key = name.rstrip("*!")
        c = fields.get(key, F.lit(None).cast("string"))
        if name.endswith(("*", "!")):
            c = F.coalesce(c, F.array().cast("array<string>"))
            c = F.array_sort(F.array_distinct(c) if name.endswith("!") else c)
        parts.append(c.alias(key))
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def personal_digest(text: str, metadata: str, occurred_at: str | None, domain: str = PERSONAL) -> str:
    """A personal record's identity: canonical JSON of normalized text, metadata, date and domain."""
    body = {"contentDomain": domain, "metadata": strict_object(metadata), "occurredAt": occurred_at, "text": nfc(text)}
    return sha256_hex(canonical_json(body))


def divergence_id(a: Column, b: Column, namespace: str = NAMESPACE) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(f"{namespace}.{DIVERGENCE}"), F.least(a, b), F.greatest(a, b)), 256)
