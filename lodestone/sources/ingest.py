"""Evidence documents in TOML: parsed strictly, resolved by alias, committed as a whole or not at all."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.seal import sha256_hex
from lodestone.operators import write
from lodestone.operators.entity import Dictionary, index_mentions
from lodestone.operators.keyed import insert_absent, replace_by_key
from lodestone.schemas import ConstraintError
from lodestone.sources.snapshot import KEYS, EvidenceStore

#: The sections of a document and their fields; "?" marks those that may be absent.
SECTIONS = {
    "artifact": "id kind sha256 bytes media_type uri?",
    "suite": "id name cases? case_texts? tokenizer context_cap",
    "policy": "id metric aggregation comparison_rule step_budget? unit",
    "reference": "id runtime backend artifact suite environment?",
    "observation": "id kind quantity value policy suite runtime reference? artifact?",
    "claim": "id text evidence artifact? locator? observations? occurred_at? derivation?",
    "edge": "from to kind",
    "supersede": "retired replacement",
    "entity": "name type aliases?",
}
TOP = {"version", "run_id", "recorded_at", *SECTIONS}


class IngestError(ValueError):
    """A document that can't be taken in, with every reason found."""


def parse(text: str) -> dict:
    """The document with unknown and missing fields refused."""
    doc = tomllib.loads(text)
    wrong = [f"unknown field {k}" for k in doc.keys() - TOP]
    if doc.get("version") != 1:
        wrong.append("version must be 1")
    if not isinstance(doc.get("recorded_at"), str) or not doc["recorded_at"].strip():
        wrong.append("recorded_at is missing")
    for name, spec in SECTIONS.items():
        names = spec.split()
        allowed, needed = {n.rstrip("?") for n in names}, {n for n in names if not n.endswith("?")}
        seen: set[str] = set()
        for i, row in enumerate(doc.get(name, [])):
            wrong += [f"{name}[{i}]: unknown field {k}" for k in row.keys() - allowed]
            wrong += [f"{name}[{i}]: {k} is missing" for k in sorted(needed - row.keys())]
            if (alias := row.get("id")) is not None:
                if alias in seen:
                    wrong.append(f"{name}[{i}]: {alias} is declared twice")
                seen.add(alias)
            if name == "observation" and not isinstance(row.get("value"), str):
                wrong.append(f"{name}[{i}]: value must be a quoted decimal")
    if wrong:
        raise IngestError("; ".join(wrong))
    return doc


def _alias(known: dict[str, str], name: str | None, what: str) -> str | None:
    if name is None:
        return None
    if name not in known:
        raise IngestError(f"unknown {what} {name!r}; known: {', '.join(sorted(known)) or 'none'}")
    return known[name]


def ingest(store: EvidenceStore, text: str, dry_run: bool = False) -> dict:
    """Take a document in; the report counts artifacts, observations and claims that were new or there already."""
    doc, spark = parse(text), store.spark
    at = doc["recorded_at"]
    tables = store.tables()
    fresh: dict[str, DataFrame] = {}  # rows that are new or changed
    inserted = present = 0

    def have(table: str) -> DataFrame:
        """The table with this document's rows."""
        return replace_by_key(tables[table], fresh[table], KEYS[table]).select(*tables[table].columns) if table in fresh else tables[table]

    def put(table: str, rows: list[dict], schema: str, aliases: list[str], count: bool = False) -> dict[str, str]:
        nonlocal inserted, present
        if not rows:
            return {}
        key = {"artifacts": "sha256_hex"}.get(table, "identity")
        df = write.sealed(spark.createDataFrame([tuple(r.values()) for r in rows], schema), table)
        done = write.put(tables[table], df, table).collect()  # one document's rows
        by = {tuple(str(getattr(r, c)) for c in rows[0]): getattr(r, key) for r in done}
        added = [r for r in done if r.outcome == "inserted"]
        if count:
            inserted, present = inserted + len(added), present + len(done) - len(added)
        cols = tables[table].columns
        if added:
            fresh[table] = spark.createDataFrame([tuple(r[c] if c in r else None for c in cols) for r in (x.asDict() for x in added)], tables[table].schema)
        return {a: by[tuple(str(v) for v in r.values())] for a, r in zip(aliases, rows, strict=True)}

    def ids(name: str) -> list[str]:
        return [r["id"] for r in doc.get(name, [])]

    artifact = put("artifacts", [{"sha256_hex": r["sha256"], "artifact_kind": r["kind"], "byte_size": r["bytes"], "media_type": r["media_type"], "source_uri": r.get("uri")} for r in doc.get("artifact", [])], "sha256_hex string, artifact_kind string, byte_size long, media_type string, source_uri string", ids("artifact"), True)
    suite = put("evaluation_suites", [{"suite_name": r["name"], "case_digests": sorted([*r.get("cases", []), *map(sha256_hex, r.get("case_texts", []))]), "tokenizer_identity": r["tokenizer"], "context_cap": r["context_cap"]} for r in doc.get("suite", [])], "suite_name string, case_digests array<string>, tokenizer_identity string, context_cap long", ids("suite"))
    policy = put("measurement_policies", [{"metric": r["metric"], "aggregation": r["aggregation"], "comparison_rule": r["comparison_rule"], "step_budget": r.get("step_budget"), "unit": r["unit"]} for r in doc.get("policy", [])], "metric string, aggregation string, comparison_rule string, step_budget long, unit string", ids("policy"))
    reference = put("reference_executions", [{"runtime_identity": r["runtime"], "backend_id": r["backend"], "artifact_sha256": _alias(artifact, r["artifact"], "artifact"), "suite_identity": _alias(suite, r["suite"], "suite"), "environment": sorted(r.get("environment", []))} for r in doc.get("reference", [])], "runtime_identity string, backend_id string, artifact_sha256 string, suite_identity string, environment array<string>", ids("reference"))
    observation = put(
        "observations",
        [{"observation_kind": r["kind"], "quantity_kind": r["quantity"], "value_text": r["value"], "value_real": float(r["value"]), "policy_identity": _alias(policy, r["policy"], "policy"), "suite_identity": _alias(suite, r["suite"], "suite"), "reference_identity": _alias(reference, r.get("reference"), "reference"), "runtime_identity": r["runtime"], "artifact_sha256": _alias(artifact, r.get("artifact"), "artifact")} for r in doc.get("observation", [])],
        "observation_kind string, quantity_kind string, value_text string, value_real double, policy_identity string, suite_identity string, reference_identity string, runtime_identity string, artifact_sha256 string",
        ids("observation"),
        True,
    )

    claim: dict[str, str] = {}
    if rows := doc.get("claim", []):
        raw = [(r["id"], r["text"], r["evidence"], "operator", _alias(artifact, r.get("artifact"), "artifact"), r.get("locator"), sorted(_alias(observation, o, "observation") for o in r.get("observations", [])), doc.get("run_id"), r.get("occurred_at", at)) for r in rows]
        df = write.claims(spark.createDataFrame(raw, "alias string, claim string, evidence_class string, channel string, source_artifact_sha256 string, source_locator string, observation_identities array<string>, harness_run_id string, occurred_at string"))
        sides = {"ratio": ("numerator", "denominator"), "delta": ("minuend", "subtrahend"), "percentChange": ("value", "baseline")}
        claim = {r.alias: r.record_digest for r in df.select("alias", "record_digest").collect()}
        specs = []
        for r in rows:
            if d := r.get("derivation"):
                if d.get("transform") not in sides:
                    raise IngestError(f"claim {r['id']}: unknown transform {d.get('transform')!r}")
                left, right = (_alias(observation, d.get(k), "observation") for k in sides[d["transform"]])
                specs.append((claim[r["id"]], d["transform"], left, right, d["decimals"]))
        specs_df = spark.createDataFrame(specs, "record_digest string, transform string, left string, right string, decimals int")
        verified = write.verify_derivations(specs_df, have("observations"), df)
        refused = write.evidence_gate(df, have("artifacts"), verified).where("refusal IS NOT NULL").select("alias", "refusal").collect()
        if refused:
            raise IngestError("; ".join(f"claim {r.alias}: {r.refusal}" for r in refused))
        done = insert_absent(tables["memories"].select("record_digest"), df.select("record_digest", "alias"), ["record_digest"])
        outcome = {r.alias: r.outcome for r in done.select("alias", "outcome").collect()}
        inserted += sum(o == "inserted" for o in outcome.values())
        present += sum(o != "inserted" for o in outcome.values())
        order = spark.createDataFrame([(r["id"], i) for i, r in enumerate(rows) if outcome[r["id"]] == "inserted"], "alias string, place int")
        new = write.numbered(tables["memories"], df.join(order, "alias"), ["place"]).withColumn("recorded_at", F.lit(at))
        missing = [f for f in tables["memories"].schema if f.name not in new.columns]
        new = new.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in missing)).select(*tables["memories"].columns)
        if "inserted" in outcome.values():
            fresh["memories"] = new
        bridge = df.select("record_digest", F.explode("observation_identities").alias("observation_identity")).distinct()
        bridge = bridge.join(tables["memory_observations"], ["record_digest", "observation_identity"], "left_anti")
        if not bridge.isEmpty():
            fresh["memory_observations"] = bridge

    before = edges = tables["provenance_edges"]
    for r in doc.get("edge", []):
        edges = write.add_edge(edges, _alias(claim, r["from"], "claim"), _alias(claim, r["to"], "claim"), r["kind"], at)
    memories = have("memories")
    retired = []
    for r in doc.get("supersede", []):
        memories, edges = write.supersede(memories, edges, _alias(claim, r["retired"], "claim"), _alias(claim, r["replacement"], "claim"), at)
        retired.append(_alias(claim, r["retired"], "claim"))
    if retired:
        written = fresh["memories"].select("record_digest") if "memories" in fresh else tables["memories"].limit(0).select("record_digest")
        fresh["memories"] = memories.join(written.unionByName(spark.createDataFrame([(d,) for d in retired], "record_digest string")).distinct(), "record_digest", "left_semi")
    edges = edges.join(before.select("src", "dst", "edge_kind"), ["src", "dst", "edge_kind"], "left_anti")
    if not edges.isEmpty():
        fresh["provenance_edges"] = edges
    if rows := doc.get("entity", []):
        e = write.sealed(spark.createDataFrame([(r["name"], r["type"], sorted(set(r.get("aliases", [])))) for r in rows], "canonical_name string, entity_type string, aliases array<string>"), "entities")
        e = e.select(*tables["entities"].columns).join(tables["entities"], "id", "left_anti").select(*tables["entities"].columns)
        if not e.isEmpty():
            fresh["entities"] = e
    if "entities" in fresh or "memories" in fresh:
        dictionary = Dictionary.of(have("entities"))
        if dictionary.forms:
            # a new dictionary is another extractor: it reads all claims, and the rows of earlier ones stay beside its own
            mentions = index_mentions(have("memories") if "entities" in fresh else fresh["memories"], dictionary)
            if not mentions.isEmpty():
                fresh["mentions"] = mentions
    if fresh:
        store.commit(dry_run=dry_run, rows=fresh)
    return {"inserted": inserted, "already_present": present, "edges": len(doc.get("edge", [])), "entities": len(doc.get("entity", [])), "superseded": len(doc.get("supersede", [])), "dry_run": dry_run, "snapshot": store.snapshot}


__all__ = ["ConstraintError", "IngestError", "ingest", "parse"]
