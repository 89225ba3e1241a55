import pytest
from pyspark.sql import functions as F

from lodestone.operators.personal import PersonalState
from lodestone.schemas import ConstraintError
from lodestone.sources import files
from lodestone.sources.envelope import transition_fingerprint
from lodestone.sources.ingest import IngestError, ingest, parse
from lodestone.sources.snapshot import EvidenceStore, verify_replica
from lodestone.streaming.change_log import WIRE, advance, current, follow, import_bundle

DOC = """
version = 1
recorded_at = "2024-08-01T00:00:00Z"
[[artifact]]
id = "log"
kind = "log"
sha256 = "{sha}"
bytes = 12
media_type = "text/plain"
[[suite]]
id = "s"
name = "suite"
case_texts = ["one"]
tokenizer = "t"
context_cap = 10
[[policy]]
id = "p"
metric = "speed"
aggregation = "mean"
comparison_rule = "higher"
unit = "x"
[[observation]]
id = "o1"
kind = "rate"
quantity = "absolute"
value = "287.17"
policy = "p"
suite = "s"
runtime = "r"
[[observation]]
id = "o2"
kind = "rate"
quantity = "absolute"
value = "39.52"
policy = "p"
suite = "s"
runtime = "r"
[[claim]]
id = "seen"
text = "Model X ran at 287.17"
evidence = "observed"
artifact = "log"
observations = ["o1"]
[[claim]]
id = "made"
text = "a speedup of 7.27"
evidence = "derived"
observations = ["o1", "o2"]
[claim.derivation]
transform = "ratio"
decimals = 2
numerator = "o1"
denominator = "o2"
[[edge]]
from = "made"
to = "seen"
kind = "derivedFrom"
[[entity]]
name = "Model X"
type = "model"
""".replace("{sha}", "ab" * 32)


def test_ingest_is_whole_idempotent_and_checked(spark, tmp_path):
    store = EvidenceStore.open(spark, str(tmp_path / "store"))
    assert ingest(store, DOC, dry_run=True)["inserted"] == 5 and store.snapshot == 0
    report = ingest(store, DOC)
    assert (report["inserted"], report["already_present"], store.snapshot) == (5, 0, 1)
    pinned = EvidenceStore.open_read_only(spark, store.root)
    again = ingest(store, DOC)
    assert (again["inserted"], again["already_present"]) == (0, 5)
    assert store.table("memories").count() == 2 and store.table("provenance_edges").count() == 1 and store.table("mentions").count() == 1
    assert sorted(r.recorded_seq for r in store.table("memories").collect()) == [1, 2]
    head = store.snapshot
    for wrong in (DOC.replace("7.27", "8.10"), DOC.replace('artifact = "log"', 'artifact = "nope"'), DOC.replace("version = 1", "version = 2"), DOC + '\n[[claim]]\nid = "z"\ntext = "t"\nevidence = "external"\nextra = 1\n'):
        with pytest.raises(IngestError):
            ingest(store, wrong)
    assert EvidenceStore.open(spark, store.root).snapshot == head and pinned.snapshot == 1
    with pytest.raises(PermissionError):
        pinned.commit({})
    with pytest.raises(IngestError):
        parse("version = 1")
    with pytest.raises(FileNotFoundError):
        EvidenceStore.open_read_only(spark, str(tmp_path / "none"))
    copy = str(tmp_path / "copy")
    store.backup_to(copy)
    with pytest.raises(FileExistsError):
        store.backup_to(copy)
    a, b = store.tables(), EvidenceStore.open_read_only(spark, copy).tables()
    assert verify_replica(a, b).collect() == []
    b["memories"] = b["memories"].withColumn("claim", F.when(F.col("recorded_seq") == 1, "forged").otherwise(F.col("claim")))
    b["artifacts"] = b["artifacts"].limit(0)
    b["provenance_edges"] = b["provenance_edges"].limit(0)
    got = {(r.table, r.status) for r in verify_replica(a, b, (3, 2)).collect()}
    assert got == {("memories", "Diverged"), ("artifacts", "Missing"), ("provenance_edges", "Count"), ("schema", "SchemaVersion")}


def test_a_new_dictionary_leaves_other_extractors_rows(spark, tmp_path):
    """Mentions belong to an extractor: a document with a new entity makes another one, which reads all claims; earlier rows stay."""
    store = EvidenceStore.open(spark, str(tmp_path / "store"))
    ingest(store, DOC)
    (first,) = store.table("mentions").collect()
    ingest(store, 'version = 1\nrecorded_at = "2024-08-02T00:00:00Z"\n[[entity]]\nname = "speedup"\ntype = "word"\n')
    by = {}
    for r in store.table("mentions").collect():
        by.setdefault(r.extractor_identity, []).append(r)
    assert by.pop(first.extractor_identity) == [first]
    ((rows),) = by.values()
    assert len(rows) == 2 and {r.entity_id for r in rows} == {r.id for r in store.table("entities").collect()}
    assert {r.part for r in store.parts().where("table = 'mentions'").collect()} == {0, 1}


def wire(spark, rows):
    return spark.createDataFrame([(e, s, op, k, f"text {k}", None, "{}", at, False) for e, s, op, k, at in rows], WIRE)


def bundle(rows, start, end, device="peer"):
    return {"sourceDevice": device, "fromExclusive": {"epoch": start[0], "sequence": start[1]}, "through": {"epoch": end[0], "sequence": end[1]}, "generatedAt": "now", "changes": [list(r) for r in rows], "divergences": []}


def test_bundles_apply_once_and_in_order(spark):
    first = [(1, 1, "upsert", "a", "2024-01-02"), (1, 2, "upsert", "b", "2024-01-01")]
    s, done = import_bundle(PersonalState.new(spark), bundle(first, (0, 0), (1, 2)), wire(spark, first))
    assert done.applied and s["canonical_records"].count() == 2
    same, done = import_bundle(s, bundle(first, (0, 0), (1, 2)) | {"generatedAt": "later"}, wire(spark, first))
    assert not done.applied and transition_fingerprint(bundle(first, (0, 0), (1, 2))) == same["replica_cursor"].first().transition_fingerprint
    with pytest.raises(ConstraintError):
        import_bundle(s, bundle(first[:1], (0, 0), (1, 2)), wire(spark, first))
    gone = [(1, 3, "tombstone", "a", "2024-01-02")]
    with pytest.raises(ConstraintError):
        import_bundle(s, bundle(gone, (1, 1), (1, 3)), wire(spark, gone))
    gap = [(1, 4, "upsert", "c", "2024-01-02")]
    with pytest.raises(ConstraintError):
        import_bundle(s, bundle(gap, (1, 2), (1, 4)), wire(spark, gap))
    s, done = import_bundle(s, bundle(gone, (1, 2), (1, 3)), wire(spark, gone))
    assert done.applied and s["canonical_records"].where("tombstoned").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, i + 1, "tombstone" if i == 3 else "upsert", f"k{i % 3}", f"2024-01-0{i + 1}") for i in range(5)]
    root, inbox = str(tmp_path / "root"), str(tmp_path / "in")
    wire(spark, rows[:3]).coalesce(1).write.parquet(inbox)
    for part in (rows[3:], rows[1:4]):
        follow(spark.readStream.schema(WIRE).parquet(inbox), root, str(tmp_path / "cp")).awaitTermination()
        wire(spark, part).coalesce(1).write.mode("append").parquet(inbox)
    follow(spark.readStream.schema(WIRE).parquet(inbox), root, str(tmp_path / "cp")).awaitTermination()
    batch = str(tmp_path / "batch")
    assert advance(spark, batch, wire(spark, rows)) and not advance(spark, batch, wire(spark, rows))
    view = lambda at: sorted((r.content_digest, r.created_at, r.tombstoned) for r in current(spark, at).collect())
    assert view(root) == view(batch) == [("k0", "2024-01-01", True), ("k1", "2024-01-02", False), ("k2", "2024-01-03", False)]


def test_recovery_artifacts(spark, tmp_path):
    src = tmp_path / "src" / "deep"
    src.mkdir(parents=True)
    (src / "a.txt").write_bytes(b"alpha")
    (tmp_path / "src" / "b.bin").write_bytes(b"\x00\x01")
    staged = str(tmp_path / "staged")
    info = files.stage(spark, str(tmp_path / "src"), staged)
    assert (info["file_count"], info["bytes"]) == (2, 7) and files.verify(spark, staged).collect() == []
    files.accept(spark, staged, str(tmp_path / "current"))
    assert {r.path for r in files.read_current(spark, str(tmp_path / "current")).collect()} == {"b.bin", "deep/a.txt"}
    bad = str(tmp_path / "bad")
    spark.read.parquet(f"{staged}/data").where("path = 'b.bin'").write.parquet(f"{bad}/data")
    spark.read.parquet(f"{staged}/manifest").write.parquet(f"{bad}/manifest")
    assert [(r.path, r.status) for r in files.verify(spark, bad).collect()] == [("deep/a.txt", "Missing")]
    with pytest.raises(ValueError):
        files.accept(spark, bad, str(tmp_path / "never"))
