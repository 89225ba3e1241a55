import io
import json
import os
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.arguments import ArgumentError, clamped, only_fields, required_digest, required_text
from lodestone.functions import scalar
from lodestone.operators.lexical import rank
from lodestone.operators.stored import numbered_from_one
from lodestone.operators.vector import backfill, neighbours
from lodestone.plans.figures import document
from lodestone.plans.recall import RecallOptions, recall
from lodestone.schemas import EVIDENCE, ConstraintError
from lodestone.sources import files
from lodestone.sources.embedder import HashEmbedder, HttpEmbedder, embedding, probe, query_vector
from lodestone.sources.envelope import public_key
from lodestone.sources.ingest import ingest
from lodestone.sources.private import prepare_private
from lodestone.sources.rpc import Session, serve
from lodestone.sources.snapshot import VERSION, EvidenceStore, MemoryStore

HEX = [f"{i:064x}" for i in range(9)]


def memories(spark, rows):
    """(seq, digest, claim, superseded_by, superseded_seq)"""
    names = [f.split()[0] for f in EVIDENCE["memories"].split(", ")]
    made = [{"recorded_seq": s, "record_digest": d, "claim": c, "evidence_class": "external", "recorded_at": f"2024-01-0{s}T00:00:00Z", "superseded_by": b, "superseded_at": b and "2024-02-01T00:00:00Z", "superseded_seq": q} for s, d, c, b, q in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], EVIDENCE["memories"])


@pytest.fixture(params=["files", "memory"])
def store(spark, tmp_path, request):
    s = EvidenceStore.open(spark, str(tmp_path / "s")) if request.param == "files" else MemoryStore(spark)
    m = memories(spark, [(1, HEX[1], "the kettle boils", None, None), (2, HEX[2], "the kettle is cold", None, None), (3, HEX[3], "an old kettle", HEX[2], 3)])
    e = spark.createDataFrame([(HEX[1], HEX[2], "contradicts", "t"), (HEX[2], HEX[3], "supersedes", "t")], EVIDENCE["provenance_edges"])
    s.commit({"memories": m, "provenance_edges": e})
    return s


def test_a_session_answers_refuses_and_goes_on(spark, store):
    out = io.StringIO()
    call = lambda method, **params: json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    lines = [
        call("recall", query="kettle boils", limit=500, hops=9), call("trace", digest=HEX[2]), call("as_of", instant="2024-01-02T00:00:00Z"), call("lookup", digest=HEX[1]), call("lookup", digest=HEX[8]),
        call("submit_answer", cited=[HEX[1]]), call("submit_answer", cited=[HEX[1]], acknowledged=[{"a": HEX[2], "b": HEX[1], "resolution": "both"}]),
        call("recall", query=" "), call("trace", digest="no"), call("lookup", digest=HEX[1], more=1), call("fly"), "{", "[]", "", json.dumps({"jsonrpc": "2.0", "method": "stats"}), call("stats"),
    ]
    serve(Session(store), lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(got) == 14  # neither the blank line nor the notification has an answer
    hits = got[0]["result"]
    assert [h["record_digest"] for h in hits["hits"]][0] == HEX[1] and hits["withheld"] == [HEX[3]] and hits["counts"]["lexical"] == 2
    assert [(r["node"], r["depth"]) for r in got[1]["result"]] == [(HEX[3], 1)]
    assert got[2]["result"]["sequence"] == 2 and len(got[2]["result"]["records"]) == 2
    assert got[3]["result"]["claim"] == "the kettle boils" and got[4]["result"] is None
    assert not got[5]["result"]["accepted"] and got[5]["result"]["owed"][0]["other"] == HEX[2] and got[6]["result"]["accepted"]
    assert [g["error"]["code"] for g in got[7:13]] == [-32602, -32602, -32602, -32601, -32700, -32600]
    assert got[13]["result"]["memories"] == 3


def test_arguments():
    assert [clamped("limit", x) for x in (None, 0, 7, 900)] == [20, 1, 7, 100]
    assert [clamped("hops", x) for x in (None, -1, 9)] == [1, 0, 4]
    assert [clamped("trace_hops", x) for x in (None, 0, 9)] == [3, 1, 8] and [clamped("as_of_limit", x) for x in (None, 0, 900)] == [50, 1, 200]
    for bad in (lambda: clamped("limit", "3"), lambda: clamped("limit", True), lambda: required_text({}, "q"), lambda: required_digest({"d": "F" * 64}, "d"), lambda: only_fields({"x": 1}, {"y"})):
        with pytest.raises(ArgumentError):
            bad()


def test_the_index_goes_with_every_commit_of_claims(spark, store):
    found = lambda: {r.record_digest for r in recall(store.table("memories"), store.table("provenance_edges"), RecallOptions("teapot", hops=0), store.index()).hits.collect()}
    assert found() == set()
    store.commit({"memories": store.table("memories").unionByName(memories(spark, [(4, HEX[4], "a teapot", None, None)]))})
    assert found() == {HEX[4]}


def test_branches_can_be_left_out(spark, store):
    counts = lambda **o: recall(store.table("memories"), store.table("provenance_edges"), RecallOptions("kettle", **o), store.index()).counts.first()
    assert (counts(hops=0).lexical, counts(hops=0).provenance) == (2, 0)
    assert counts(hops=1).provenance == 2 and counts(use_lexical=False).unique == 0


def test_a_retirement_before_the_writing_is_refused(spark, store):
    with pytest.raises(ConstraintError):
        store.commit({"memories": memories(spark, [(5, HEX[5], "x", HEX[1], 4)])})


def test_older_stores_are_migrated(spark, tmp_path):
    root = str(tmp_path / "old")
    m = memories(spark, [(1, HEX[1], "a", HEX[2], None), (2, HEX[2], "b", None, None)]).drop("superseded_seq", "retracted_seq", "recorded_at")
    m.write.parquet(f"{root}/snapshots/x/memories")
    os.makedirs(f"{root}/pointers")
    with open(f"{root}/pointers/{1:020d}.json", "w") as f:
        json.dump({"version": 1, "tables": {"memories": "snapshots/x/memories"}}, f)
    store = EvidenceStore.open(spark, root)
    assert store.version == 1
    store.migrate("2024-01-01T00:00:00Z")
    again = EvidenceStore.open_read_only(spark, root)
    assert again.version == VERSION and {r.version for r in again.table("schema_migrations").collect()} == {2, 3, 4}
    assert {r.record_digest: r.superseded_seq for r in again.table("memories").collect()} == {HEX[1]: 2, HEX[2]: None}
    assert EvidenceStore.open_read_only(spark, root, 1).table("memories").where("superseded_seq is not null").isEmpty()
    assert store.migrate("later") == store.snapshot == 2


def test_archives_signatures_and_links(spark, tmp_path):
    src = tmp_path / "src"
    (src / "deep").mkdir(parents=True)
    (src / "b.txt").write_bytes(b"second")
    (src / "deep" / "a.txt").write_bytes(b"x" * 600)
    one, two = files.archive(spark, str(src), str(tmp_path / "1.tar")), files.archive(spark, str(src), str(tmp_path / "2.tar"))
    assert one == two and (tmp_path / "1.tar").read_bytes() == (tmp_path / "2.tar").read_bytes()
    with tarfile.open(tmp_path / "1.tar") as t:
        assert {m.name: t.extractfile(m).read() for m in t.getmembers()} == {"b.txt": b"second", "deep/a.txt": b"x" * 600}
    seed, at = bytes(range(32)), str(tmp_path / "staged")
    files.stage(spark, str(src), at)
    files.sign_stage(spark, at, seed)
    with pytest.raises(PermissionError):
        files.accept(spark, at, str(tmp_path / "now"), public_key(b"\x01" * 32))
    files.accept(spark, at, str(tmp_path / "now"), public_key(seed))
    assert files.read_current(spark, str(tmp_path / "now")).count() == 2
    os.symlink(src / "b.txt", src / "deep" / "link")
    with pytest.raises(ValueError):
        files.walk(spark, str(src))


def test_store_digest_and_npz(spark, tmp_path):
    m = memories(spark, [(1, HEX[1], "a" * 100, None, None), (2, HEX[2], "b", None, None)])
    store = EvidenceStore.open(spark, str(tmp_path / "s"))
    store.commit({"memories": m})
    d = store.digest()
    os.rename(tmp_path / "s", tmp_path / "moved")
    assert EvidenceStore.open_read_only(spark, str(tmp_path / "moved")).digest() == d
    nodes = m.select(F.col("record_digest").alias("node"), "claim")
    edges = spark.createDataFrame([(HEX[1], HEX[2]), (HEX[1], HEX[8])], "src string, dst string")
    files.export_neighbourhood_npz(nodes, edges, spark, str(tmp_path / "n.npz"))
    with np.load(tmp_path / "n.npz") as z:
        assert z["nodes"].tolist() == HEX[1:3] and z["edges"].tolist() == [[0, 1]] and len(z["labels"][0]) == 80
    with pytest.raises(ValueError):
        files.export_neighbourhood_npz(nodes, edges, spark, str(tmp_path / "m.npz"), most=1)


def test_private_files(tmp_path):
    at = prepare_private(str(tmp_path / "p.db"))
    assert at.stat().st_mode & 0o777 == 0o600 and prepare_private(str(at)) == at
    at.chmod(0o644)
    (tmp_path / "link").symlink_to(at)
    for bad in (at, tmp_path / "link", tmp_path):
        with pytest.raises(PermissionError):
            prepare_private(str(bad))


def test_embedders(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            bad = any("poison" in t for t in texts)
            self.send_response(500 if bad else 200)
            self.end_headers()
            if not bad:
                self.wfile.write(json.dumps({"data": [{"embedding": [len(t), 1.0]} for t in texts]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = HttpEmbedder(f"http://127.0.0.1:{server.server_port}", "p", 2)
    probe(e)
    with pytest.raises(ValueError):
        probe(HttpEmbedder(e.url, "p", 3))
    d = spark.createDataFrame([(1, "ab"), (2, "poison"), (3, None)], "record_digest long, claim string")
    got = {r.record_digest: (r.v.vector, r.v.failure) for r in d.select("record_digest", embedding(e)(F.col("claim")).alias("v")).collect()}
    assert got == {1: ([19.0, 1.0], None), 2: (None, "input-too-large"), 3: ([17.0, 1.0], None)}
    assert query_vector(e, "q") == [15, 1.0]
    server.shutdown()
    h = HashEmbedder()
    probe(h)
    have = spark.createDataFrame([(1, "hash")], "record_digest long, profile_identity string")
    rows = backfill(d.where("claim is not null"), have, "hash", embedding(h)(F.col("claim"))["vector"], "t").collect()
    assert [(r.record_digest, r.embedded_text, len(r.vector)) for r in rows] == [(2, "search_document: poison", 8)]


def test_figures_become_evidence(spark, tmp_path):
    store = EvidenceStore.open(spark, str(tmp_path / "s"))
    out = ingest(store, document({"q1": [3.0, 1.0, 2.0], 'odd "name"': [0.5]}, "2024-01-01T00:00:00Z", "local"))
    assert out["inserted"] == 4
    assert {r.claim for r in store.table("memories").collect()} == {"q1 takes 2.000 sec, median of 3 rounds", 'odd "name" takes 0.500 sec, median of 1 rounds'}


def test_canonical_now(spark):
    row = spark.range(1).select(scalar.canonical_now().alias("n"), scalar.canonical_now(F.expr("timestamp '2024-01-02 03:04:05.678901'")).alias("t")).select("n", "t", scalar.canonical_instant(F.col("n")).alias("ok")).first()
    assert row.ok and row.t == "2024-01-02T03:04:05.678Z"


def test_numbers_have_no_gaps(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("s")).repartition(7)
    got = numbered_from_one(d, "n", "k").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i + 1) for i in range(1000)]
    assert numbered_from_one(d.limit(0), "n", "k").collect() == []


def test_neighbours_and_ranks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "a" if i % 3 else "b", rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)] + [(40, "a", [0.0] * 5), (41, "a", None), (42, "a", [1.0, 2.0]), (43, "a", rng.normal(size=5).tolist())]
    rows.append((44, "a", rows[1][2]))
    d = spark.createDataFrame(rows, "id long, space string, v array<float>").repartition(3)
    got = sorted((r.query_id, r.rank, r.id, round(r.cosine, 6) + 0.0) for r in neighbours(d, "id", "space", "v", 3, digits=6, block_rows=6).collect())
    unit = {i: np.array(v, np.float32).astype(float) / max(float(np.linalg.norm(np.array(v, np.float32).astype(float))), 1e-300) for i, _, v in rows if v}
    want = []
    for i, s, v in rows:
        if v:
            near = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j, t, w in rows if w and t == s and j != i and len(w) == len(v))
            want += [(i, k + 1, j, -c + 0.0) for k, (c, j) in enumerate(near[:3])]
    assert got == sorted(want)
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, ["a"]), (5, ["a"])], "id long, t array<string>").repartition(2)
    terms = spark.createDataFrame([(9, "a"), (9, "a"), (9, "zz"), (8, "b")], "query_id long, term string")
    out = [(r.query_id, r.rank, r.id) for r in rank(docs, "id", [(F.col("t"), 1.0)], terms, 2).orderBy("query_id", "rank").collect()]
    # a short text with the term once comes before a long one with it twice; ties go to the smaller id
    assert out == [(8, 1, 2), (8, 2, 1), (9, 1, 4), (9, 2, 5)]
