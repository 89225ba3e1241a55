"""Stores and indexes in parts, against the same rows written at once."""

import random

from pyspark.sql import functions as F

import pytest

from lodestone.operators import lexical, temporal
from lodestone.operators.parts import Part, merged
from lodestone.plans.recall import RecallOptions, lexical_branch, recall
from lodestone.schemas import ConstraintError
from lodestone.sources.snapshot import EvidenceStore, MemoryStore
from lodestone.store_queries import PLAIN, _claims


def claims(spark, rows):
    return _claims(spark.createDataFrame(rows, "doc_id long, text string"))


def test_later_parts_win(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    parts = [Part(rows(("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5))), Part(rows(("a", 6), ("d", 7)), keys("a", "d", "b"), 3), Part(rows(("b", 8), ("b", 9)), keys("b", "c"), 2)]
    assert sorted(map(tuple, merged(parts, ["k"]).collect()), key=str) == [("a", 6), ("b", 8), ("b", 9), ("d", 7), (None, 4)]
    assert merged([Part(rows(), None), Part(rows(), keys(), 0)], ["k"]).collect() == []


def test_commits_cost_their_own_size_and_add_up(spark, tmp_path):
    texts = [(i, f"word{i % 50} common alpha{i % 7} beta number{i}") for i in range(4000)]
    root = str(tmp_path / "store")
    store = EvidenceStore.open(spark, root, PLAIN)
    store.commit(rows={"memories": claims(spark, texts)})
    ten = [(i, f"common replaced{i}") for i in range(5)] + [(5000 + i, f"fresh common{i}") for i in range(5)]
    store.commit(rows={"memories": claims(spark, ten)}, gone={"memories": claims(spark, [(77, "x")]).select("record_digest")})
    size = {(r["table"], r.part): (r.keys, r.bytes) for r in store.parts().collect()}
    assert size["memories", 1][0] == 11 and size["index_postings", 1][0] == 11
    for name in ("memories", "index_postings", "index_lengths"):
        assert size[name, 1][1] < size[name, 0][1] / 4
    final = dict(texts) | dict(ten)
    del final[77]
    whole = MemoryStore(spark)
    whole.text = PLAIN
    whole.commit({"memories": claims(spark, list(final.items()))})
    once = EvidenceStore.open(spark, str(tmp_path / "once"), PLAIN)
    once.commit({"memories": claims(spark, list(final.items()))})
    view = lambda s: sorted((r.recorded_seq, r.claim) for r in s.table("memories").collect())
    post = lambda s: sorted((r.term, r.id, r.tf, tuple(r.at)) for r in s.index().postings.collect())
    assert view(store) == view(once) == sorted(final.items()) and post(store) == post(once)
    hits = lambda s, q: [(r.record_digest, round(r.score, 9)) for r in recall(s.table("memories"), s.table("provenance_edges"), RecallOptions(q, hops=0), s.index()).hits.collect()]
    for q in ("common beta", "replaced3", "fresh common1", "number77", "number3 word3"):
        assert hits(store, q) == hits(once, q)
    snapshot, before = store.snapshot, post(store)
    assert store.compact() == snapshot + 1 and post(store) == before and view(store) == view(once)
    assert {r.part for r in store.parts().collect()} == {0} and store.compact() == snapshot + 1
    old = EvidenceStore.open_read_only(spark, root, 1)
    assert old.table("memories").count() == 4000
    with pytest.raises(PermissionError):
        old.compact()
    copy = str(tmp_path / "copy")
    EvidenceStore(spark, root, text=PLAIN).backup_to(copy)
    assert EvidenceStore.open_read_only(spark, copy).table("memories").count() == len(final)


def test_parts_are_checked_before_they_count(spark, tmp_path):
    for store in (EvidenceStore.open(spark, str(tmp_path / "s"), PLAIN), MemoryStore(spark)):
        links = spark.createDataFrame([(claims(spark, [(1, "a")]).first().record_digest, "o")], "record_digest string, observation_identity string")
        store.commit(rows={"memories": claims(spark, [(1, "a"), (2, "b")])})
        with pytest.raises(ConstraintError):  # an unknown observation
            store.commit(rows={"memory_observations": links})
        with pytest.raises(ConstraintError):  # a claim without text
            store.commit(rows={"memories": claims(spark, [(3, " ")])})
        policy = spark.createDataFrame([("p", "m", "a", "r", None, "u")], "identity string, metric string, aggregation string, comparison_rule string, step_budget long, unit string")
        observation = spark.createDataFrame([("o", "k", "absolute", "1", 1.0, "p", "s", None, "r", None)], store.table("observations").schema)
        store.commit(rows={"measurement_policies": policy, "observations": observation, "memory_observations": links})
        with pytest.raises(ConstraintError):  # what is referred to can't go
            store.commit(gone={"memories": claims(spark, [(1, "a")]).select("record_digest")})
        store.commit(gone={"memories": claims(spark, [(2, "b")]).select("record_digest")})
        assert [r.claim for r in store.table("memories").collect()] == ["a"] and store.snapshot == 3
        assert store.commit(rows={"memories": claims(spark, [(9, "z")])}, dry_run=True) == 3 and store.table("memories").count() == 1


def test_lookups_skip_row_groups(spark, tmp_path):
    store = EvidenceStore.open(spark, str(tmp_path / "big"), PLAIN)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.commit(rows={"memories": claims(spark, [(i, f"claim {i}") for i in range(8000)])})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted = claims(spark, [(i, "x") for i in (17, 4711)]).select(F.col("record_digest").alias("digest"))
    found = temporal.lookup(store.table("memories"), wanted)
    assert sorted(r.recorded_seq for r in found.collect()) == [17, 4711]
    plan = found._jdf.queryExecution().executedPlan()
    scans = [p for p in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())) if "numOutputRows" in str(p.metrics())]
    assert 2 <= sum(p.metrics().get("numOutputRows").get().value() for p in scans) < 8000 * 3 // 8
    many = claims(spark, [(i, "x") for i in range(40)]).select(F.col("record_digest").alias("digest"))
    assert temporal.lookup(store.table("memories"), many).count() == 40


def test_phrases_stay_within_a_field(spark):
    docs = spark.createDataFrame([(1, "a b a b c", "c a"), (2, "b a", "b c"), (3, "a a a", ""), (4, None, None), (5, "c", "a b")], "id int, x string, y string")
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    index, _ = lexical.postings(docs, "id", [(words("x"), 1.0), (words("y"), 0.5)])
    asked = {"a b": ["a", "b"], "c a": ["c", "a"], "a a": ["a", "a"], "b a b": ["b", "a", "b"], "b c": ["b", "c"], "z a": ["z", "a"]}
    got = {(r.term, r.id): (r.tf, [(p >> 28, p & (1 << 28) - 1) for p in r.at]) for r in lexical.phrase_postings(index, spark.createDataFrame(list(asked.items()), "phrase string, terms array<string>")).collect()}
    assert got == {
        ("a b", 1): (2.0, [(0, 0), (0, 2)]), ("a b", 5): (0.5, [(1, 0)]), ("c a", 1): (0.5, [(1, 0)]), ("a a", 3): (2.0, [(0, 0), (0, 1)]),
        ("b a b", 1): (1.0, [(0, 1)]), ("b c", 1): (1.0, [(0, 3)]), ("b c", 2): (0.5, [(1, 0)]),
    }
    assert lexical.phrase_postings(index.limit(0), spark.createDataFrame(list(asked.items()), "phrase string, terms array<string>")).collect() == []


def test_phrases_of_a_stated_set_need_no_postings(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, *(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) or None for _ in range(2))) for k in range(80)], "id int, x string, y string").repartition(3)
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    fields = [(words("x"), 1.0), (words("y"), 0.5)]
    asked = [(" ".join(t), t) for t in {tuple(rng.choice("abcdz") for _ in range(rng.randint(1, 5))) for _ in range(60)}] + [("other name", ("a", "b")), ("a b", ("a", "b"))]
    phrases = spark.createDataFrame(sorted(set(asked)), "phrase string, terms array<string>")
    rows = lambda df: sorted((r.term, r.id, r.tf, r.at) for r in df.collect())
    want = rows(lexical.phrase_postings(lexical.postings(docs, "id", fields)[0], phrases))
    assert len(want) > 500 and rows(lexical.phrases_in(docs, "id", fields, phrases.union(phrases))) == want
    assert "Exchange" not in lexical.phrases_in(docs.coalesce(1), "id", fields, phrases.where("phrase <> 'other name'"))._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    assert rows(lexical.phrases_in(docs, "id", fields, phrases.limit(0))) == []
    monkeypatch.setattr(lexical, "PHRASES", 5)
    assert rows(lexical.phrases_in(docs, "id", fields, phrases)) == want


def test_a_phrase_in_a_query_counts_as_a_term(spark, tmp_path):
    store = EvidenceStore.open(spark, str(tmp_path / "phrases"))
    store.commit(rows={"memories": claims(spark, [(1, "the quick brown fox"), (2, "brown and quick"), (3, "fox")])})
    assert {r.record_digest for r in lexical_branch(store.index(), "quick_brown").collect()} == {claims(spark, [(1, "")]).first().record_digest}


def test_many_touched_keys_join_only_marked_rows(spark, monkeypatch):
    from lodestone.operators import parts

    base = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    changed = spark.range(0, 3000, 7).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("k"), (-F.col("id")).alias("v"))
    gone = spark.range(0, 3000, 11).select(F.col("id").cast("string").alias("k"))
    given = [Part(base), Part(changed, changed.select("k"), 429), Part(base.limit(0), gone, 273)]
    few = sorted(map(tuple, merged(given, ["k"]).collect()), key=str)
    monkeypatch.setattr(parts, "SMALL", 10)
    many = merged(given, ["k"])
    assert sorted(map(tuple, many.collect()), key=str) == few
    sure, maybe = parts._split(base, [(1, given[1]), (2, given[2])], ["k"], 702)
    assert sure.count() + maybe.count() == 3000 and 660 <= maybe.count() < 900
    hit = sure.join(gone, "k", "left_semi")
    assert hit.isEmpty()


def test_postings_and_copies_need_no_shuffle(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a b c", "c a"), (2, "b a", "b c"), (3, None, ""), (4, "d" * 40, "e")], "id int, x string, y string")
    words = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    fields = [(words("x"), 1.0), (words("y"), 0.5)]
    index, lengths = lexical.postings(docs, "id", fields)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    whole = sorted((r.term, r.id, r.tf, tuple(r.at)) for r in index.collect())
    assert [w for w in whole if w[1] == 1] == [("a", 1, 2.5, (0, 2, (1 << 28) + 1)), ("b", 1, 2.0, (1, 3)), ("c", 1, 1.5, (4, 1 << 28))]
    monkeypatch.setattr(lexical, "TOKENS", 3)
    few, n = lexical.postings_of(docs, "id", fields, ["a", "c", "z"])
    assert sorted((r.term, r.id, r.tf, tuple(r.at)) for r in few.collect()) == [w for w in whole if w[0] in ("a", "c")]
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, lengths.collect()))
    store = EvidenceStore.open(spark, str(tmp_path / "s"), PLAIN)
    store.commit(rows={"memories": claims(spark, [(i, f"running word{i}") for i in range(20)])})
    store.commit(rows={"memories": claims(spark, [(3, "runs")])}, gone={"memories": claims(spark, [(4, "x")]).select("record_digest")})
    monkeypatch.setattr(EvidenceStore, "validate", lambda *_: 1 / 0)  # a snapshot was checked when it was made
    store.backup_to(str(tmp_path / "copy"))
    copy = EvidenceStore.open_read_only(spark, str(tmp_path / "copy"))
    view = lambda s: sorted((r.term, r.id, r.tf, tuple(r.at)) for r in s.index().postings.collect())
    assert view(copy) == view(store) and "running" in {r[0] for r in view(copy)}
    assert sorted(r.claim for r in copy.table("memories").collect()) == sorted(r.claim for r in store.table("memories").collect())
