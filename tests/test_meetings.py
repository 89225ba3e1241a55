"""Conflict classes, containment and merged logs against their plain definitions."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import conflict, entity, graph, keyed, lexical
from lodestone.operators.contain import containing
from lodestone.streaming import change_log
from tests.test_stores import wire


def test_classes_count_what_pairs_would(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcde") if i % 11 else None, rng.choice(["x", "y", None])) for i in range(120)] + [(200, "alone", "x"), (201, "same", "x"), (202, "same", "x")]
    d = spark.createDataFrame(rows, "id int, topic string, side string")
    classed = conflict.classes(d, "id", "topic", "side")
    got = {r.id: (r["class"], r.members, r.conflicts) for r in classed.collect()}
    others = {i: [j for j, t2, s2 in rows if t is not None and t2 == t and s2 != s] for i, t, s in rows}
    assert got == {i: (min(j for j, t2, _ in rows if t2 == t), sum(t2 == t for _, t2, _ in rows), len(others[i])) for i, t, _ in rows if others[i]}
    asked = conflict.members(classed, spark.createDataFrame([(3,), (7,), (200,)], "id int"))
    assert sorted(map(tuple, asked.collect())) == sorted((i, j) for i in (3, 7, 200) for j in others[i])
    assert conflict.classes(d.limit(0), "id", "topic", "side").collect() == []


def test_containment_by_the_rarest_word(spark):
    texts = ["the quick brown fox jumps", "xthe quick brown foxes", "quick brown", "a-b  c", "", None, "brown quick the", "the quick  brown fox", "ab"]
    needles = ["the quick brown fox", "quick brown fox", "brown", "a-b  c", "b  c", "", None, "no such word here", "the quick brown fox jumps", "he quick brown fo"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string")
    want = {(i, k) for i, x in enumerate(texts) for k, y in enumerate(needles) if x is not None and y is not None and y in x}
    assert {tuple(r) for r in containing(t, "id", "text", n, "needle_id", "needle").collect()} == want
    long = n.where("size(split(needle, '[^a-z]+')) > 2")
    out = containing(t, "id", "text", long, "needle_id", "needle")
    assert {tuple(r) for r in out.collect()} == {(i, k) for i, k in want if k in {r.needle_id for r in long.collect()}}
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert containing(t, "id", "text", n.limit(0), "needle_id", "needle").collect() == []


def test_batches_write_their_own_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(change_log, "FOLD", 3)
    rows = [(1, i + 1, "tombstone" if i == 5 else "upsert", f"k{i % 4}", f"2024-01-{20 - i:02d}") for i in range(12)]
    root = str(tmp_path / "log")
    sizes = []
    for k in range(0, 12, 2):
        assert change_log.advance(spark, root, wire(spark, rows[: k + 2]))
        version, *_ = change_log._head(spark, root)
        sizes.append(spark.read.parquet(f"{root}/records/v{version}").count())
        seen = {r.content_digest: (r.created_at, r.tombstoned) for r in change_log.current(spark, root).collect()}
        assert seen == {d: (min(x[4] for x in rows[: k + 2] if x[3] == d), any(x[2] == "tombstone" for x in rows[: k + 2] if x[3] == d)) for d in {x[3] for x in rows[: k + 2]}}
    assert sizes == [2, 2, 2, 4, 2, 2]  # the fourth batch folds three parts


def test_the_automaton_finds_what_the_pattern_does(spark, monkeypatch):
    rng = random.Random(9)
    forms = ["new york", "new", "york", "york city", "new york city hall", "é", "a-b", "b", "x" * 40, *("".join(rng.choice("abn ") for _ in range(rng.randint(1, 6))).strip() or "n" for _ in range(150))]
    rows = [(f"e{k}", f, []) for k, f in enumerate(dict.fromkeys(forms))]
    text = [" ".join(rng.choice([*forms, "zz", "new-york", "éa", "1b", "_b_", "B"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "new york city hall", "newyork city"]
    found = {}
    for few in (0, 10_000):
        monkeypatch.setattr(entity, "FEW", few)
        d = entity.Dictionary(rows)
        found[few] = [d.mentions(t) for t in text]
    assert found[0] == found[10_000] and sum(map(len, found[0])) > 200
    assert entity.Dictionary([]).mentions("a") == []


def test_a_hundred_thousand_forms(spark):
    forms = spark.range(100_000).select(F.concat(F.lit("entity"), "id").alias("id")).select("id", F.col("id").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"))
    d = entity.Dictionary.of(forms)
    m = spark.range(300).select(F.col("id").cast("string").alias("record_digest"), F.concat(F.lit("about Entity"), F.col("id") * 331, F.lit(" and entity"), F.col("id"), F.lit("x, entity99999")).alias("claim"))
    got = {(r.record_digest, r.entity_id) for r in entity.index_mentions(m, d).collect()}
    assert got == {(str(i), f"entity{i * 331}") for i in range(300)} | {(str(i), "entity99999") for i in range(300)}


def test_an_entity_table_beyond_a_worker_stays_where_it_is(spark, monkeypatch):
    rng = random.Random(4)
    forms = ["new york", "new", "york", "york city", "New York City Hall", "é", "a-b", "b", "日本", "#b", "x" * 40, *("".join(rng.choice("abn é") for _ in range(rng.randint(1, 6))) for _ in range(150))]
    entities = spark.createDataFrame([(f"e{k}", f, [f"{f} b"] if k % 3 else None) for k, f in enumerate([*forms, "new", "b"])], "id string, canonical_name string, aliases array<string>")
    text = [" ".join(rng.choice([*forms, "zz", "NEW-york", "éa", "1b", "_b_", "B", "東日本"]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", None, "new york city hall", "newyork city"]
    m = spark.createDataFrame([(k % 40, t) for k, t in enumerate(text)], "record_digest int, claim string")
    rows = lambda df: sorted(tuple(r) for r in df.select("record_digest", "entity_id", "start_offset", "end_offset").collect())
    want = rows(entity.index_mentions(m, entity.Dictionary.of(entities)))
    assert len(want) > 200 and rows(entity.index_mentions_of(m, entities)) == want
    occur = len("".join({f for f in forms if f}))
    of = monkeypatch.setattr
    of(entity.Dictionary, "of", None)  # from here on no table is collected
    far = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("id"), F.concat(F.lit("nowhere"), "id").alias("canonical_name"), F.lit(None).cast("array<string>").alias("aliases"))
    for limit in (20 * occur, 100):  # the forms that occur are few, or too many as well
        of(entity, "FORM_BYTES", limit)
        found = entity.index_mentions_of(m, entities.union(far))
        assert rows(found) == want and found.select("extractor_identity").distinct().count() == 1


def test_only_ranges_that_differ_are_met(spark):
    a = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7).alias("v"))
    b = a.where("k <> '17'").withColumn("v", F.when(F.col("k").isin("5", "4711"), F.lit(0)).otherwise(F.col("v"))).union(spark.createDataFrame([("new", 1), ("9", 63)], "k string, v long"))
    ranges = keyed.differing_ranges(a, b, "k", ["v"])
    assert ranges.count() == 5  # the lost one, two changed ones, the new one, and the one that is there twice
    assert keyed.within(a, "k", ranges).count() < 100
    got = keyed.difference(keyed.within(a, "k", ranges), keyed.within(b, "k", ranges), "k", ["v"])
    assert {(r.key, r.status) for r in got.collect()} == {(r.key, r.status) for r in keyed.difference(a, b, "k", ["v"]).collect()} == {("17", "Missing"), ("new", "Extra"), ("5", "Diverged"), ("4711", "Diverged")}
    assert keyed.differing_ranges(a, a, "k", ["v"]).count() == 0


def test_a_hub_is_dealt_over_shares(spark):
    star = spark.range(40_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), F.lit("supports").alias("edge_kind")).union(spark.createDataFrame([(7, 50_000, "supports"), (-2, -1, "supports"), (7, -1, "supports")], "src long, dst long, edge_kind string"))
    seeds = spark.createDataFrame([(-1,), (-2,), (7,)], "seed long")
    flat, dealt = (graph.walk(seeds, star, 2, hub=h) for h in (1 << 40, 1000))
    view = lambda df: df.groupBy("seed", "depth").agg(F.count("*").alias("n"), F.sum("node").alias("s")).orderBy("seed", "depth").collect()
    assert view(dealt) == view(flat) and dealt.exceptAll(flat).isEmpty()
    steps, deal = graph._dealt(star.select(F.col("src").alias("node"), F.col("dst").alias("next")), 1000)
    sizes = [r["count"] for r in steps.where("node = -1").groupBy("share").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 1300
    assert deal(spark.createDataFrame([(-1,), (7,)], "node long")).count() == 41


def test_rows_keep_their_best():
    rng = np.random.default_rng(3)
    ids = pa.array(rng.permutation(50))
    for k in (1, 3, 50, 80):
        score = rng.integers(0, 6, (20, 50)).astype(float)
        score[rng.random((20, 50)) < 0.3] = -np.inf
        score[4] = -np.inf
        row, col = lexical.kept_rows(score, ids, k)
        for q in range(20):
            want = sorted((-score[q, j], ids[j].as_py()) for j in range(50) if score[q, j] > -np.inf)[:k]
            assert sorted((-score[q, j], ids[int(j)].as_py()) for j in col[row == q].tolist()) == want
