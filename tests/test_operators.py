import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import conflict, context, entity, evaluate, graph, keyed, personal, stored, temporal, vector, write
from lodestone.plans.recall import RecallOptions, recall
from lodestone.schemas import EVIDENCE, ConstraintError, assert_constraints, violations

D = {k: k * 64 for k in "abcdef0123456789"}


def records(spark, rows):
    """(letter, seq, claim, superseded_by, superseded_seq, occurred_at)"""
    full = [(s, D[k], c, "external", None, "", None, o, o, D.get(by), "2024-07-30" if by else None, bs, None, None, None) for k, s, c, by, bs, o in rows]
    return spark.createDataFrame(full, EVIDENCE["memories"])


def edges(spark, rows):
    return spark.createDataFrame([(D[a], D[b], k, "2024-01-01") for a, b, k in rows], EVIDENCE["provenance_edges"])


@pytest.fixture(scope="module")
def seed(spark):
    m = records(spark, [("a", 1, "rail gauge is wide", "b", 2, "2024-07-29T00:00:00Z"), ("b", 2, "rail gauge is narrow", None, None, "2024-07-30T00:00:00Z"), ("c", 50, "gauge gauge gauge", None, None, None), ("d", 51, "other thing", None, None, "2024-01-01T00:00:00Z")])
    return m, edges(spark, [("b", "a", "supersedes"), ("c", "b", "contradicts"), ("c", "a", "derivedFrom"), ("d", "c", "supports")])


def test_belief_and_windows(seed):
    m, e = seed
    digests = m.select(F.col("record_digest").alias("digest"))
    at = lambda s: {r.record_digest[0]: r.belief for r in temporal.belief_at(m, digests, s).collect()}
    assert at(1) == {"a": "Current", "b": "NotYetKnown", "c": "NotYetKnown", "d": "NotYetKnown"}
    assert at(50)["a"] == "Retired" and at(50)["c"] == "Current"
    assert [r.record_digest[0] for r in temporal.current_as_of(m, 50).collect()] == ["b", "c"]
    assert [r.record_digest[0] for r in temporal.valid_in_window(m, "2024-01-01", "2024-12-31", 51).collect()] == ["d", "a", "b"]
    assert [(r.record_digest[0], r.cited[0]) for r in temporal.stale_citations(m, e).collect()] == [("c", "a")]
    assert temporal.seq_at(m, "2024-07-29T12:00:00Z").first().outcome == "Resolved"
    assert temporal.seq_at(m, "2020").first().outcome == "Unresolvable"
    assert temporal.seq_at(m.limit(0), "2020").first().outcome == "BeforeFirst"


def test_walks_end_on_cycles_and_dangle(spark):
    e = edges(spark, [("a", "b", "supports"), ("b", "c", "supports"), ("c", "a", "supports"), ("c", "f", "citesArtifact")])
    s = spark.createDataFrame([(D["a"],)], "seed string")
    assert sorted((r.node[0], r.depth) for r in graph.walk(s, e, 8).collect()) == [("a", 0), ("b", 1), ("c", 2), ("f", 3)]
    assert sorted((r.node[0], r.depth) for r in graph.walk(s, e, 1, "both").collect()) == [("a", 0), ("b", 1), ("c", 1)]
    nodes = spark.createDataFrame([(D[k], k) for k in "abc"], "record_digest string, claim string")
    t = {r.node[0]: (r.depth, r.dangling, r.edge_kinds) for r in graph.trace(s, e, nodes, 8).collect()}
    assert t == {"b": (1, False, ["supports"]), "c": (2, False, ["supports"]), "f": (3, True, ["citesArtifact"])}
    with pytest.raises(ValueError):
        graph.walk(s, e, 1, "sideways")


def test_graph_figures(spark):
    nodes = spark.createDataFrame([(k,) for k in "uvwxyz"], "node string")
    e = spark.createDataFrame([("u", "v", "supports"), ("v", "w", "supports"), ("x", "y", "supports"), ("z", "gone", "supports")], "src string, dst string, edge_kind string")
    c = graph.coverage(nodes, e).first()
    assert (c.nodes, c.edges, c.dangling) == (6, 3, 1) and c.mean_degree == 1.0 and c.isolated_pct == pytest.approx(100 / 6)
    assert {r.node: r.component for r in graph.components(nodes, e).collect()} == {"u": "u", "v": "u", "w": "u", "x": "x", "y": "x", "z": "z"}
    assert graph.coverage(nodes.limit(0), e).first().mean_degree == 0.0


def test_conflicts_are_symmetric_and_gate_answers(spark, seed):
    m, e = seed
    owed = lambda k: conflict.obligations(spark.createDataFrame([(D[k],)], "digest string"), e, m)
    assert [r.other[0] for r in owed("b").collect()] == ["c"] and [r.other[0] for r in owed("c").collect()] == ["b"]
    ack = lambda t: spark.createDataFrame([(D["c"], D["b"], t)], "a string, b string, resolution string")
    assert conflict.gate(owed("b"), ack("newer gauge"))[0] and not conflict.gate(owed("b"), ack("  "))[0]


def test_recall_withholds_counts_and_pushes_conflicts(spark, seed):
    m, e = seed
    r = recall(m, e, RecallOptions("gauge", as_of="2024-08-01T00:00:00Z", hops=1))
    hits = r.hits.collect()
    assert hits[0].record_digest == D["c"] and D["a"] not in [h.record_digest for h in hits]
    assert [w.record_digest for w in r.withheld.collect()] == [D["a"]]
    assert {h.record_digest[0]: [c[0] for c in h.conflicts] for h in hits}["b"] == ["c"]
    assert [(p.a[0], p.b[0]) for p in r.conflicting_pairs.collect()] == [("b", "c")]
    assert r.counts.first().unique == 3 and r.counts.first().lexical == 2
    assert recall(m, e, RecallOptions("--")).hits.collect() == []
    assert {h.record_digest[0] for h in recall(m, e, RecallOptions("gauge", hops=0, include_retired=True)).hits.collect()} == {"a", "b", "c"}
    assert RecallOptions("x", limit=1000, hops=9).limit == 100 and RecallOptions("x", hops=9).hops == 4


def test_underscored_query_is_a_phrase(spark):
    m = records(spark, [("a", 1, "foo bar", None, None, None), ("b", 2, "bar foo", None, None, None), ("c", 3, "else", None, None, None), ("d", 4, "more", None, None, None), ("e", 5, "text", None, None, None)])
    e = edges(spark, [("a", "c", "supports")])
    assert [h.record_digest[0] for h in recall(m, e, RecallOptions("foo_bar", hops=0)).hits.collect()] == ["a"]


def test_bm25_against_sqlite_fts5(spark):
    import sqlite3

    texts = [("the quick brown fox", "a"), ("running foxes run quickly", "b c"), ("lazy dogs sleep", "fox"), ("café society", "x"), ("nothing here at all", "y z")]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE f USING fts5(claim, loc, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("INSERT INTO f VALUES (?, ?)", texts)
    from lodestone.plans.recall import Index, lexical_branch

    m = records(spark, [(k, i, t, None, None, None) for i, (k, (t, _)) in enumerate(zip("abcde", texts, strict=True))]).drop("source_locator").join(spark.createDataFrame([(D[k], loc) for k, (_, loc) in zip("abcde", texts, strict=True)], "record_digest string, source_locator string"), "record_digest")
    index = Index.build(m)
    for q in ("fox", "quick fox fox", "cafe", "sleeping dog"):
        want = dict(db.execute("SELECT rowid, -bm25(f, 1.0, 0.5) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in q.split()),)).fetchall())
        got = {"abcde".index(r.record_digest[0]) + 1: r.score for r in lexical_branch(index, q).collect()}
        assert got == pytest.approx(want, rel=1e-9), q


def test_vectors_keep_to_their_space(spark, seed):
    m, _ = seed
    e = spark.createDataFrame([("p", D["a"], [1.0, 0.0], "t", "x"), ("p", D["b"], [1.0, 1.0], "t", "x"), ("q", D["c"], [1.0, 0.0], "t", "x")], EVIDENCE["embeddings"])
    assert [r.record_digest[0] for r in vector.vector_search(e, m, "p", [1.0, 0.0], 5).collect()] == ["b"]
    assert [r.record_digest[0] for r in vector.vector_search(e, m, "p", [1.0, 0.0], 5, True).collect()] == ["a", "b"]
    with pytest.raises(ConstraintError):
        vector.vector_search(e, m, "p", [1.0], 5)
    assert tuple(vector.coverage(m, e, "p").first()) == (1, 3)
    assert {r.record_digest[0] for r in vector.missing(m, e, "p").collect()} == {"c", "d"}
    new = spark.createDataFrame([("p", D["a"], [0.0, 2.0], "t", "y")], EVIDENCE["embeddings"])
    assert vector.put_embeddings(e, new, {"p": 2}).count() == 3
    with pytest.raises(ConstraintError):
        vector.put_embeddings(e, new, {"p": 3})
    assert vector.from_blob(vector.to_blob([1.0, -2.5]), 2) == [1.0, -2.5]


def test_entities_longest_match_and_boundaries(spark):
    dic = entity.Dictionary([("e1", "Model X", ["MX"]), ("e2", "Model X Large", []), ("e3", "İstanbul", [])])
    assert [m[0] for m in dic.mentions("model x large and MX, mxs amx model xl")] == ["e2", "e1"]
    m = records(spark, [("a", 1, "Model X here and there MX", None, None, None), ("b", 2, "model x large", None, None, None)])
    men = entity.index_mentions(m, dic)
    assert men.count() == 3 and {r.extractor_identity for r in men.collect()} == {dic.identity}
    out = entity.entity_search("MX against Model X Large", dic, men, m, 5).collect()
    assert [(r.record_digest[0], r.shared) for r in out] == [("a", 1), ("b", 1)]
    assert entity.entity_search("nobody", dic, men, m, 5).collect() == []


def test_constraints_both_ways(spark):
    good = edges(spark, [("a", "b", "supports")])
    assert assert_constraints(good, "provenance_edges").count() == 1
    bad = spark.createDataFrame([("x", "x", "supports", ""), ("x", "y", "likes", ""), ("x", "y", None, "")], EVIDENCE["provenance_edges"])
    assert sorted(tuple(r.broken) for r in violations(bad, "provenance_edges").collect()) == [("kind",), ("kind",), ("no-loop",)]
    with pytest.raises(ConstraintError):
        assert_constraints(bad, "provenance_edges")


def test_writes(spark, seed):
    m, e = seed
    new = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "key string, v int")
    assert sorted(r.outcome for r in keyed.insert_absent(new.limit(0), new, ["key"]).collect()) == ["already-present", "inserted", "inserted"]
    assert keyed.appended(new.where("v = 1"), new, ["key"]).count() == 2
    m2, e2 = write.supersede(m, e, D["d"], D["c"], "2024-09-01")
    assert m2.where(F.col("record_digest") == D["d"]).first().superseded_seq == 51 and e2.count() == e.count() + 1
    for args in ((D["a"], D["c"]), (D["d"], D["d"]), ("x", D["c"])):
        with pytest.raises(ConstraintError):
            write.supersede(m, e, *args, "2024-09-01")
    specs = spark.createDataFrame([("r1", "ratio", "o1", "o2", 2), ("r2", "ratio", "o1", "o2", 2), ("r3", "ratio", "o1", "o3", 2)], "record_digest string, transform string, left string, right string, decimals int")
    obs = spark.createDataFrame([("o1", "287.17"), ("o2", "39.52"), ("o3", "0")], "identity string, value_text string")
    claims = spark.createDataFrame([("r1", "speedup 7.27x"), ("r2", "speedup 8.10x"), ("r3", "speedup 1")], "record_digest string, claim string")
    assert {r.record_digest: r.problem for r in write.verify_derivations(specs, obs, claims).collect()} == {"r1": None, "r2": "mismatch", "r3": "division-by-zero"}


def test_context_costs(spark):
    turns = [("s", t, f"core{i}", 200) for t in range(8) for i in range(6)] + [("s", t, f"new{t}", 200) for t in range(8)]
    df = spark.createDataFrame(turns, "session string, turn int, record string, cost long")
    rebuilt, append = context.rebuild_cost(df).first(), context.append_cost(df).first()
    assert (rebuilt.prefill, rebuilt.peak, rebuilt.turns) == (8 * 1400, 1400, 8) and append.prefill == 14 * 200
    assert tuple(context.append_cost_with_budget(df, 10_000).first())[2:] == (2800, 0, 2800)
    big = spark.createDataFrame([("s", t, f"r{t}", 1000) for t in range(8)], "session string, turn int, record string, cost long")
    r = context.append_cost_with_budget(big, 3500).first()
    assert r.invalidations == 5 and r.prefill > 8000
    plan = context.plan_append(["x", "y", "x", "z"], ["z"])
    assert plan["append"] == ["x", "y"] and plan["suppressed"] == ["z"]


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 11)], "query_id int, id string, rank int")
    rel = spark.createDataFrame([(1, "k", "b"), (1, "k", "z"), (2, "k", "c")], "query_id int, class string, id string")
    r = evaluate.evaluate(ranked, rel).first()
    assert (r.recall, r.mrr, r.queries) == (0.25, 0.25, 2)


def capture(spark, state, key, text, at="2024-01-01T00:00:00.000Z", origin="o1", local=True):
    rec = spark.createDataFrame([(key, text, None, "{}", at, False)], "content_digest string, content string, occurred_at string, metadata string, created_at string, tombstoned boolean")
    sight = spark.createDataFrame([("dev", origin, key, at, None, None)], "origin_device string, origin_id string, record_digest string, created_at string, source string, conversation string")
    tag = spark.createDataFrame([(key, "t")], "record_digest string, tag string")
    return personal.merge(state, rec, sight, tag, local)


def test_personal_store(spark):
    s = capture(spark, personal.PersonalState.new(spark), "k1", "Hello World")
    again = capture(spark, s, "k1", "Hello World")
    assert again["promotion_changes"].count() == 1 and again["canonical_records"].count() == 1
    with pytest.raises(ConstraintError):
        capture(spark, s, "k2", "x", origin="o1")
    s = capture(spark, s, "k2", "from afar", origin="o2", local=False)
    assert [r.content_digest for r in personal.recall(s, 10, "hello").collect()] == ["k1"]
    with pytest.raises(ConstraintError):
        personal.forget(s, "k2")
    gone = personal.forget(s, "k1")
    assert gone["promotion_changes"].count() == 2 and personal.forget(gone, "k1")["promotion_changes"].count() == 2
    assert capture(spark, gone, "k1", "Hello World")["canonical_records"].where("tombstoned").count() == 1
    d = personal.flag_divergence(personal.flag_divergence(s, "k2", "k1"), "k1", "k2")
    assert d["personal_divergences"].count() == 1 and personal.active(d).count() == 0
    pair = d["personal_divergences"].first().id
    assert personal.active(personal.acknowledge_divergence(d, pair, "2024-02-01T00:00:00.000Z")).count() == 2
    r = personal.reset_replica(s)
    assert [x.content_digest for x in r["canonical_records"].collect()] == ["k1"] and r["replica_records"].count() == 0
    b = personal.bump_epoch(gone)
    assert [(x.epoch, x.sequence, x.operation) for x in b["promotion_changes"].collect()] == [(2, 1, "tombstone")]
    with pytest.raises(ConstraintError):
        personal.acknowledge(s, 9, 9)
    assert personal.acknowledge(s, 1, 1)["promotion_outbox"].first().state == "promoted"


def test_export_runs_to_the_end_of_the_epoch(spark):
    rows = [(3, s) for s in range(1, 1001)] + [(4, s) for s in range(1, 11)]
    changes = spark.createDataFrame(rows, "epoch long, sequence long").repartition(3)
    assert [(r.epoch, r.sequence) for r in personal.export_changes(changes, 3, 400).collect()] == [(3, s) for s in range(401, 1001)]
    assert personal.export_changes(changes, 3, 1000).count() == 10 and personal.export_changes(changes, 4, 10).count() == 0


def test_components_of_long_chains_are_whole_or_an_error(spark):
    name = lambda i: f"n{i:03d}"
    chain = [1, *range(300, 1, -1)]
    nodes = spark.createDataFrame([(name(i),) for i in chain] + [("alone",)], "node string")
    e = spark.createDataFrame([(name(a), name(b), "supports") for a, b in zip(chain, chain[1:])], "src string, dst string, edge_kind string")
    got = {r.node: r.component for r in graph.components(nodes, e).collect()}
    assert got == {name(i): name(1) for i in chain} | {"alone": "alone"}
    with pytest.raises(ValueError):
        graph.components(nodes, e, rounds=1)


def test_neighbours_are_joined_in_parts_of_bounded_rows(spark, monkeypatch):
    edges = spark.createDataFrame([(i % 50, i * 7 % 90, "supports") for i in range(400)], "src int, dst int, edge_kind string")
    digests = spark.createDataFrame([(i % 60,) for i in range(100)] + [(None,)], "digest int")
    want = sorted([(s, d, k, True) for s, d, k in edges.collect() if s < 60] + [(d, s, k, False) for s, d, k in edges.collect() if d < 60])
    assert sorted(map(tuple, graph.neighbours(digests, edges).collect())) == want
    monkeypatch.setattr(stored, "ROWS", 100)
    monkeypatch.setattr(graph, "SMALL", 10)
    parts = graph.neighbours(digests, edges)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, parts.collect())) == want
    assert parts.rdd.getNumPartitions() == 8 and "BroadcastHashJoin" not in plan and plan.count("Exchange hashpartitioning") == 2 == plan.count("REPARTITION_BY_NUM")


def test_derivations_are_joined_in_parts_of_bounded_rows(spark, monkeypatch):
    observations = spark.createDataFrame([(f"o{k}", str(k)) for k in range(300)], "identity string, value_text string")
    specs = spark.createDataFrame([(f"r{k}", "delta", f"o{k + 7}", f"o{k % 5}" if k % 9 else None, 2) for k in range(200)], "record_digest string, transform string, left string, right string, decimals int")
    said = spark.createDataFrame([(f"r{k}", f"it is {k + 7 - k % 5 + (k % 10 == 0)}") for k in range(190)], "record_digest string, claim string")
    whole = write.verify_derivations(specs, observations, said)
    monkeypatch.setattr(stored, "ROWS", 50)
    parts = write.verify_derivations(specs, observations, said)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and parts.where("verified").count() > 100
    assert "BroadcastHashJoin" not in plan and plan.count("REPARTITION_BY_NUM") == 6 == plan.count("Exchange hashpartitioning")


def test_details_travel_in_parts_and_names_by_their_size(spark, monkeypatch):
    memories = spark.createDataFrame([(k, f"c{k}") for k in range(120)], "record_digest long, claim string")
    edges = spark.createDataFrame([(k, k * 7 % 120, "supports") for k in range(1, 120)], "src long, dst long, edge_kind string")
    rows = [(k % 130, k) for k in range(400) if k % 11] + [(5, k) for k in range(0, 40, 3)] + [(7, None)]
    bridge = spark.createDataFrame(rows, "record_digest long, observation_identity long")
    seen = [(k, str(k % 4), k % 9, k % 5 if k % 17 else None, k % 3 if k % 2 else None) for k in range(380)]
    observations = spark.createDataFrame(seen, "identity long, value_text string, policy_identity long, suite_identity long, reference_identity long")
    policies = spark.createDataFrame([(k, f"m{k}", "s") for k in range(8)], "identity long, metric string, unit string")
    suites = spark.createDataFrame([(k, f"s{k}") for k in range(5)], "identity long, suite_name string")
    references = spark.createDataFrame([(k, f"r{k}") for k in range(2)], "identity long, runtime_identity string")

    def detail(asked, **known):
        return write.record_detail(memories, edges, bridge, observations, policies, suites, references, spark.createDataFrame([(k,) for k in asked], "digest long"), **known)

    def want(asked):
        o = {i: (v, p, s, r) for i, v, p, s, r in seen}
        found = lambda k: sorted((i, o[i][0], f"m{o[i][1]}", "s", f"s{o[i][2]}", None if o[i][3] in (None, 2) else f"r{o[i][3]}") for r, i in rows if r == k and i in o and o[i][1] < 8 and o[i][2] is not None)
        met = lambda k: sorted([("out", "supports", k * 7 % 120)] * (k > 0) + [("in", "supports", a) for a in range(1, 120) if a * 7 % 120 == k])
        return [(k, f"c{k}", found(k) or None, met(k) or None) for k in sorted({k for k in asked if 0 <= k < 120})]

    def got(df):
        return sorted((r[0], r[1], r[2] and [tuple(x) for x in r[2]], r[3] and [tuple(x) for x in r[3]]) for r in df.collect())

    most, few = [*range(-3, 110), 4], [5, 7, 90, 129, 400]
    assert got(detail(most)) == want(most) and got(detail(few)) == want(few)
    monkeypatch.setattr(stored, "ROWS", 50)
    assert got(detail(most)) == want(most) and got(detail(few, rows=len(rows))) == want(few)
    monkeypatch.setattr(write, "NAMES", 2)
    assert got(detail(most)) == want(most) and got(detail(few)) == want(few)
    plan = detail(most)._jdf.queryExecution().executedPlan().toString()
    # the two references alone go to every task; both sides of two tables of names, the observations, the records, their digests (read twice) and edges are dealt
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("REPARTITION_BY_NUM") == 9


def test_lines_meet_their_orders_after_one_shuffle_a_side(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    con = pytest.importorskip("duckdb").connect()
    for t in ("orders", "lineitem", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(con.execute(queries.ORACLES["record_detail"]).fetchall())
    monkeypatch.setattr(stored, "ROWS", 1000)
    out = queries.QUERIES["record_detail"](spark, d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == want
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("hashpartitioning(observation_identity" in x for x in dealt) == 2 and all("REPARTITION_BY_NUM" in x for x in dealt)
