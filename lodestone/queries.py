"""The engine's operators applied to the driver tables, each with its DuckDB equivalent where SQL has one.

The driver tables are no evidence tables, so each query states how it reads them: orders stand for
records (key = transaction time, date = valid time, a customer's next order retires the last one),
documents for claims, embeddings for vectors in one space a label, events for a change log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import store_queries
from lodestone.functions import scalar
from lodestone.functions.text import index_tokens_udf
from lodestone.operators import conflict, contain, context, entity, evaluate, graph, keyed, lexical, personal, temporal, vector, write
from lodestone.operators.stored import parted, spread
from lodestone.plans.recall import RecallOptions, recall
from lodestone.schemas import dangling, violations
from lodestone.sources.snapshot import table_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Orders as records."""
    o = _read(spark, d, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("record_digest"), F.col("o_orderkey").alias("recorded_seq"), F.col("o_orderpriority").alias("claim"), "o_custkey", "o_totalprice",
        day.alias("occurred_at"), day.alias("recorded_at"), nxt.alias("superseded_seq"), nxt.alias("superseded_at"), F.lit(None).cast("long").alias("retracted_seq"), F.lit(None).cast("string").alias("retracted_at"),
    )


RECORDS = """m AS (SELECT o_orderkey AS record_digest, o_orderkey AS recorded_seq, o_orderpriority AS claim, o_custkey, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS occurred_at, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS superseded_seq FROM orders)"""


def _edges(spark: SparkSession, d: str, beyond: int = 0) -> DataFrame:
    """A citation from each order to another; with ``beyond`` some point past the last one."""
    o = _read(spark, d, "orders").select("o_orderkey")
    n = o.agg((F.count("*") + beyond).alias("n"))
    kind = F.element_at(F.array(*map(F.lit, ["derivedFrom", "supports", "contradicts"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % F.col("n")).alias("dst"), kind.alias("edge_kind")).where("src <> dst")


def _edges_sql(beyond: int = 0) -> str:
    return f"""e AS (SELECT o_orderkey AS src, (o_orderkey * 31 + 7) % (SELECT count(*) + {beyond} FROM orders) AS dst,
  CASE o_orderkey % 3 WHEN 0 THEN 'derivedFrom' WHEN 1 THEN 'supports' ELSE 'contradicts' END AS edge_kind FROM orders
  WHERE o_orderkey <> (o_orderkey * 31 + 7) % (SELECT count(*) + {beyond} FROM orders))"""


# ---- lexical recall and evaluation

BM25 = r"""d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
q AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
w AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END::DOUBLE AS idf, avg_len FROM f, s),
b AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg_len)))::DOUBLE, 6) AS score
  FROM p JOIN w USING (term) JOIN i USING (term) JOIN d USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    terms = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(scalar.words_of(F.col("text"))).alias("term"))
    return lexical.rank(docs, "doc_id", [(scalar.words_of(F.col("text")), 1.0)], terms, 10, digits=6)


@query(f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10")
def lexical_recall(spark, d):
    """RT2, TK1, WN1: every benchmark item as a query over all documents."""
    return _ranked(spark, d).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"""WITH {BM25}, rel AS (SELECT item_id, doc_id, lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
h AS (SELECT rel.lang AS class, rel.item_id, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS rc, coalesce(max(CASE WHEN rank <= 10 THEN 1.0 / rank END), 0.0) AS rr
  FROM rel LEFT JOIN r ON rel.item_id = r.item_id AND rel.doc_id = r.doc_id GROUP BY ALL)
SELECT class, round(avg(rc)::DOUBLE, 6) AS recall, round(avg(rr)::DOUBLE, 6) AS mrr, count(*) AS queries FROM h GROUP BY class""")
def eval_mrr_recall_at_k(spark, d):
    """AG16: relevant are the documents that hold an item's text, classes are languages."""
    b, docs = _read(spark, d, "benchmark"), _read(spark, d, "documents")
    held = contain.containing(docs, "doc_id", "text", b, "item_id", "text")
    rel = held.join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("class")), "id").select(F.col("needle_id").alias("query_id"), "class", "id")
    out = evaluate.evaluate(_ranked(spark, d).select("query_id", "id", "rank"), rel)
    return out.select("class", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "queries")


@query("""SELECT o_orderkey, round(age, 6) AS age_days, round(rec, 6) AS recency, round((0.40 * least(1.0, o_totalprice / best) + 0.05 * rec)::DOUBLE, 6) AS score FROM (
  SELECT *, CASE WHEN age <= 0 THEN 1.0 ELSE pow(0.5, age / 180.0) END AS rec FROM (
    SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER () AS best, (epoch(TIMESTAMP '1998-01-01') - epoch(date_trunc('day', o_orderdate))) / 86400.0 AS age FROM orders))""")
def recency_blend(spark, d):
    """FM1, FM4, FM6, FD1: an order's price stands for its lexical score."""
    o = _read(spark, d, "orders")
    top = o.agg(F.max("o_totalprice").alias("best"))
    age = scalar.age_days(F.lit("1998-01-01T00:00:00Z"), F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'"))
    rec = scalar.recency(F.col("age_days"))
    s = scalar.blended(scalar.lexical_share(F.col("o_totalprice"), F.col("best")), F.lit(None), F.lit(None), F.lit(None), rec)
    return o.withColumn("age_days", age).join(F.broadcast(top)).select("o_orderkey", F.round("age_days", 6).alias("age_days"), F.round(rec, 6).alias("recency"), F.round(s, 6).alias("score"))


@query()
def hybrid_recall(spark, d):
    """RT1, RT5, RT6, FS2: stemmed index, provenance and conflicts; not expressible in SQL."""
    docs = _read(spark, d, "documents")
    m = docs.select(F.format_string("%012d", "doc_id").alias("record_digest"), F.col("text").alias("claim"), F.col("source").alias("source_locator"), F.lit("1998-01-01T00:00:00Z").alias("occurred_at"), F.when(F.col("doc_id") % 97 == 0, "1998-02-01").alias("superseded_at"), F.lit(None).cast("string").alias("retracted_at"))
    n = docs.agg(F.count("*").alias("n"))
    key = F.format_string("%012d", (F.col("doc_id") * 31 + 7) % F.col("n"))
    e = docs.join(F.broadcast(n)).select(F.format_string("%012d", "doc_id").alias("src"), key.alias("dst"), F.when(F.col("doc_id") % 5 == 0, "contradicts").otherwise("supports").alias("edge_kind")).where("src <> dst")
    text = _read(spark, d, "benchmark").orderBy("item_id").first().text
    return recall(m, e, RecallOptions(text, limit=20, as_of="1998-07-01T00:00:00Z", hops=1)).hits.select("record_digest", "branches", "hops", "score", "conflicts")


@query()
def stemmed_vocabulary(spark, d):
    """FS2: document frequency of folded and stemmed tokens."""
    t = _read(spark, d, "documents").select(F.explode(F.array_distinct(index_tokens_udf("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("df"))


# ---- vectors

@query("""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, vec_id, cosine, rank FROM r WHERE rank <= 3""")
def vector_topk(spark, d):
    """RT9, FM7, PF3, TK2: each vector's neighbours in its own space."""
    out = vector.neighbours(_read(spark, d, "embeddings"), "vec_id", "label", "embedding", 3, digits=6)
    return out.select("query_id", F.col("id").alias("vec_id"), "cosine", "rank")


@query("""SELECT label, count(*) AS n, sum(CASE WHEN len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN 1 ELSE 0 END)::BIGINT AS unit FROM embeddings GROUP BY label""")
def vector_norms(spark, d):
    """FM8, FM12: every finite vector that isn't zero has norm one once it is normalized; here doubled ones."""
    e = _read(spark, d, "embeddings").where(scalar.all_finite(F.col("embedding")))
    unit = scalar.l2_normalized(F.transform("embedding", lambda x: x * 2))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.abs(scalar._dot(unit, unit) - 1) < 1e-5, 1)).alias("unit"))


@query("SELECT count(v.vec_id) AS embedded, count(*) AS total FROM documents d LEFT JOIN embeddings v ON d.doc_id = v.vec_id")
def vector_coverage(spark, d):
    """RT16, AG9."""
    m = _read(spark, d, "documents").select(F.col("doc_id").alias("record_digest"), F.lit(None).cast("string").alias("superseded_at"))
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("record_digest"), F.lit("p").alias("profile_identity"))
    return vector.coverage(m, e, "p")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = d.doc_id)")
def embedding_todo(spark, d):
    """JN11, WR14."""
    m = _read(spark, d, "documents").select(F.col("doc_id").alias("record_digest"))
    e = _read(spark, d, "embeddings").select(F.col("vec_id").alias("record_digest"), F.lit("p").alias("profile_identity"))
    return vector.missing(m, e, "p").select(F.col("record_digest").alias("doc_id"))


# ---- time

@query(f"""WITH {RECORDS} SELECT record_digest, CASE WHEN recorded_seq > c THEN 'NotYetKnown' WHEN superseded_seq IS NULL OR superseded_seq > c THEN 'Current' ELSE 'Retired' END AS belief
FROM m, (SELECT count(*) // 2 AS c FROM orders)""")
def belief_as_of(spark, d):
    """SQ1, PF6: the state of each record at the middle of the log."""
    m = _records(spark, d)
    mid = m.agg(F.floor(F.count("*") / 2).alias("c"))
    return m.join(F.broadcast(mid)).select("record_digest", scalar.belief_state(F.col("c"), F.col("recorded_seq"), F.col("superseded_seq"), F.col("retracted_seq")).alias("belief"))


@query(f"WITH {RECORDS} SELECT record_digest, claim FROM m WHERE recorded_seq <= 7500 AND (superseded_seq IS NULL OR superseded_seq > 7500)")
def current_as_of(spark, d):
    """SQ2, TK5."""
    return temporal.current_as_of(_records(spark, d), 7500).select("record_digest", "claim")


@query(f"WITH {RECORDS} SELECT record_digest, occurred_at FROM m WHERE occurred_at BETWEEN '1996-01-01' AND '1996-12-31' AND recorded_seq <= 7500")
def valid_window_known_by(spark, d):
    """SQ5, PF5, TK6."""
    return temporal.valid_in_window(_records(spark, d), "1996-01-01", "1996-12-31", 7500).select("record_digest", "occurred_at")


@query(f"""WITH {RECORDS} SELECT CASE WHEN max(recorded_seq) FILTER (occurred_at <= '1996-06-30') IS NULL THEN 'BeforeFirst' ELSE 'Resolved' END AS outcome,
max(recorded_seq) FILTER (occurred_at <= '1996-06-30') AS sequence FROM m""")
def sequence_at_instant(spark, d):
    """SQ3, FD2, AG5."""
    return temporal.seq_at(_records(spark, d), "1996-06-30").select("outcome", "sequence")


@query(f"""WITH {RECORDS}, {_edges_sql()} SELECT DISTINCT e.src AS record_digest, e.dst AS cited, o.superseded_seq FROM e JOIN m me ON me.record_digest = e.src
JOIN m o ON o.record_digest = e.dst WHERE o.superseded_seq < me.recorded_seq""")
def stale_citations(spark, d):
    """SQ4, JN5."""
    return temporal.stale_citations(_records(spark, d), _edges(spark, d))


@query(f"WITH {RECORDS} SELECT record_digest, coalesce(superseded_seq, 0)::BIGINT AS retired_by, superseded_seq IS NULL AS live FROM m")
def live_and_retired(spark, d):
    """PF1, PF2, PF12: one frame with a flag gives hits and withheld rows."""
    m = _records(spark, d)
    return m.select("record_digest", F.coalesce("superseded_seq", F.lit(0)).alias("retired_by"), scalar.live(F.col("superseded_at"), F.col("retracted_at")).alias("live"))


# ---- graph

@query(f"""WITH RECURSIVE {_edges_sql()}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
k AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION SELECT k.seed, u.dst, k.depth + 1 FROM k JOIN u ON k.node = u.src WHERE k.depth < 2)
SELECT seed, node, min(depth)::INTEGER AS depth FROM k GROUP BY seed, node""")
def provenance_walk(spark, d):
    """RT11, RT5, JN7, AG1, SO2: both ways, two hops from every record."""
    return graph.walk(_read(spark, d, "orders").select(F.col("o_orderkey").alias("seed")), _edges(spark, d), 2, "both")


@query(f"""WITH RECURSIVE {_edges_sql(500)}, k AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION SELECT k.seed, e.dst, k.depth + 1 FROM k JOIN e ON k.node = e.src WHERE k.depth < 2),
w AS (SELECT seed, node, min(depth) AS depth FROM k GROUP BY seed, node HAVING min(depth) > 0),
g AS (SELECT dst, string_agg(edge_kind, ',' ORDER BY edge_kind) AS kinds FROM e GROUP BY dst)
SELECT seed, node, depth::INTEGER AS depth, kinds, o_orderpriority AS claim, o_orderkey IS NULL AS dangling FROM w LEFT JOIN g ON g.dst = w.node LEFT JOIN orders ON o_orderkey = w.node""")
def trace_dangling(spark, d):
    """RT12, JN8, JN19, AG4."""
    seeds = _read(spark, d, "orders").select(F.col("o_orderkey").alias("seed"))
    return graph.trace(seeds, _edges(spark, d, 500), _records(spark, d), 2).select("seed", "node", "depth", F.array_join("edge_kinds", ",").alias("kinds"), "claim", "dangling")


@query(f"WITH {_edges_sql()} SELECT src AS digest, dst AS other, edge_kind, true AS outgoing FROM e UNION ALL SELECT dst, src, edge_kind, false FROM e WHERE dst IN (SELECT o_orderkey FROM orders)")
def edge_union(spark, d):
    """SO1, PF11."""
    return graph.neighbours(_read(spark, d, "orders").select(F.col("o_orderkey").alias("digest")), _edges(spark, d))


@query(f"""WITH {_edges_sql(500)}, i AS (SELECT * FROM e WHERE dst IN (SELECT o_orderkey FROM orders)), t AS (SELECT src AS n FROM i UNION SELECT dst FROM i)
SELECT (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM i) AS edges, (SELECT count(*) FROM e) - (SELECT count(*) FROM i) AS dangling,
round(((SELECT count(*) FROM orders) - (SELECT count(*) FROM t)) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS isolated_pct, round((SELECT count(*) FROM i) * 2.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS mean_degree""")
def coverage_metrics(spark, d):
    """AG18, JN22."""
    out = graph.coverage(_read(spark, d, "orders").select(F.col("o_orderkey").alias("node")), _edges(spark, d, 500))
    return out.select("nodes", "edges", "dangling", F.round("isolated_pct", 6).alias("isolated_pct"), F.round("mean_degree", 6).alias("mean_degree"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 7 * 7 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
k AS (SELECT c_custkey AS node, c_custkey AS seen FROM customer UNION SELECT k.node, u.b FROM k JOIN u ON k.seen = u.a WHERE u.b IN (SELECT c_custkey FROM customer))
SELECT node, min(seen) AS component FROM k GROUP BY node""")
def graph_components(spark, d):
    """AG19: customers tied to the first of each seven."""
    c = _read(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    e = c.select(F.col("node").alias("src"), (F.floor(F.col("node") / 7) * 7).cast("long").alias("dst"), F.lit("supports").alias("edge_kind"))
    return graph.components(c, e)


# ---- conflicts

def _same_text(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))  # the texts stay where they are
    b = docs.select(F.col("doc_id").alias("dst"), F.col("source").alias("s2"), "digest")
    return docs.join(b, "digest").where("doc_id < dst AND source <> s2").select(F.col("doc_id").alias("src"), "dst", F.lit("contradicts").alias("edge_kind"))


SAME = "c AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id AND a.source <> b.source)"


@query(f"WITH {SAME} SELECT a, b FROM c")
def conflict_pairs(spark, d):
    """RT6, JN6, JN20: documents with one text and two sources contradict each other."""
    return conflict.conflicting_pairs(_read(spark, d, "documents").select(F.col("doc_id").alias("record_digest")), _same_text(spark, d))


@query(f"WITH {SAME}, s AS (SELECT a, b FROM c UNION SELECT b, a FROM c) SELECT a AS record_digest, string_agg(b::VARCHAR, ',' ORDER BY b) AS conflicts FROM s GROUP BY a")
def conflicts_of_hits(spark, d):
    """RT6: every contradiction pushed onto a hit."""
    out = conflict.conflicts_of(_read(spark, d, "documents").select(F.col("doc_id").alias("record_digest")), _same_text(spark, d))
    return out.select("record_digest", F.array_join(F.transform("conflicts", lambda x: x.cast("string")), ",").alias("conflicts"))


@query(f"""WITH {SAME}, s AS (SELECT a, b FROM c UNION SELECT b, a FROM c), g AS (SELECT text, min(doc_id) AS class, count(*) AS members FROM documents GROUP BY text)
SELECT a AS doc_id, class, members, count(*) AS conflicts FROM s JOIN documents d ON d.doc_id = s.a JOIN g ON g.text = d.text GROUP BY ALL""")
def conflict_classes(spark, d):
    """RT6, JN20: contradictions as classes with counts: one row a record, however many contradict it."""
    docs = _read(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return conflict.classes(docs, "doc_id", "digest", "source").select(F.col("id").alias("doc_id"), "class", "members", "conflicts")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def texts_containing(spark, d):
    """AG16: the documents that hold a benchmark item's text, by the rarest word of each item."""
    out = contain.containing(_read(spark, d, "documents"), "doc_id", "text", _read(spark, d, "benchmark"), "item_id", "text")
    return out.select(F.col("needle_id").alias("item_id"), F.col("id").alias("doc_id"))


@query(f"""WITH {SAME}, s AS (SELECT a, b FROM c UNION SELECT b, a FROM c)
SELECT s.a AS cited, s.b AS other FROM s JOIN labels l ON l.doc_id = s.a WHERE NOT (least(s.a, s.b) % 2 = 0)""")
def conflict_obligations(spark, d):
    """RT14, RT15, JN21, TK10: labelled documents are cited; pairs whose lower id is even are acknowledged."""
    docs = _read(spark, d, "documents")
    e = _same_text(spark, d)
    m = docs.select(F.col("doc_id").alias("record_digest"), F.col("text").alias("claim"), F.lit(None).cast("string").alias("superseded_at"), F.lit(None).cast("string").alias("retracted_at"))
    owed = conflict.obligations(_read(spark, d, "labels").select(F.col("doc_id").alias("digest")), e, m)
    done = e.where("src % 2 = 0").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit("known").alias("resolution"))
    return conflict.unmet(owed, done).select("cited", "other")


# ---- entities

WORDS = ["the", "and", "reth", "thing", "idiot", "token", "license"]


def _dictionary():
    return entity.Dictionary([(w, w, []) for w in WORDS])


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^0-9a-z]+')) AS t FROM documents)
SELECT doc_id, t AS entity_id, count(*) AS n FROM w WHERE t IN ('the', 'and', 'reth', 'thing', 'idiot', 'token', 'license') GROUP BY ALL""")
def entity_mentions(spark, d):
    """EN1, EN2, EN5, FS5: mentions of a fixed dictionary."""
    m = _read(spark, d, "documents").select(F.col("doc_id").alias("record_digest"), F.col("text").alias("claim"))
    return entity.index_mentions(m, _dictionary()).groupBy(F.col("record_digest").alias("doc_id"), "entity_id").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^0-9a-z]+')) AS t FROM documents),
s AS (SELECT doc_id, count(DISTINCT t) AS shared, string_agg(DISTINCT t, ',' ORDER BY t) AS entities FROM w WHERE t IN ('idiot', 'token', 'license') GROUP BY doc_id)
SELECT doc_id, shared, entities FROM s ORDER BY shared DESC, doc_id LIMIT 50""")
def entity_search(spark, d):
    """RT4, RT10, AG2, AG3, JN3, PF4, TK3: the 50 documents that share the most entities with a question."""
    m = _read(spark, d, "documents").select(F.col("doc_id").alias("record_digest"), F.col("text").alias("claim"), F.lit(None).cast("string").alias("superseded_at"), F.lit(None).cast("string").alias("retracted_at"))
    dic = _dictionary()
    out = entity.entity_search("Which license has an idiot's token?", dic, entity.index_mentions(m, dic), m, 50)
    return out.select(F.col("record_digest").alias("doc_id"), "shared", F.array_join("entities", ",").alias("entities"))


# ---- derivations, gates, writes

@query("""WITH s AS (SELECT l_suppkey, round(avg(l_extendedprice), 6) AS a FROM lineitem GROUP BY l_suppkey), b AS (SELECT round(avg(l_extendedprice), 6) AS b FROM lineitem)
SELECT l_suppkey, round(a / b, 6) AS ratio, round(a - b, 6) AS delta, round((a - b) / b * 100, 4) AS percent FROM s, b""")
def derivations(spark, d):
    """FM9, UF2: each supplier's mean price against that of all."""
    li = _read(spark, d, "lineitem")
    s = li.groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("a")).join(F.broadcast(li.agg(F.round(F.avg("l_extendedprice"), 6).alias("b"))))
    made = lambda name, n: F.round(scalar.derive(name, F.col("a"), F.col("b"))["value"], n)
    return s.select("l_suppkey", made("ratio", 6).alias("ratio"), made("delta", 6).alias("delta"), made("percentChange", 4).alias("percent"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'division-by-zero' ELSE 'ok' END AS outcome FROM part""")
def derivation_problems(spark, d):
    """FM9: a denominator of zero is a named problem, not an error."""
    p = _read(spark, d, "part")
    got = scalar.derive("ratio", F.col("p_retailprice"), (F.col("p_size") % 5).cast("double"))
    return p.select("p_partkey", F.coalesce(got["problem"], F.lit("ok")).alias("outcome"))


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND l.doc_id IS NULL THEN 'unknown-artifact' WHEN d.doc_id % 3 = 1 AND coalesce(l.quality, 0) <> 1 THEN 'derivation-not-verified' END AS refusal
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def evidence_gate(spark, d):
    """WR4: labels stand for artifacts, good labels for verified derivations."""
    docs, lab = _read(spark, d, "documents"), _read(spark, d, "labels")
    kind = F.when(F.col("doc_id") % 3 == 0, "observed").when(F.col("doc_id") % 3 == 1, "derived").otherwise("external")
    new = docs.select(F.col("doc_id").alias("record_digest"), kind.alias("evidence_class"), F.col("doc_id").alias("source_artifact_sha256"))
    out = write.evidence_gate(new, lab.select(F.col("doc_id").alias("sha256_hex")), lab.select(F.col("doc_id").alias("record_digest"), (F.col("quality") == 1).alias("verified")))
    return out.select(F.col("record_digest").alias("doc_id"), "refusal")


@query("""WITH h AS (SELECT sha256(text) AS digest, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents)
SELECT digest, doc_id, CASE WHEN n = 1 THEN 'inserted' ELSE 'already-present' END AS outcome FROM h""")
def idempotent_write(spark, d):
    """FA6, WR1: texts keyed by digest into an empty store, the first one is inserted."""
    new = _read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id")
    return keyed.insert_absent(new.limit(0), new, ["digest"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'agentInference' WHEN o_orderstatus = 'F' THEN 'observed' ELSE 'external' END AS evidence_class,
sha256('{"domain":"lodestone.memory-record.v1","claim":"' || o_orderpriority || '","evidenceClass":"' || CASE WHEN o_orderstatus = 'O' THEN 'agentInference' WHEN o_orderstatus = 'F' THEN 'observed' ELSE 'external' END || '","sourceArtifactSha256":null,"sourceLocator":"order ' || o_orderkey || '","observationIdentities":[],"harnessRunId":null}') AS record_digest FROM orders""")
def sealed_claims(spark, d):
    """WR3, FA1, FA3, FA6: open orders come from the agent channel, which is clamped before sealing."""
    o = _read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("claim"), F.when(F.col("o_orderstatus") == "F", "observed").otherwise("external").alias("evidence_class"), F.when(F.col("o_orderstatus") == "O", "agent").otherwise("operator").alias("channel"), F.lit(None).cast("string").alias("source_artifact_sha256"), F.concat(F.lit("order "), "o_orderkey").alias("source_locator"), F.array().cast("array<string>").alias("observation_identities"), F.lit(None).cast("string").alias("harness_run_id"))
    return write.claims(o).select("o_orderkey", "evidence_class", "record_digest")


@query("""SELECT event_id, concat_ws(',', CASE WHEN q = 'other' THEN 'unknown-quantity' END, CASE WHEN q = 'relative' AND event_id % 3 <> 0 THEN 'relative-without-reference' END,
CASE WHEN q = 'absolute' AND event_id % 3 = 0 THEN 'absolute-with-reference' END) AS defects
FROM (SELECT *, CASE event_type WHEN 'view' THEN 'relative' WHEN 'click' THEN 'absolute' ELSE 'other' END AS q FROM events)""")
def observation_defects(spark, d):
    """WR2, PF15: defect codes; an event's type stands for its quantity kind."""
    e = _read(spark, d, "events")
    q = F.when(F.col("event_type") == "view", "relative").when(F.col("event_type") == "click", "absolute").otherwise("other")
    o = e.select("event_id", q.alias("quantity_kind"), F.col("event_type").alias("observation_kind"), F.lit("1.5").alias("value_text"), F.when(F.col("event_id") % 3 == 0, "r").alias("reference_identity"))
    return o.select("event_id", F.array_join(write.observation_defects(), ",").alias("defects"))


@query("SELECT o_orderkey AS src, 'no-loop' AS broken FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'kind' FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'kind' FROM orders WHERE o_orderkey % 13 = 0 AND o_orderkey % 11 = 0")
def constraint_violations(spark, d):
    """PF15: loops and unknown kinds among planted edges."""
    o = _read(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 1).alias("dst"), F.when(F.col("o_orderkey") % 13 == 0, "likes").otherwise("supports").alias("edge_kind"))
    return violations(o, "provenance_edges").select("src", F.explode("broken").alias("broken"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def dangling_references(spark, d):
    """PF17: lines whose part isn't among the larger ones."""
    li = _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return dangling(li, "l_partkey", _read(spark, d, "part").where("p_size > 10"), "p_partkey")


@query(f"""WITH {_edges_sql()}, o AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity)::INTEGER AS q FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, string_agg(concat_ws('|', l_orderkey * 10 + l_linenumber, q, p_brand, s_name, coalesce(n_name, '-')), ',' ORDER BY l_linenumber) AS observations
  FROM o JOIN part ON p_partkey = pk JOIN supplier ON s_suppkey = sk LEFT JOIN nation ON n_nationkey = CASE WHEN l_linenumber % 2 = 0 THEN sk % 25 END GROUP BY l_orderkey),
g AS (SELECT k, count(*) AS n FROM (SELECT src AS k FROM e UNION ALL SELECT dst FROM e) GROUP BY k)
SELECT o_orderkey AS record_digest, o_orderpriority AS claim, coalesce(observations, '') AS observations, coalesce(n, 0) AS edges
FROM orders LEFT JOIN b ON l_orderkey = o_orderkey LEFT JOIN g ON k = o_orderkey""")
def record_detail(spark, d):
    """RT13, JN4: lines stand for observations, parts for policies, suppliers for suites, nations for references."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation_identity")
    # dealt by identity, so that the bridge and the observations meet where they are
    lines = _read(spark, d, "lineitem").select("*", key)
    n = spread(spark, lines.count())
    li = parted(lines, n, "observation_identity").groupBy("observation_identity", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("int").cast("string").alias("value_text"))
    record = F.expr("(observation_identity - l_linenumber) div 10").alias("record_digest")
    observations = li.select(F.col("observation_identity").alias("identity"), "value_text", F.col("pk").alias("policy_identity"), F.col("sk").alias("suite_identity"), F.when(F.col("l_linenumber") % 2 == 0, F.col("sk") % 25).cast("int").alias("reference_identity"))
    policies = _read(spark, d, "part").select(F.col("p_partkey").alias("identity"), F.col("p_brand").alias("metric"), F.col("p_type").alias("unit"))
    suites = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("identity"), F.col("s_name").alias("suite_name"))
    references = _read(spark, d, "nation").select(F.col("n_nationkey").alias("identity"), F.col("n_name").alias("runtime_identity"))
    m = _read(spark, d, "orders").select(F.col("o_orderkey").alias("record_digest"), F.col("o_orderpriority").alias("claim"))
    out = write.record_detail(m, _edges(spark, d), li.select(record, "observation_identity"), observations, policies, suites, references, m.select(F.col("record_digest").alias("digest")), n)
    line = F.transform("observations", lambda o: F.concat_ws("|", o["observation_identity"].cast("string"), o["value_text"], o["metric"], o["suite_name"], F.coalesce(o["reference_runtime"], F.lit("-"))))
    return out.select("record_digest", "claim", F.coalesce(F.array_join(line, ","), F.lit("")).alias("observations"), F.coalesce(F.array_size("edges"), F.lit(0)).cast("long").alias("edges"))


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 89 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 97 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS key, CASE WHEN b.doc_id IS NULL THEN 'Missing' WHEN a.doc_id IS NULL THEN 'Extra' ELSE 'Diverged' END AS status
FROM documents a FULL OUTER JOIN b ON a.doc_id = b.doc_id WHERE a.text IS DISTINCT FROM b.text""")
def verify_replica(spark, d):
    """WR13, JN17, SO4: a copy with rows dropped and texts changed."""
    a = _read(spark, d, "documents").select("doc_id", "text")
    b = a.where("doc_id % 97 <> 0").withColumn("text", F.when(F.col("doc_id") % 89 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return keyed.difference(a, b, "doc_id", ["text"])


COUNTED = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in COUNTED))
def store_stats(spark, d):
    """AG8."""
    return table_counts({t: _read(spark, d, t) for t in COUNTED})


@query(f"""WITH {RECORDS} SELECT m.record_digest, n.recorded_seq AS superseded_seq FROM m LEFT JOIN m n ON m.superseded_seq = n.record_digest""")
def backfilled_sequences(spark, d):
    """JN18."""
    m = _records(spark, d).select("record_digest", "recorded_seq", F.col("superseded_seq").alias("superseded_by"), F.lit(None).cast("long").alias("superseded_seq"))
    return write.backfilled(m).select("record_digest", "superseded_seq")


# ---- context

def _turns(spark, d):
    c = _read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session"), "turn", F.explode(F.array_distinct(scalar.words_of(F.col("text")))).alias("record")).withColumn("cost", F.length("record").cast("long"))


TURNS = r"t AS (SELECT DISTINCT conv_id AS session, turn, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS record FROM conversations)"


@query(f"""WITH {TURNS}, e AS (SELECT session, turn, sum(length(record)) AS tokens FROM t GROUP BY ALL)
SELECT session, count(*) AS turns, sum(tokens)::BIGINT AS prefill, 0::BIGINT AS invalidations, max(tokens)::BIGINT AS peak FROM e GROUP BY session""")
def context_rebuild_cost(spark, d):
    """CX3, AG15: each turn of a conversation built anew; a distinct word is a record."""
    return context.rebuild_cost(_turns(spark, d))


@query(f"""WITH {TURNS}, n AS (SELECT session, count(DISTINCT turn) AS turns FROM t GROUP BY session), f AS (SELECT DISTINCT session, record FROM t)
SELECT n.session, n.turns, sum(length(record))::BIGINT AS prefill, 0::BIGINT AS invalidations, sum(length(record))::BIGINT AS peak FROM n JOIN f USING (session) GROUP BY ALL""")
def context_append_cost(spark, d):
    """CX1, WN3, WN6: append-only without a budget."""
    return context.append_cost(_turns(spark, d))


@query()
def context_eviction(spark, d):
    """CX2, ST9: the ordered fold with a budget."""
    return context.append_cost_with_budget(_turns(spark, d), 600)


@query(f"""WITH {TURNS} SELECT session, record FROM t WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM t p WHERE p.session = t.session AND p.record = t.record AND p.turn = 0) GROUP BY ALL""")
def context_append_set(spark, d):
    """SO5: what later turns add to the first one's prefix."""
    t = _turns(spark, d)
    return context.append_sets(t.where("turn > 0").select("session", "record"), t.where("turn = 0").select("session", "record"))[0]


# ---- personal store and change log

def _personal(spark, d, **tables):
    """Documents as a personal store's records; those with a label were captured here, toxic ones are forgotten."""
    docs, labels = _read(spark, d, "documents"), _read(spark, d, "labels")
    toxic = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic"))
    records = docs.join(toxic, "doc_id", "left").select(F.col("doc_id").cast("string").alias("content_digest"), F.col("text").alias("content"), F.lit(None).cast("string").alias("occurred_at"), F.lit("{}").alias("metadata"), F.lit("2024-01-01T00:00:00.000Z").alias("created_at"), F.coalesce("toxic", F.lit(False)).alias("tombstoned"))
    captures = labels.select(F.lit("here").alias("origin_device"), F.col("doc_id").cast("string").alias("origin_id"), F.col("doc_id").cast("string").alias("record_digest"))
    return personal.PersonalState.new(spark).having(**{"canonical_records": records, "captures": captures, **tables})


def _log(spark, d):
    e = _read(spark, d, "events")
    w = Window.partitionBy("epoch").orderBy("ts", "event_id")
    return e.withColumn("epoch", F.floor(F.col("event_id") / 1000).cast("long")).withColumn("sequence", F.row_number().over(w).cast("long"))


LOG = "g AS (SELECT *, event_id // 1000 AS epoch, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY ts, event_id) AS sequence FROM events)"


@query(f"WITH {LOG}, a AS (SELECT * FROM g WHERE epoch > 3 OR (epoch = 3 AND sequence > 400)) SELECT epoch, sequence, event_id FROM a WHERE epoch = (SELECT min(epoch) FROM a)")
def change_export(spark, d):
    """ST4, PF9, WN2: the changes after (3, 400), to the end of their epoch."""
    return personal.export_changes(_log(spark, d), 3, 400).select("epoch", "sequence", "event_id")


@query(f"""WITH {LOG}, h AS (SELECT * FROM g WHERE sequence % 50 <> 0), l AS (SELECT *, lag(sequence) OVER (PARTITION BY epoch ORDER BY sequence) AS before FROM h)
SELECT epoch, sequence FROM l WHERE sequence <> coalesce(before, 0) + 1""")
def change_gaps(spark, d):
    """ST7, WN4: changes whose predecessor is missing after every fiftieth was taken out."""
    return personal.missing_predecessors(_log(spark, d).where("sequence % 50 <> 0"), 0, 0).select("epoch", "sequence")


@query("""SELECT user_id || '|' || props AS content_digest, strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS created_at, bool_or(event_type = 'error') AS tombstoned, count(*) AS sightings FROM events GROUP BY user_id, props""")
def merge_records(spark, d):
    """ST8, AG12, AG13, JN14: an error is a tombstone, which stays."""
    digest = F.concat_ws("|", F.col("user_id").cast("string"), "props")
    e = _read(spark, d, "events").select(digest.alias("content_digest"), F.col("props").alias("content"), F.lit(None).cast("string").alias("occurred_at"), F.col("props").alias("metadata"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), (F.col("event_type") == "error").alias("tombstoned"))
    seen = personal.sighting_counts(e.select(F.col("content_digest").alias("record_digest")))
    return personal.merged(e).join(seen, "content_digest").select("content_digest", "created_at", "tombstoned", "sightings")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def replica_only(spark, d):
    """JN12: all documents came from replicas, those with a label were captured here as well."""
    state = _personal(spark, d, replica_records=_read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_digest")))
    return personal.replica_only(state).select(F.col("record_digest").cast("long").alias("doc_id"))


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN labels l USING (doc_id)")
def local_captures(spark, d):
    """JN13, JN9: a semi-join instead of a join and a distinct."""
    return personal.local_records(_personal(spark, d)).select(F.col("content_digest").cast("long").alias("doc_id"))


@query("""SELECT conv_id || ':' || turn AS content_digest, lpad(turn::VARCHAR, 6, '0') AS created_at, role AS tags, 1 AS sightings FROM conversations
WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AND role = 'user' ORDER BY created_at DESC, content_digest LIMIT 100""")
def local_context(spark, d):
    """RT17, RT19, PF7, PF8, FS9, TK7: the 100 latest records with a match that folds ASCII case only, under a tag."""
    c = _read(spark, d, "conversations").withColumn("content_digest", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    records = c.select("content_digest", F.col("text").alias("content"), F.lit(None).cast("string").alias("occurred_at"), F.lit("{}").alias("metadata"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"), F.lit(False).alias("tombstoned"))
    state = personal.PersonalState.new(spark).having(canonical_records=records, record_tags=c.select(F.col("content_digest").alias("record_digest"), F.col("role").alias("tag")), sightings=c.select(F.col("content_digest").alias("record_digest")))
    out = personal.recall(state, 100, "ThE", "user")
    return out.select("content_digest", "created_at", F.array_join("tags", ",").alias("tags"), F.col("sightings").cast("int").alias("sightings"))


@query("""WITH a AS (SELECT least(user_id, event_id % 50) AS x, greatest(user_id, event_id % 50) AS y, event_type = 'purchase' AS k, event_id FROM events WHERE user_id <> event_id % 50)
SELECT x, y, CASE WHEN bool_or(k) THEN 'acknowledged' ELSE 'flagged' END AS status, min(CASE WHEN k THEN event_id END) AS acknowledged_at FROM a GROUP BY x, y""")
def divergence_merge(spark, d):
    """ST10: unordered pairs, acknowledgements win."""
    other = F.col("event_id") % 50
    e = _read(spark, d, "events").where(F.col("user_id") != other)
    acked = F.col("event_type") == "purchase"
    rows = e.select(F.least("user_id", other).alias("digest_a"), F.greatest("user_id", other).alias("digest_b"), F.when(acked, "acknowledged").otherwise("flagged").alias("status"), F.when(acked, F.col("event_id")).alias("acknowledged_at")).withColumn("id", F.concat_ws("-", "digest_a", "digest_b"))
    out = personal.merge_divergences(rows, rows.limit(0))
    return out.select(F.col("digest_a").alias("x"), F.col("digest_b").alias("y"), "status", "acknowledged_at")


@query("""SELECT 2::BIGINT AS epoch, (row_number() OVER (ORDER BY doc_id::VARCHAR))::BIGINT AS sequence, CASE WHEN toxic = 1 THEN 'tombstone' ELSE 'upsert' END AS operation, doc_id FROM documents JOIN labels USING (doc_id)""")
def epoch_snapshot(spark, d):
    """ST12, WN2: a new epoch holds all local records, numbered in order of digest by ranges rather than in one task."""
    state = personal.bump_epoch(_personal(spark, d))
    return state["promotion_changes"].select("epoch", "sequence", "operation", F.col("record_digest").cast("long").alias("doc_id"))


@query("""WITH s AS (SELECT count(*) AS active, count(v.vec_id) AS ready, count(*) FILTER (v.vec_id IS NULL AND l.toxic = 1) AS failed, count(*) FILTER (v.vec_id IS NULL AND l.toxic IS DISTINCT FROM 1) AS pending
FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic IS DISTINCT FROM 1)
SELECT *, (SELECT count(*) FROM embeddings) AS queued, 0::BIGINT AS divergences, 0::BIGINT AS open_divergences, (SELECT count(*) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) AS tombstoned,
CASE WHEN failed > 0 THEN 'degraded' WHEN pending > 0 THEN 'catching-up' ELSE 'healthy' END AS health FROM s""")
def semantic_status(spark, d):
    """RT18, AG14: ready before failed before pending; toxic documents are forgotten, their failures don't count."""
    e = _read(spark, d, "embeddings").select(F.lit("p").alias("profile_identity"), F.col("vec_id").cast("string").alias("record_digest"))
    failed = _read(spark, d, "labels").where("toxic = 1").select(F.lit("p").alias("profile_identity"), F.col("doc_id").cast("string").alias("record_digest"))
    return personal.status(_personal(spark, d, personal_embeddings=e, personal_embedding_failures=failed, personal_embedding_queue=e), "p")


@query("SELECT l_suppkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS middle FROM lineitem GROUP BY l_suppkey")
def upper_median(spark, d):
    """AG17: the upper middle of a sorted list."""
    return evaluate.upper_medians(_read(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query("SELECT event_id, event_id // 1000 AS epoch, event_id % 1000 AS sequence FROM events")
def cursor_text(spark, d):
    """FS14: cursors written as text and read again."""
    e = _read(spark, d, "events").select("event_id", scalar.parse_cursor(F.concat_ws(":", F.floor(F.col("event_id") / 1000).cast("string"), (F.col("event_id") % 1000).cast("string"))).alias("c"))
    return e.select("event_id", "c.epoch", "c.sequence")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR || '.5' END AS stated FROM part")
def stated_values(spark, d):
    """FS10: the last decimal of a claim, where it has one."""
    claim = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("it grew from 3.25 to "), F.col("p_size").cast("string"), F.lit(".5% now."))).otherwise("no figure at all")
    return _read(spark, d, "part").select("p_partkey", F.regexp_replace(scalar.last_decimal(F.regexp_replace(claim, r" now\.$", "")), r"\.$", "").alias("stated"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS canonical FROM orders")
def canonical_instants(spark, d):
    """FD3: of four spellings of a time one is canonical."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(day, F.lit("T10:00:00.000Z"))).when(k == 1, F.concat(day, F.lit("T10:00:00Z"))).when(k == 2, F.lit("2023-02-30T10:00:00.000Z")).otherwise(F.concat(day, F.lit("T24:00:00.000Z")))
    return _read(spark, d, "orders").select("o_orderkey", scalar.canonical_instant(text).alias("canonical"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_recall(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | store_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | store_queries.ORACLES
