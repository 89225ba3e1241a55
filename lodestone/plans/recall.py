"""Hybrid recall: lexical, semantic, entity and provenance branches, blended, ranked and explained."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.functions.text import index_tokens_udf, query_phrases
from lodestone.operators import lexical
from lodestone.operators.conflict import conflicting_pairs, conflicts_of
from lodestone.operators.entity import Dictionary, entity_search
from lodestone.operators.graph import walk
from lodestone.operators.stored import stored
from lodestone.operators.vector import vector_search

BRANCHES = ["lexical", "semantic", "entity", "provenance"]
#: A branch fetches this many times the limit before retired rows are set aside.
OVERFETCH = 4


@dataclass
class RecallOptions:
    query: str
    limit: int = 20
    as_of: str | None = None
    hops: int = 1
    include_retired: bool = False
    profile: str | None = None
    query_vector: list[float] | None = None
    use_entities: bool = True
    use_lexical: bool = True
    use_semantic: bool = True

    def __post_init__(self):
        self.limit = max(1, min(100, self.limit))
        self.hops = max(0, min(4, self.hops))


@dataclass
class RecallResult:
    hits: DataFrame
    withheld: DataFrame
    conflicting_pairs: DataFrame
    counts: DataFrame
    degraded: list[str] = field(default_factory=list)


class TextForms(NamedTuple):
    """How texts, and how queries, are cut into terms."""

    tokens: Callable[[Column], Column]
    phrases: Callable[[str], list[list[str]]]


#: Folded and stemmed terms.
STEMMED = TextForms(index_tokens_udf, query_phrases)


@dataclass
class Index:
    """The derived text index of a memories table: build once, save, reuse; a store keeps it in parts."""

    postings: DataFrame
    lengths: DataFrame
    phrases: Callable[[str], list[list[str]]] = query_phrases

    @classmethod
    def build(cls, memories: DataFrame, tokens: Callable[[Column], Column] = index_tokens_udf, phrases: Callable[[str], list[list[str]]] = query_phrases) -> Index:
        """``tokens`` cuts a text into terms and ``phrases`` a query: folded and stemmed ones unless others are given."""
        return cls(*lexical.postings(memories, "record_digest", _fields(tokens)), phrases)

    @classmethod
    def of_query(cls, memories: DataFrame, query: str, tokens: Callable[[Column], Column] = index_tokens_udf, phrases: Callable[[str], list[list[str]]] = query_phrases) -> Index:
        """What one query reads of the index, stored after a single pass over the texts: its terms' postings and all lengths."""
        terms = [t for p in phrases(query) for t in p]
        return cls(*lexical.postings_of(memories, "record_digest", _fields(tokens), terms), phrases)


def _fields(tokens: Callable[[Column], Column]) -> list[tuple[Column, float]]:
    """The fields of a record that are indexed, with their weights."""
    return list(zip((tokens(F.col("claim")), tokens(F.coalesce("source_locator", F.lit("")))), lexical.FIELD_WEIGHTS, strict=True))


def lexical_branch(index: Index, query: str) -> DataFrame | None:
    """record_digest, score; None for a query without terms. A term with underscores matches as a phrase."""
    phrases = index.phrases(query)
    if not phrases:
        return None
    spark = index.postings.sparkSession
    postings = index.postings
    terms = ["\u0000".join(p) for p in phrases]
    adjacent = [(t, p) for t, p in dict(zip(terms, phrases, strict=True)).items() if len(p) > 1]
    if adjacent:
        postings = postings.unionByName(lexical.phrase_postings(postings, spark.createDataFrame(adjacent, "phrase string, terms array<string>")))
    wanted = spark.createDataFrame([(0, t) for t in terms], "query_id int, term string")
    return lexical.bm25(postings, index.lengths, wanted).select(F.col("id").alias("record_digest"), "score")


def _blank(rows: DataFrame, branch: str, **values: Column) -> DataFrame:
    kinds = {"lexical": "double", "semantic": "double", "shared": "long", "hops": "int"}
    return rows.select("record_digest", F.lit(branch).alias("branch"), *(values.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))


def recall(memories: DataFrame, edges: DataFrame, options: RecallOptions, index: Index | None = None, embeddings: DataFrame | None = None, mentions: DataFrame | None = None, dictionary: Dictionary | None = None) -> RecallResult:
    """Branches -> merge by digest -> score -> conflicts and counts -> rank -> truncate.

    Retired matches are reported as withheld unless asked for; counts and conflicting pairs are taken before the cut.
    """
    o, degraded = options, []
    if index is None and o.use_lexical:
        index = Index.of_query(memories, o.query)
    fetch = o.limit * OVERFETCH
    state = memories.select("record_digest", "claim", "occurred_at", scalar.live(F.col("superseded_at"), F.col("retracted_at")).alias("live"), F.col("superseded_at").isNull().alias("unsuperseded"))
    branches, withheld = [], []
    text = lexical_branch(index, o.query) if o.use_lexical else None
    if text is not None:
        top = text.orderBy(F.desc("score"), "record_digest").limit(fetch).join(state.select("record_digest", "live"), "record_digest")
        keep = F.lit(True) if o.include_retired else F.col("live")
        branches.append(_blank(top.where(keep), "lexical", lexical=F.col("score")))
        withheld.append(top.where(~keep).select("record_digest"))
    if o.use_semantic and o.profile and o.query_vector and embeddings is not None:
        near = vector_search(embeddings, memories, o.profile, o.query_vector, fetch, o.include_retired)
        branches.append(_blank(near, "semantic", semantic=F.col("cosine")))
    elif o.use_semantic and o.profile:
        degraded.append("semantic: no query vector")
    if o.use_entities and dictionary is not None and mentions is not None and dictionary.mentions(o.query):
        hits = entity_search(o.query, dictionary, mentions, memories, fetch, o.include_retired)
        branches.append(_blank(hits, "entity", shared=F.col("shared")))
    spark = memories.sparkSession
    if not branches:
        seeds = spark.createDataFrame([], "record_digest string, branch string, lexical double, semantic double, shared long, hops int")
    else:
        seeds = stored(reduce(DataFrame.unionByName, branches))
    if o.hops and branches:
        reached = walk(seeds.select(F.col("record_digest").alias("seed")).distinct(), edges, o.hops, "both").where("depth > 0")
        reached = reached.groupBy(F.col("node").alias("record_digest")).agg(F.min("depth").alias("depth")).join(state.select("record_digest", "unsuperseded"), "record_digest")
        keep = F.lit(True) if o.include_retired else F.col("unsuperseded")
        seeds = seeds.unionByName(_blank(reached.where(keep), "provenance", hops=F.col("depth")))
        withheld.append(reached.where(~keep).select("record_digest"))
    merged = seeds.groupBy("record_digest").agg(F.max("lexical").alias("lexical"), F.max("semantic").alias("semantic"), F.max("shared").alias("shared"), F.min("hops").alias("hops"), F.array_sort(F.collect_set("branch")).alias("branches"))
    best = merged.agg(F.max("lexical").alias("best"))
    age = scalar.age_days(F.lit(o.as_of), F.col("occurred_at"))
    # the fetched rows and their neighbours: read by the counts, the pairs and the ranking
    scored = stored(merged.join(state, "record_digest").join(F.broadcast(best)).select(
        "record_digest", "claim", "branches", "hops", (~F.col("unsuperseded")).alias("superseded"),
        scalar.blended(F.when(F.col("lexical").isNotNull(), scalar.lexical_share(F.col("lexical"), F.col("best"))), F.when(F.col("semantic").isNotNull(), scalar.clamp01(F.col("semantic"))), F.when(F.col("shared").isNotNull(), scalar.saturation(F.col("shared"))), F.when(F.col("hops").isNotNull(), scalar.graph_decay(F.col("hops"))), scalar.recency(age)).alias("score"),
    ))
    counts = scored.agg(*(F.count(F.when(F.array_contains("branches", b), 1)).alias(b) for b in BRANCHES), F.count("*").alias("unique"))
    pairs = conflicting_pairs(scored, edges)
    ranked = scored.orderBy(F.desc("score"), "record_digest").limit(o.limit)
    hits = ranked.join(conflicts_of(ranked, edges), "record_digest", "left").withColumn("conflicts", F.coalesce("conflicts", F.array().cast("array<string>"))).orderBy(F.desc("score"), "record_digest")
    gone = reduce(DataFrame.union, withheld).distinct().orderBy("record_digest") if withheld else spark.createDataFrame([], "record_digest string")
    return RecallResult(hits, gone, pairs, counts, degraded)
