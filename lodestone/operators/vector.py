"""Brute-force search inside one embedding space; spaces are never compared with each other."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scalar import all_finite, live
from lodestone.operators.keyed import replace_by_key
from lodestone.operators.lexical import kept_rows
from lodestone.schemas import ConstraintError


def to_blob(v: list[float]) -> bytes:
    return struct.pack(f"<{len(v)}f", *v)


def from_blob(b: bytes, dimensions: int) -> list[float]:
    if len(b) != 4 * dimensions:
        raise ValueError("a vector of another length")
    return list(struct.unpack(f"<{dimensions}f", b))


def vector_search(embeddings: DataFrame, memories: DataFrame, profile: str, query: list[float], limit: int, include_retired: bool = False) -> DataFrame:
    """record_digest, cosine of the nearest records of one space, best first, ties by digest."""
    if not query or any(x != x or abs(x) == float("inf") for x in query):
        raise ValueError("the query vector must be finite and not empty")
    m = memories if include_retired else memories.where(live(F.col("superseded_at"), F.col("retracted_at")))
    e = embeddings.where(F.col("profile_identity") == profile)
    wrong = e.where(F.size("vector") != len(query)).limit(1)
    if not wrong.isEmpty():
        raise ConstraintError("the query has another dimension than the space")
    kind = e.schema["record_digest"].dataType.simpleString()
    near = e.join(m.select("record_digest"), "record_digest", "left_semi").select("record_digest", "vector")
    near = near.mapInArrow(_nearest(np.array([query], np.float64), limit), f"record_digest {kind}, cosine double")
    return near.orderBy(F.desc("cosine"), "record_digest").limit(limit)


def _rows(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows of doubles; a zero vector stays zero."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _kept(score: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Places of the k best scores, ties by id."""
    on = np.arange(len(score))
    if len(score) > k:
        on = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    rank = np.asarray(ids.take(pa.array(on)).rank("ascending")) if hasattr(ids, "rank") else np.argsort(np.argsort(ids.take(pa.array(on)).to_numpy(zero_copy_only=False)))
    return on[np.lexsort((rank, -score[on]))][:k]


def _nearest(query: np.ndarray, k: int):
    unit = query / max(float(np.sqrt((query * query).sum())), 1e-300)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = (_rows(b.column(1)) @ unit.T).ravel()
                on = _kept(s, b.column(0), k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(on)), pa.array(s[on])], names=["record_digest", "cosine"])

    return nearest


def _blocks(rows: int):
    """Rows of (space, id, vector) as blocks of one space and length: space, dimensions, block, ids and unit rows as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: dict[tuple, list] = {}

        def emit(key, got) -> pa.RecordBatch:
            nonlocal k
            ids = pa.concat_arrays([g[0] for g in got])
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([key[0]], spaces), pa.array([key[1]], pa.int32()), pa.array([(part << 24) + k]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([np.concatenate([g[1] for g in got]).tobytes()], pa.binary())], names=["space", "dims", "block", "ids", "unit"])

        for b in batches:
            spaces = b.schema.field("space").type
            dims = np.diff(b.column(2).offsets.to_numpy())
            keys = list(zip(b.column(0).to_pylist(), dims.tolist(), strict=True))
            for key in sorted(set(keys), key=str):
                at = pa.array([i for i, x in enumerate(keys) if x == key])
                held.setdefault(key, []).append((b.column(1).take(at), _rows(b.column(2).take(at))))
                if sum(len(g[0]) for g in held[key]) >= rows:
                    yield emit(key, held.pop(key))
        for key, got in held.items():
            yield emit(key, got)

    return pack


def _meet(k: int, digits: int | None):
    """The k best partners of a block's rows among another block's, by one matrix product."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                q_ids, ids = batch.column("q_ids")[j].values, batch.column("ids")[j].values
                dims = max(1, batch.column("dims")[j].as_py())
                q, x = (np.frombuffer(batch.column(c)[j].as_buffer(), np.float64).reshape(-1, dims) for c in ("q_unit", "unit"))
                score = q @ x.T
                if digits is not None:
                    score = np.round(score, digits)
                same = batch.column("q_block")[j].as_py() == batch.column("block")[j].as_py()
                if same:
                    np.fill_diagonal(score, -np.inf)
                row, on = kept_rows(score, ids, k)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row)), ids.take(pa.array(on)), pa.array(score[row, on])], names=["query_id", "id", "cosine"])

    return meet


def neighbours(embeddings: DataFrame, id_col: str, space_col: str, vec_col: str, k: int, digits: int | None = None, block_rows: int = 4096) -> DataFrame:
    """query_id, id, cosine, rank: the k nearest of every vector in its own space, all pairs of it in blocks.

    Rows are packed where they are; blocks of a space meet, so a space that holds most rows is many
    tasks, not one. Null vectors and vectors with nulls take no part.
    """
    spark = embeddings.sparkSession
    e = embeddings.select(F.col(space_col).alias("space"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vector")).where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    kind = {n: e.schema[n].dataType.simpleString() for n in ("space", "id")}
    blocks = e.mapInArrow(_blocks(block_rows), f"space {kind['space']}, dims int, block long, ids array<{kind['id']}>, unit binary")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    q = blocks.select("space", "dims", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit"))
    # each pair of blocks of a space has a place of its own: a block is dealt to all stripes of one side
    side = max(1, int(parts**0.5))
    left = q.withColumn("i", F.pmod(F.xxhash64("q_block"), F.lit(side))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))))
    right = blocks.withColumn("j", F.pmod(F.xxhash64("block"), F.lit(side))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))))
    met = left.join(right.hint("merge"), ["space", "dims", "i", "j"])
    best = met.select("dims", "q_block", "q_ids", "q_unit", "block", "ids", "unit").mapInArrow(_meet(k, digits), f"query_id {kind['id']}, id {kind['id']}, cosine double")
    return top_k_by_query(best, "query_id", "cosine", "id", k)


def top_k_by_query(scored: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """Rank within each query by score, ties by key."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def put_embeddings(store: DataFrame, new: DataFrame, dimensions: dict[str, int]) -> DataFrame:
    """The store with ``new`` in place of the same (space, record); sizes and finiteness are checked."""
    sizes = F.create_map(*(F.lit(x) for kv in dimensions.items() for x in kv)) if dimensions else F.create_map().cast("map<string,int>")
    bad = new.where(~F.coalesce(F.size("vector") == F.try_element_at(sizes, F.col("profile_identity")), F.lit(False)) | ~all_finite(F.col("vector")))
    if not bad.isEmpty():
        raise ConstraintError("an embedding has the wrong length, an unknown space or a value that is not finite")
    return replace_by_key(store, new, ["profile_identity", "record_digest"])


def coverage(memories: DataFrame, embeddings: DataFrame, profile: str) -> DataFrame:
    """embedded, total over records that aren't superseded: one row, and never above the whole."""
    have = embeddings.where(F.col("profile_identity") == profile).select("record_digest").distinct().withColumn("has", F.lit(1))
    return memories.where("superseded_at IS NULL").join(have, "record_digest", "left").agg(F.count("has").alias("embedded"), F.count("*").alias("total"))


def missing(memories: DataFrame, embeddings: DataFrame, profile: str) -> DataFrame:
    """Records without a vector in this space: the backfill's work list."""
    return memories.join(embeddings.where(F.col("profile_identity") == profile).select("record_digest"), "record_digest", "left_anti")


def backfill(memories: DataFrame, embeddings: DataFrame, profile: str, embed: Column, at: str) -> DataFrame:
    """New embedding rows for the work list; ``embed`` is an expression over ``claim`` such as an Arrow UDF."""
    todo = missing(memories, embeddings, profile)
    return todo.select(F.lit(profile).alias("profile_identity"), "record_digest", embed.alias("vector"), F.concat(F.lit("search_document: "), "claim").alias("embedded_text"), F.lit(at).alias("embedded_at"))


def shares_index(a: Column, b: Column) -> Column:
    """Two spaces share an index only if they are the same space."""
    return a == b
