"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are packed into blocks of postings (term -> rows, weights), query rows into blocks of
sparse rows. Each query block meets each candidate block once; for each query the terms are taken
one at a time and their weighted postings are scattered into a dense score array, from which a
partition selection keeps k. The partial answers merge in a bounded window.

Defined cases: a vector that is null or holds a null or non-finite component takes no part; an
empty vector scores 0 with every other; vectors of unequal or any length are compared as sparse rows
(missing terms are 0); a row whose id equals the query's id is the query's own; rows that repeat
an id are separate candidates and separate queries; ids that are null take no part; ties go to the
smaller id; an empty table gives no rows. Components of any finite size are taken whole and ranks
follow the exact scores; a score beyond a long is written as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.worker import tidy

BLOCK = "stripe int, uid long, ids binary, ptr binary, pos binary, w binary"
LONG = 2**63 - 1


def _integer(x: float, scale: float) -> int:
    """floor(scale * x); where the product leaves the doubles, x is an integer itself."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else int(x) * int(scale)


def _matrix(batch: pa.RecordBatch, scale: float):
    """ids, and the non-zero entries as (row, term, weight): 32-bit integers, or the components themselves where one is larger."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column(1)
    at = lists.offsets.to_numpy().astype(np.int64)
    x = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(at)
    with np.errstate(over="ignore"):
        w = np.floor(scale * x)
    row = np.repeat(np.arange(len(ids)), n)
    term = np.arange(len(x)) - np.repeat(at[:-1] - at[0], n)
    on = w != 0
    w = w[on].astype(np.int32) if not len(w) or np.abs(w).max() < 2**31 else x[on]
    return ids, row[on], term[on], w


def _weights(cell: bytes, entries: int, scale: float) -> np.ndarray:
    """A block's weights: integers of 32 bits, or Python's integers."""
    if len(cell) == 4 * entries:
        return np.frombuffer(cell, np.int32)
    return np.array([_integer(v, scale) for v in np.frombuffer(cell, np.float64).tolist()], object)


def _packer(scale: float, size: int, stripes: int, by_term: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table):
            nonlocal k
            ids, row, term, w = _matrix(rows.combine_chunks().to_batches()[0], scale)
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            row = place[row]
            first, second = (term, row) if by_term else (row, term)
            o = np.lexsort((second, first))
            n = (int(term.max()) + 1 if len(term) else 0) if by_term else len(ids)
            ptr = np.searchsorted(first[o], np.arange(n + 1))
            uid = (part << 24) + k
            k += 1
            cells = [[(part + uid) % stripes], [uid], [ids[order].tobytes()], [ptr.astype(np.int64).tobytes()], [second[o].astype(np.int32).tobytes()], [w[o].tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["stripe", "uid", "ids", "ptr", "pos", "w"])

        n = 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, size - n)
                b = b.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == size:
                    yield emit(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield emit(pa.Table.from_batches(held))

    return tidy(pack)


def _scores(q_terms: np.ndarray, q_w: np.ndarray, ptr: np.ndarray, pos: np.ndarray, w: np.ndarray, n: int, kind) -> np.ndarray:
    """One query's dense score array over a block, accumulated term by term."""
    acc = np.zeros(n, object if kind is int else kind)
    for t, x in zip(q_terms.tolist(), q_w.tolist(), strict=True):
        if t + 1 < len(ptr):
            a, b = ptr[t], ptr[t + 1]
            if b - a == n:
                acc += w[a:b] * kind(x)
            elif b > a:
                acc[pos[a:b]] += w[a:b] * kind(x)
    return acc


def _overflow(score: int) -> bytes | None:
    """Where a score beyond a long stands among others, as bytes in order: below, within (null), above."""
    if -LONG - 1 <= score <= LONG:
        return None
    size = score.bit_length() // 8 + 1
    if score > 0:
        return b"\x02" + size.to_bytes(4, "big") + score.to_bytes(size, "big")
    return b"\x00" + (2**32 - 1 - size).to_bytes(4, "big") + (256**size + score).to_bytes(size, "big")


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, of equal ones the first: a partition selects the threshold."""
    if len(s) <= k:
        return np.arange(len(s))
    if s.dtype == object:
        return np.array(sorted(range(len(s)), key=lambda i: (-s[i], i))[:k], np.int64)
    cut = np.partition(s, len(s) - k)[len(s) - k]
    above, ties = np.flatnonzero(s > cut), np.flatnonzero(s == cut)
    return np.concatenate([above, ties[: k - len(above)]])


def _search(k: int, scale: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for j in range(batch.num_rows):
                r = batch.slice(j, 1).to_pylist()[0]
                q_ids, q_ptr, q_pos, ids, ptr, pos = (np.frombuffer(r[c], t) for c, t in (("q_ids", np.int64), ("q_ptr", np.int64), ("q_pos", np.int32), ("ids", np.int64), ("ptr", np.int64), ("pos", np.int32)))
                q_w, w = _weights(r["q_w"], len(q_pos), scale), _weights(r["w"], len(pos), scale)
                n = len(ids)
                largest = lambda v: max(1, -int(v.min(initial=0)), int(v.max(initial=0)))
                most = largest(w) * largest(q_w) * max(1, len(ptr))
                kind = np.int32 if most < 2**31 else np.int64 if most < 2**63 else object
                w = w.astype(kind)
                for i, own in enumerate(q_ids.tolist()):
                    a, b = q_ptr[i], q_ptr[i + 1]
                    score = _scores(q_pos[a:b], q_w[a:b], ptr, pos, w, n, int if kind is object else kind)
                    lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                    alive = np.concatenate([np.arange(lo), np.arange(hi, n)]) if hi > lo else np.arange(n)
                    # rows are in id order: of equal scores the first stay
                    pick = alive[_best(score[alive], k)]
                    s = score[pick].tolist()
                    beyond = [_overflow(v) for v in s] if kind is object else [None] * len(s)
                    s = np.array([max(-LONG - 1, min(LONG, v)) for v in s] if kind is object else s, np.int64)
                    out.append((np.full(len(s), own), np.full(len(s), (r["q_uid"] << 16) + i), ids[pick], s, beyond))
            if out:
                *cols, beyond = zip(*out, strict=True)
                cells = [pa.array(np.concatenate(c), pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays([*cells, pa.array([v for x in beyond for v in x], pa.binary())], names=["query_id", "query_row", "vec_id", "score", "beyond"])

    return tidy(search)


def exact_top_k(rows: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, scale: float = 1.0, block_rows: int = 4096, query_rows: int = 512, stripes: int | None = None) -> DataFrame:
    """The k best partners of every row for which ``is_query`` holds, among all other rows.

    Returns query_id, rank (from 1), vec_id, score; the score is the inner product of the integer
    rows floor(scale * x). ``is_query`` is written over the input's own columns.
    """
    sound = F.col("vec").isNotNull() & F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks")).where(sound)
    spark = rows.sparkSession
    stripes = stripes or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cand = clean.select("id", "vec").mapInArrow(_packer(scale, block_rows, stripes, True), BLOCK)
    asks = clean.where("asks").select("id", "vec").mapInArrow(_packer(scale, min(query_rows, 1 << 16), stripes, False), BLOCK)
    asks = asks.select(*(F.col(c).alias(f"q_{c}") for c in ("uid", "ids", "ptr", "pos", "w")), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    # every query block meets every candidate block: blocks of a stated query set against all rows
    met = cand.repartition(stripes, "stripe").join(asks.repartition(stripes, "stripe").hint("merge"), "stripe").select("ids", "ptr", "pos", "w", "q_uid", "q_ids", "q_ptr", "q_pos", "q_w")
    part = met.mapInArrow(_search(k, scale), "query_id long, query_row long, vec_id long, score long, beyond binary")
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.desc(F.coalesce("beyond", F.lit(b"\x01"))), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
