"""Vector best-fit packing of documents into token sequences.

Documents are encoded with the compiled tokenizer, end with a separator and are cut into pieces
only where they are longer than a sequence. Sequences have three capacities: tokens, documents and
attention cost (the sum of squared lengths). Lengths fall in decreasing order; each piece goes to
the open sequence that holds it under every constraint and has the best score: the largest weighted
dot-product of demand and residual turned towards full bins ("dot"), or the smallest weighted
residual norm after it ("norm").

Only a histogram of lengths reaches the driver: pieces of one length are alike, so a whole class is
placed at a time, and the plan is a list of runs (length, first rank, how many, first sequence,
offset) whose number depends on the number of lengths, not of documents. Ranks within a length come
from per-task counts and a window over tasks, never from one sorted partition.

Without other limits the capacities are ``tokens`` documents and ``tokens`` squared of attention: these
never turn a piece away that the tokens would take, but their residuals count in the score, so that
of sequences with room alike the one with more and longer pieces is filled first.

Defined cases: a null text is an empty one: its separator only; ties of score go to the kind that
came first, so that a plan is the same each time; rows that repeat an id are packed
each; null ids are packed too; a text longer than a sequence gives its short piece first; a piece
alone beyond a capacity gets a sequence of its own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.token_counts import slices
from lodestone.llm.worker import tidy
from lodestone.llm.workspace import Workspace

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def _cutter(path: str, separator: int, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.llm.bpe import encode, text_ids

        task, seen = TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            for a, b, texts in slices(batch, 1):
                owner, place, table = encode(texts, path, quick=True)
                n = np.bincount(owner, weights=table.counts[place], minlength=len(texts)).astype(np.int64)
                ids = text_ids(place, table)
                end = np.cumsum(n)
                whole = np.insert(ids, end, np.uint32(separator)).astype("<u4") if len(texts) else ids
                size = n + 1
                pieces = -(-size // most)
                doc = np.repeat(np.arange(len(texts)), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = size - (pieces - 1) * most  # the first piece takes what is left over
                length = np.where(k == 0, short[doc], most)
                start = np.where(k == 0, 0, short[doc] + (k - 1) * most)
                at = (np.cumsum(size) - size)[doc] + start
                raw = memoryview(whole).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(doc))
                o = np.argsort(length, kind="stable")
                ranked = length[o]
                fresh = np.r_[True, ranked[1:] != ranked[:-1]] if len(o) else np.zeros(0, bool)
                within = np.arange(len(o)) - np.repeat(np.flatnonzero(fresh), np.diff(np.r_[np.flatnonzero(fresh), len(o)]))
                rank = np.empty(len(o), np.int64)
                rank[o] = within + seen[ranked]
                seen += np.bincount(length, minlength=most + 1)
                doc_id = batch.column(0).slice(a, b - a).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)], names=[c.split()[0] for c in PIECE.split(", ")])

    return tidy(cut, keeps=True)


def plan_bins(counts: dict[int, int], tokens: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), by: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place ``counts[length]`` pieces of each length.

    Open sequences with equal residuals are one kind; a run moves as many of a kind as there are
    pieces, so the plan's size follows the number of lengths.
    """
    caps = np.array([tokens, documents, attention], np.float64)
    w = np.asarray(weights, np.float64)
    kinds: dict[tuple[int, int, int], list[list[int]]] = defaultdict(list)  # residuals -> [first sequence, count]
    runs: list[tuple[int, int, int, int, int]] = []
    fresh = 0
    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        left, rank, need = counts[length], 0, np.array([length, 1, length * length])
        while left:
            best = None
            if kinds:
                res = np.array(list(kinds), np.int64)
                fits = np.flatnonzero((res >= need).all(1))
                if len(fits):
                    r, d = res[fits] / caps, need / caps
                    # both scores prefer the fullest feasible kind; they differ where capacities compete
                    score = ((r - d) ** 2 @ w) if by == "norm" else -((1 - r) * d) @ w
                    best = tuple(int(v) for v in res[fits[int(np.argmin(score))]])
            if best is None:
                alone = bool((need > caps).any())
                residual = (0, 0, 0) if alone else tuple(int(v) for v in (caps - need))
                # as many new sequences as the pieces left over from filling each with its own kind would need
                each = 1 if alone else max(1, int(min(tokens // length, documents, attention // (length * length))))
                n = -(-left // each)
                runs.append((length, rank, n, fresh, 0))
                if not alone and residual[0] > 0 and residual[1] > 0:
                    kinds[residual].append([fresh, n])
                fresh, rank, left = fresh + n, rank + n, left - n
                continue
            spans = kinds[best]
            after = tuple(int(a - b) for a, b in zip(best, need.tolist(), strict=True))
            while spans and left:
                first, n = spans[-1]
                take = min(n, left)
                runs.append((length, rank, take, first, tokens - best[0]))
                if after[0] > 0 and after[1] > 0:
                    kinds[after].append([first, take])
                rank, left = rank + take, left - take
                if take == n:
                    spans.pop()
                else:
                    spans[-1] = [first + take, n - take]
            if not spans:
                del kinds[best]
    return runs


def _placer(runs: list[tuple[int, int, int, int, int]], names: list[str]):
    by_length: dict[int, np.ndarray] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                r = by_length[int(x)]
                i = np.searchsorted(r[:, 0], rank[at], "right") - 1
                seq[at] = r[i, 2] + rank[at] - r[i, 0]
                off[at] = r[i, 3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return tidy(put)


def best_fit_pack(docs: DataFrame, id_col: str, text_col: str, path: str, separator: int, tokens: int = 1024, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), by: str = "norm") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place."""
    ws = Workspace(docs.sparkSession, "packing")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = ws.save(d.mapInArrow(_cutter(path, separator, tokens), PIECE), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length: at most `tokens`
    runs = plan_bins(counts, tokens, documents or tokens, attention or tokens * tokens, weights, by)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_task.withColumn("before", before).groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(offsets, "task").select(*names, (F.col("place") + F.element_at("before", F.col("length"))).alias("rank"))
    return ranked.mapInArrow(_placer(runs, names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
