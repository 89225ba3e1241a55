"""Exact n-gram Jaccard self-join with set-relation skipping.

1. Every text becomes a set of shingle hashes; equal sets share a fingerprint and are one set.
2. A fixed-size frequency sketch orders shingles, rare ones first. A set posts the shingles of its
   prefix: two sets with the wanted similarity share one (any common order keeps this exact, so the
   sketch's errors cost time only).
3. A posting list's leader is the set that the most lists hold; the pairs of the leader with the
   rows that sizes and positions leave are verified: first by bitmaps of the sets, which bound the
   overlap from above, then on the full sets.
4. The other pairs of a list are answered from the leader's answers: sets that its links connect
   need no answer of their own; for the rest the leader's overlaps bound the pair's overlap from
   both sides. Where lists stay in parts a second leader is taken from another part. Pairs that both
   leaders' answers leave open are looked up in blocks of the list in order of size: a pair of
   blocks is skipped as a whole where sizes, or the blocks' best positions, rule all its pairs out.
5. Links are turned into connected components; copies follow their set.

Defined cases: null and wordless texts have the empty set and link with nothing; texts of fewer
words than a shingle are one shingle; texts of any length are read whole; rows that repeat an id
are nodes of their own, so that an id may have rows in two components, each named by the smallest
id in it; rows with a null id get their set's size and no component; ties of size or order don't
matter, as every list row is a set's; an empty table gives no rows; other columns are ignored. Sets
are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shingles import runs, set_prints, shingle_sets
from lodestone.llm.worker import tidy
from lodestone.llm.workspace import Workspace, bounded

#: Cells of the frequency sketch: its size doesn't follow the data.
SKETCH_BITS = 20
CHUNK = 1 << 16


def _cells(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _scan(k: int):
    """doc_id, text_hash, n, fp for each row; then the task's sketch, in chunks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "text_hash", "n", "fp", "chunk", "cells"]
        for b in runs(batches, 1):
            g, at = shingle_sets(b.column(1), k)
            sketch += np.bincount(_cells(g), minlength=len(sketch)).astype(np.uint32)
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(at)), pa.array(set_prints(g, at).view(np.int64)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = [(i, sketch[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(sketch) // CHUNK)]
        parts = [(i, x.tobytes()) for i, x in parts if x.any()]
        m = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 4 + [pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    return tidy(scan)


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.uint32)
    for x in table.column("cells").to_pylist():
        total += np.frombuffer(x, np.uint32)
    level = np.floor(np.log2(np.maximum(total, 1))).astype(np.uint8)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([level.tobytes()], pa.binary())})


def least_overlap(n, percent: int):
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def pair_overlap(a, b, percent: int):
    """Shingles that sets of sizes a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def _post(k: int, percent: int, levels: bytes):
    order = np.frombuffer(levels, np.uint8)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's copies post once
        for b in runs(batches, 0):
            g, at = shingle_sets(b.column(0), k)
            n, fp = np.diff(at), set_prints(g, at)
            fresh = np.zeros(len(n), bool)
            for i, f in enumerate(fp.tolist()):
                if n[i] and f not in seen:
                    seen.add(f)
                    fresh[i] = True
            row = np.repeat(np.arange(len(n)), n)
            pick = fresh[row]
            row, h = row[pick], g[pick]
            o = np.lexsort((h, order[_cells(h)], row))
            row, h = row[o], h[o]
            m = np.where(fresh, n, 0)
            pos = np.arange(len(row)) - np.repeat((np.cumsum(m) - m), m)
            head = pos < (n - least_overlap(n, percent) + 1)[row]
            row, h, pos = row[head], h[head], pos[head]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(fp[row].view(np.int64)), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["token", "fp", "n", "pos"])

    return tidy(post)


def whole_lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows sorted by the first column, with each of its values' rows together: (starts of the lists, columns)."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        t = cols[0]
        if not len(t):
            continue
        last = 0 if t[0] == t[-1] else int(np.flatnonzero(t[1:] != t[:-1])[-1]) + 1
        if held and (last or t[0] != held[-1][0][-1]):
            held.append([c[:last] for c in cols])
            done = joined()
            held = []
            yield _starts(done[0]), done
        elif last:
            yield _starts(t[:last]), [c[:last] for c in cols]
        held.append([c[last:] for c in cols])
    if held:
        done = joined()
        yield _starts(done[0]), done


def _starts(t: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, t[1:] != t[:-1]])


def _partnered(size: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int, most: int = 256) -> np.ndarray:
    """Rows of lists (of ``size`` rows each) that sizes and positions let pair with another row of their list."""
    out = np.ones(len(n), bool)
    start = np.cumsum(size) - size
    for m in np.unique(size[size <= most]).tolist():  # longer lists are kept whole here
        lists = start[size == m]
        for part in np.array_split(lists, max(1, len(lists) * m * m >> 20)):
            at = part[:, None] + np.arange(m)
            a, b = n[at], left[at]
            pair = np.minimum(b[:, :, None], b[:, None, :]) >= pair_overlap(a[:, :, None], a[:, None, :], percent)
            pair[:, np.arange(m), np.arange(m)] = False
            out[at] = pair.any(2)
    return out


def _gather(percent: int):
    """The rows of lists that hold two sets and more, and can pair with another; copies posted by several tasks once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cols in whole_lists(batches, ["token", "fp", "n", "pos"]):
            token, fp = cols[:2]
            once = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
            cols = [c[once] for c in cols]
            size = np.diff(np.r_[_starts(cols[0]), len(cols[0])])
            several = np.repeat(size > 1, size)
            token, fp, n, pos = (c[several] for c in cols)
            n = n.astype(np.int64)
            on = _partnered(size[size > 1], n, n - pos, percent)
            yield pa.RecordBatch.from_arrays([pa.array(token[on]), pa.array(fp[on]), pa.array(n[on].astype(np.int32)), pa.array(pos[on])], names=["token", "fp", "n", "pos"])

    return tidy(gather)


#: An overlap that nothing is known of. Negative overlaps are bounds from above: -1 - bound.
UNKNOWN = -(1 << 40)


def _bounds(n_x, n_y, need, known: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(open, sure) for pairs of sets, from the overlaps (leader's size, with x, with y) of earlier leaders."""
    open_, sure = np.ones(np.broadcast(n_x, n_y).shape, bool), np.zeros(np.broadcast(n_x, n_y).shape, bool)
    for size, x, y in known:
        whole_x, whole_y = x >= 0, y >= 0
        both = whole_x & whole_y
        # what x and y share lies in the leader, or outside it in what each has left
        most = np.where(both, np.minimum(x, y) + np.minimum(n_x - x, n_y - y), np.where(whole_x, -1 - y + n_x - x, np.where(whole_y, -1 - x + n_y - y, need)))
        open_ &= most >= need
        sure |= both & (x + y - size >= need)
    return open_, sure & open_


LIST = ["token", "fp", "n", "pos", "fame", "root", "size1", "shared1"]
LED = "token long, fp long, n int, pos int, fame long, root long, size1 long, shared1 long, leader long, leader_n int, pair boolean, sure boolean, more boolean"


def _lead(percent: int, later: bool):
    """Each list's rows with its leader, and whether (leader, row) is a pair to verify, or proven.

    Rows come by fame, so the leader is the set that most lists hold: the centre of its group. In
    the later round it is the first set that the links so far don't connect to that one; lists
    that are wholly connected are settled.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, cols in whole_lists(batches, LIST):
            token, fp, n, pos, fame, root, size1, shared1 = cols
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            count = np.diff(np.r_[starts, len(token)])
            leader = np.repeat(starts, count)
            if later:
                apart = np.where(root != root[leader], np.arange(len(token)), len(token))
                first = np.minimum.reduceat(apart, starts)
                on = np.repeat(first < len(token), count)
                leader = np.repeat(np.minimum(first, len(token) - 1), count)
            else:
                on = np.ones(len(token), bool)
            # rows that the sizes and positions rule out are masked after the list was read
            need = pair_overlap(n, n[leader], percent)
            pair = on & (root != root[leader]) & (np.minimum(n - pos, n[leader] - pos[leader]) >= need)
            open_, sure = _bounds(n, n[leader], need, [(size1, shared1, shared1[leader])])
            pair &= open_
            more = np.repeat(count > 2, count)  # two rows are one pair, which the leader's answer settles
            on &= more | pair
            out = [*cols, fp[leader], n[leader].astype(np.int32), pair, sure & pair, more]
            yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in out], names=[*LIST, "leader", "leader_n", "pair", "sure", "more"])

    return tidy(lead)


OPEN = ["token", "fp", "n", "pos", "root", "size1", "shared1", "size2", "shared2"]


def _rest(percent: int, rows_only: bool, side: int = 512):
    """Pairs that are still apart and that neither leader's answers settle; ``sure`` marks those that they prove.

    With ``rows_only`` the rows that have such a pair; else rows bring their sets' bitmaps, and only
    pairs that these leave possible go out.
    """

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, cols in whole_lists(batches, OPEN if rows_only else [*OPEN, "bits"]):
            _, fp, n, pos, root, size1, shared1, size2, shared2 = cols[:9]
            alive = np.zeros(len(fp), bool)
            n, left = n.astype(np.int64), n.astype(np.int64) - pos  # shingles from a row's position on
            ends = np.r_[starts[1:], len(fp)]
            bad = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)
            out = []
            for a, b in zip(starts[bad].tolist(), ends[bad].tolist(), strict=True):
                # rows come by size: a block's first and last row bound its sizes, its best row its positions
                blocks = np.arange(a, b, side)
                stop = np.minimum(blocks + side, b)
                best = np.maximum.reduceat(left[a:b], blocks - a)
                for i, (x0, x1) in enumerate(zip(blocks.tolist(), stop.tolist(), strict=True)):
                    # no partner is larger than 100 / percent times the block's largest set
                    last = a + int(np.searchsorted(n[a:b], n[x1 - 1] * 100 // percent, "right"))
                    later = np.arange(i, max(i + 1, -(-(last - a) // side)))
                    need = pair_overlap(n[x0], n[blocks[later]], percent)  # the least of any pair in the two blocks
                    for j in later[np.minimum(best[i], best[later]) >= need].tolist():
                        x, y = np.arange(x0, x1)[:, None], np.arange(blocks[j], stop[j])[None, :]
                        need = pair_overlap(n[x], n[y], percent)
                        pair = (y > x) & (root[x] != root[y]) & (np.minimum(left[x], left[y]) >= need)
                        if not pair.any():
                            continue
                        open_, sure = _bounds(n[x], n[y], need, [(size1[x], shared1[x], shared1[y]), (size2[x], shared2[x], shared2[y])])
                        p, q = np.nonzero(pair & open_)
                        if rows_only:
                            alive[x0 + p] = alive[blocks[j] + q] = True
                            continue
                        sure, need = sure[p, q], np.broadcast_to(need, pair.shape)[p, q]
                        p, q = x0 + p, blocks[j] + q
                        ok = np.fromiter((y or most_shared(cols[9][i], cols[9][j], n[i], n[j]) >= m for i, j, y, m in zip(p.tolist(), q.tolist(), sure.tolist(), need.tolist(), strict=True)), bool, len(p))
                        if ok.any():
                            out.append((fp[p[ok]], n[p[ok]], fp[q[ok]], n[q[ok]], sure[ok]))
            if rows_only:
                yield pa.RecordBatch.from_arrays([pa.array(c[alive]) for c in cols], names=OPEN)
            if out:
                c = [np.concatenate(z) for z in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1].astype(np.int32)), pa.array(c[2]), pa.array(c[3].astype(np.int32)), pa.array(c[4])], names=["leader", "leader_n", "fp", "n", "sure"])

    return tidy(rest)


def bitmap(g: np.ndarray) -> bytes:
    """Which of the cells, a power of two and at least two a shingle, hold a shingle of the set."""
    cells = 1 << max(6, int(2 * len(g) - 1).bit_length())
    out = np.zeros(cells, bool)
    out[(g & np.uint64(cells - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def most_shared(x: bytes, y: bytes, n_x: int, n_y: int) -> int:
    """A bound from above on the overlap of two sets from their bitmaps: a cell that one set has alone costs it a shingle."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    bits_a, bits_b = 8 * len(x), 8 * len(y)
    while bits_a != bits_b:  # the larger bitmap is folded
        if bits_a > bits_b:
            bits_a //= 2
            a = (a >> bits_a) | (a & ((1 << bits_a) - 1))
        else:
            bits_b //= 2
            b = (b >> bits_b) | (b & ((1 << bits_b) - 1))
    return min(n_x - (a & ~b).bit_count(), n_y - (b & ~a).bit_count())


def _possible(percent: int):
    """The pairs with the bound that their bitmaps give (-1 - bound), and whether it leaves a link possible."""
    names = ["leader", "leader_n", "fp", "n"]

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_numpy(), b.column("leader_n").to_numpy()
            need = pair_overlap(n.astype(np.int64), m.astype(np.int64), percent)
            cells = zip(b.column("bits"), b.column("theirs"), n.tolist(), m.tolist(), strict=True)
            most = np.fromiter((most_shared(x.as_py(), y.as_py(), i, j) for x, y, i, j in cells), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(-1 - most), pa.array(most >= need)], names=[*names, "shared", "possible"])

    return tidy(possible)


def _bitmaps(k: int):
    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 0):
            g, at = shingle_sets(b.column(0), k)
            bits = [bitmap(g[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(set_prints(g, at).view(np.int64)), pa.array(bits, pa.binary())], names=["fp", "bits"])

    return tidy(bitmaps)


def _arrays(k: int):
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 0):
            g, at = shingle_sets(b.column(0), k)
            yield pa.RecordBatch.from_arrays([pa.array(set_prints(g, at).view(np.int64)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)))], names=["fp", "set"])

    return tidy(arrays)


class Sets:
    """The corpus's sets by their prints, read again from their first documents: bitmaps of many, whole sets of few."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, ws: Workspace):
        self.docs, self.reps, self.k, self.ws = docs, reps, k, ws

    def _texts(self, ids: DataFrame, name: str) -> DataFrame:
        wanted = self.ws.save(ids.join(self.reps, "fp").select("rep").distinct(), f"{name}-wanted", narrow=True)
        w = F.broadcast(wanted) if bounded(wanted, 8) else wanted
        return self.docs.join(w, F.col("id") == F.col("rep"), "left_semi").select("text")

    def bitmaps(self, ids: DataFrame, name: str) -> DataFrame:
        """fp, bits: one row a set, though texts under one id may share it."""
        made = self.ws.save(self._texts(ids, f"{name}-bits").mapInArrow(_bitmaps(self.k), "fp long, bits binary"), f"{name}-bits")
        return made.groupBy("fp").agg(F.first("bits").alias("bits"))

    def whole(self, pairs: DataFrame, name: str) -> DataFrame:
        """fp, set of both sides of the pairs."""
        ids = pairs.select(F.col("leader").alias("fp")).union(pairs.select("fp")).distinct()
        return self.ws.save(self._texts(ids, f"{name}-sets").mapInArrow(_arrays(self.k), "fp long, set array<long>"), f"{name}-sets")


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """leader, leader_n, fp, n, shared: the overlap of each pair's full sets."""
    # the sets stay where they are as long as the pairs' ids are few: only the members' sets travel, to their leaders
    few = bounded(pairs, 32)
    heads = pairs.select(F.col("leader").alias("fp")).distinct()
    p, heads = (F.broadcast(pairs), F.broadcast(heads)) if few else (pairs, heads)
    leaders = sets.join(heads, "fp", "left_semi").select(F.col("fp").alias("leader"), F.col("set").alias("theirs"))
    met = sets.select("fp", "set").join(p, "fp").join(leaders.hint("merge"), "leader")
    # rows that repeat an id bring their set twice: one answer a pair
    return met.select("leader", "leader_n", "fp", "n", F.size(F.array_intersect("set", "theirs")).cast("long").alias("shared")).groupBy("leader", "leader_n", "fp", "n").agg(F.max("shared").alias("shared"))


def _verify(pairs: DataFrame, sets: Sets, percent: int, ws: Workspace, name: str) -> DataFrame:
    """leader, leader_n, fp, n, shared for the pairs: overlaps of the full sets, or -1 - bound where a bound rules a link out."""
    pairs = ws.save(pairs.select("leader", "leader_n", "fp", "n"), f"{name}-pairs", narrow=True)
    bits = sets.bitmaps(pairs.select(F.col("leader").alias("fp")).union(pairs.select("fp")).distinct(), name)
    met = pairs.join(bits.hint("merge"), "fp").join(bits.select(F.col("fp").alias("leader"), F.col("bits").alias("theirs")).hint("merge"), "leader")
    bound = ws.save(met.select("leader", "leader_n", "fp", "n", "bits", "theirs").mapInArrow(_possible(percent), "leader long, leader_n int, fp long, n int, shared long, possible boolean"), f"{name}-bound", narrow=True)
    ws.drop(f"{name}-bits")
    possible = bound.where("possible").drop("shared", "possible")
    shared = _exact(possible, sets.whole(possible, name))
    out = ws.save(shared.union(bound.where("not possible").drop("possible")), f"{name}-shared", narrow=True)
    ws.drop(f"{name}-sets")
    return out


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with their set's root: itself where no link holds it."""
    r = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.drop("root").join(r, F.col("fp") == F.col("__node"), "left").withColumn("root", F.coalesce("__root", "fp")).drop("__node", "__root")


def jaccard_components(docs: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id for every row; group (the component's number) and text_hash (xxhash64) tell rows of one id apart."""
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    scan = ws.save(d.mapInArrow(_scan(k), "doc_id long, text_hash long, n long, fp long, chunk int, cells binary"), "scan")
    rows = scan.where(F.col("chunk").isNull()).select("doc_id", "text_hash", "n", "fp")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in scan.where(F.col("chunk").isNotNull()).groupBy("chunk").applyInArrow(_add, "chunk int, cells binary").collect():  # a fixed 1 MB
        levels[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.uint8)
    reps = ws.save(rows.where("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")

    posts = d.where(F.col("id").isNotNull()).select("text").mapInArrow(_post(k, percent, levels.tobytes()), "token long, fp long, n int, pos int")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by_list = lambda x, *order: x.repartition(parts, "token").sortWithinPartitions("token", *order)
    lists = ws.save(by_list(posts, "n", "fp").mapInArrow(_gather(percent), "token long, fp long, n int, pos int"), "lists")
    ws.release()
    exact = F.col("shared") * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("leader_n"))
    unknown = F.lit(UNKNOWN).cast("long")

    sets = Sets(d, reps, k, ws)
    # first leaders: the set that the most lists hold
    fame = lists.groupBy("fp").agg(F.count("*").alias("fame"))
    known = lists.join(fame.hint("merge"), "fp").select("token", "fp", "n", "pos", "fame", F.col("fp").alias("root"), F.lit(0).cast("long").alias("size1"), unknown.alias("shared1"))
    led = ws.save(by_list(known, F.desc("fame"), "fp").mapInArrow(_lead(percent, False), LED), "led1")
    ws.drop("lists")
    first = _verify(led.where("pair").select("leader", "leader_n", "fp", "n").distinct(), sets, percent, ws, "first")
    links = first.where(exact).select("leader", "fp")
    roots = components(links.select(F.col("leader").alias("a"), F.col("fp").alias("b")), Workspace(spark, "links1"))
    ws.release()

    # later leaders: in lists that the links leave in parts
    answers = first.select("leader", "fp", F.col("shared").alias("s"))
    known = _with_root(led.where("more").join(answers.hint("merge"), ["leader", "fp"], "left"), roots)
    own = F.when(F.col("leader") == F.col("fp"), F.col("n").cast("long")).otherwise(F.coalesce("s", unknown))
    known = known.select("token", "fp", "n", "pos", "fame", "root", F.col("leader_n").cast("long").alias("size1"), own.alias("shared1"))
    led = ws.save(by_list(known, F.desc("fame"), "fp").mapInArrow(_lead(percent, True), LED), "led2")
    ws.drop("led1")
    second = _verify(led.where("pair and not sure").select("leader", "leader_n", "fp", "n").distinct(), sets, percent, ws, "second")
    links = links.union(second.where(exact).select("leader", "fp")).union(ws.save(led.where("sure").select("leader", "fp").distinct(), "proven", narrow=True))
    roots = components(links.select(F.col("leader").alias("a"), F.col("fp").alias("b")), Workspace(spark, "links2"))
    ws.release()

    # what is still apart and open after two leaders' answers: the rows, then with bitmaps their possible pairs
    answers = second.select("leader", "fp", F.col("shared").alias("s"))
    known = _with_root(led.where("more").drop("root").join(answers.hint("merge"), ["leader", "fp"], "left"), roots)
    known = known.select("token", "fp", "n", "pos", "root", "size1", "shared1", F.col("leader_n").cast("long").alias("size2"), own.alias("shared2"))
    rows_open = ws.save(by_list(known, "n", "fp").mapInArrow(_rest(percent, True), known.schema), "open")
    ws.drop("led2")
    bits = sets.bitmaps(rows_open.select("fp").distinct(), "third")
    more = by_list(rows_open.join(bits.hint("merge"), "fp").select(*OPEN, "bits"), "n", "fp").mapInArrow(_rest(percent, False), "leader long, leader_n int, fp long, n int, sure boolean")
    more = ws.save(more.groupBy("leader", "leader_n", "fp", "n").agg(F.max("sure").alias("sure")), "more", narrow=True)
    ws.drop("third-bits")
    unproven = more.where("not sure").drop("sure")
    third = ws.save(_exact(unproven, sets.whole(unproven, "third")), "third-shared", narrow=True)
    links = links.union(third.where(exact).select("leader", "fp")).union(more.where("sure").select("leader", "fp"))
    roots = components(links.select(F.col("leader").alias("a"), F.col("fp").alias("b")), Workspace(spark, "links3"))
    ws.drop("third-sets")
    ws.release()

    # a class is named by its smallest document
    rooted = _with_root(reps, roots)
    classes = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    moved = ws.save(rooted.join(classes.hint("merge"), "root").select("fp", "least", F.col("root").alias("group")), "moved")
    ws.drop("reps", *(f"{r}-{t}" for r in ("first", "second", "third") for t in ("pairs", "bits-wanted", "sets-wanted", "bound", "shared")), "proven", "open", "more")
    out = rows.join(moved.withColumnRenamed("fp", "__fp").hint("merge"), F.col("fp") == F.col("__fp"), "left")
    named = F.col("doc_id").isNotNull()
    return out.select(F.col("doc_id").alias("id"), F.col("n").alias("n_shingles"), F.when(named, F.coalesce("least", "doc_id")).alias("component_id"), F.when(named, F.col("group")).alias("group"), "text_hash")
