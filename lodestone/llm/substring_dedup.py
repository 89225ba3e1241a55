"""Exact removal of repeated substrings with sharded suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts earlier (smaller id, or earlier in
the same document). Strings are dealt to shards by content: each window of ``length`` bytes has an
anchor, the smallest hash of its short grams, so equal windows always meet in one shard. A run of
windows with one anchor is a segment of at most twice the length. Segments of equal content are
collapsed into the earliest; of anchors with several contents, the segments' bytes are sorted into
a suffix array per shard by induced sorting, the permuted common prefixes of neighbours part its
order into classes of equal windows, and all but the earliest of a class go. An anchor with more
than ``hot`` contents would fill a shard of its own: its windows are dealt one by one by two
64-bit hashes instead, settled first where a task meets both copies.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose nothing; texts of
any length are read whole; rows with a null id lose nothing and count as no earlier place; rows
that repeat an id are one document at one place (equal texts don't remove each other); an empty
table gives no rows; other columns are ignored. Equal content of collapsed segments is judged by
two 64-bit hashes, of anchor and content, not by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.hashing import SALT, Prefix, mix
from lodestone.llm.jaccard import whole_lists
from lodestone.llm.shingles import runs, text_bytes
from lodestone.llm.suffix import permuted_common_prefixes, suffix_array
from lodestone.llm.worker import tidy
from lodestone.llm.workspace import Workspace

GRAM = 24
#: Window starts that are handled at a time, and segments that a task compares before it sends them on.
SLICE = 1 << 19
HELD = 1 << 18
#: Bytes of a shard's suffix array, but for a single anchor's segments, which are at most HOT.
SHARD = 1 << 20
HOT = 4096
PLACE_BITS = 24
PIECE = "key long, doc long, start long, bytes binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w, from block-wise running minima in both directions."""
    n = len(x)
    rows = -(-n // w)
    p = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = x
    p = p.reshape(rows, w)
    up = np.minimum.accumulate(p, 1).ravel()
    down = np.minimum.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def segments(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the row, windows, anchor hash, content hash) of the stream's segments."""
    n, w = len(raw), length - GRAM + 1
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(at[:-1], at[1:] - length + 1), 1)
    np.add.at(edge, at[1:], -1)
    open_ = np.cumsum(edge[:n]) == 0
    for lo in range(0, n - length + 1, SLICE):
        hi = min(lo + SLICE, n - length + 1)
        ok = open_[lo:hi]
        if not ok.any():
            continue
        h = Prefix(raw[lo : hi + length - 1])
        g = h.grams(GRAM)
        place = np.uint64((1 << PLACE_BITS) - 1)
        anchor = (sliding_min((g & ~place) | np.arange(len(g), dtype=np.uint64), w) & place).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])]
        a = np.flatnonzero(new)
        b = np.append(a[1:], hi - lo)
        a, b = a[ok[a]], b[ok[a]]
        key = g[anchor[a]]
        with np.errstate(over="ignore"):
            content = mix(h.spans(a, b - 1 + length) + ((b - a) * 128 + anchor[a] - a).astype(np.uint64) * SALT[3])
        row = np.searchsorted(at, lo + a, "right") - 1
        yield row, lo + a - at[row], b - a, key, content


def _cut(length: int):
    """key, content, doc, place (start * 128 + windows) of every segment; ``sure`` where this task has an earlier copy."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, start, n, key, content = (np.concatenate(c) for c in zip(*held, strict=True))
        place = start * 128 + n
        o = np.argsort(key ^ (content * np.uint64(0x9E3779B97F4A7C15)), kind="stable")  # held in order of row and start
        key, content, doc, place = key[o], content[o], doc[o], place[o]
        first = np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])]
        group = np.cumsum(first) - 1
        # the earliest of equal segments by document, then place
        o = np.lexsort((place, doc, group))
        key, content, doc, place = key[o], content[o], doc[o], place[o]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
        sure = ~first & ((doc != doc[lead]) | (place != place[lead]))
        # copies that are settled here travel under keys of their own
        key = np.where(sure, mix((doc * 1_000_003 + place).astype(np.uint64)), key)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc), pa.array(place), pa.array(sure)], names=["key", "content", "doc", "place", "sure"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in runs(batches, 1):
            raw, at = text_bytes(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, start, k, key, content in segments(raw, at, length):
                held.append((ids[row].astype(np.int64), start, k, key, content))
                n += len(row)
            if n >= HELD:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return tidy(cut)


@tidy
def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later copies of a content go (key is null); of anchors with several contents the earliest copies are kept for sorting.

    Rows come by key, content, doc and place. What a batch leaves open is one row: the content that
    goes on, and whether its anchor had another one; a hot anchor is never held.
    """
    names = ["key", "content", "doc", "place"]
    last: list[int] | None = None  # the row that leads the running content
    contents = 0  # of the running anchor so far
    for b in batches:
        key, content, doc, place = (b.column(c).to_numpy() for c in names)
        sure = b.column("sure").to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        if last is not None:  # the leading row stands before the batch once more
            key, content, doc, place = (np.r_[x, y] for x, y in zip(last, (key, content, doc, place), strict=True))
            sure = np.r_[False, sure]
        anchor = np.r_[True, key[1:] != key[:-1]]
        first = anchor.copy()
        first[1:] |= content[1:] != content[:-1]
        lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        gone = sure | (~first & ((doc != doc[lead]) | (place != place[lead])))
        starts = np.flatnonzero(anchor)
        count = np.add.reduceat(first.astype(np.int64), starts)
        if last is not None:
            count[0] += contents - 1
        several = np.repeat(count > 1, np.diff(np.r_[starts, len(key)])) & first & ~sure
        if last is not None and contents > 1:
            several[0] = False  # it went out before
        out = gone | several
        yield pa.RecordBatch.from_arrays([pa.array(key[out], pa.int64(), mask=gone[out]), pa.array(doc[out]), pa.array(place[out] >> 7), pa.array(place[out] & 127)], names=["key", "doc", "start", "windows"])
        k = lead[-1]
        last, contents = ([c[k] for c in (key, content, doc, place)], int(count[-1])) if not sure[k] else (None, 0)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all spans [start, start + size), one after the other."""
    end = np.cumsum(sizes)
    return np.repeat(starts - (end - sizes), sizes) + np.arange(end[-1] if len(end) else 0)


def _binary(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))])


def _fetch(length: int):
    """The bytes of the wanted segments; of hot anchors' segments a row for each window, with its second hash for bytes.

    A window that this task has met before is settled: its row has no bytes and a key of its own.
    """

    def piece(key, doc, start, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(start), data], names=["key", "doc", "start", "bytes"])

    def windows(raw, there: Prefix, back: Prefix, first, doc, start, n) -> pa.RecordBatch:
        at = spread(first, n)
        doc, start = np.repeat(doc, n), spread(start, n)
        h = there.spans(at, at + length)
        again = mix(back.spans(len(raw) - at - length, len(raw) - at) ^ SALT[3])
        o = np.lexsort((start, doc, again, h))
        h, again, doc, start = h[o], again[o], doc[o], start[o]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (again[1:] != again[:-1])]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(o)), 0))
        sure = ~fresh & ((doc != doc[lead]) | (start != start[lead]))
        key = np.where(sure, mix((doc * 1_000_003 + start).astype(np.uint64) ^ SALT[1]), h)
        return piece(key, doc, start, _binary(again[~sure].view(np.uint8), np.where(sure, 0, 8)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, 1):
            raw, at = text_bytes(b.column("text"))
            lists = b.column("wanted")
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            key, start, n = (flat.field(k).to_numpy() for k in range(3))
            hot = flat.field(3).to_numpy(zero_copy_only=False)
            doc = b.column("id").to_numpy()[owner]
            first = at[owner] + start
            for lo in range(0, len(key), 4096):
                on = np.flatnonzero(~hot[lo : lo + 4096]) + lo
                size = n[on] - 1 + length
                yield piece(key[on], doc[on], start[on], _binary(raw[spread(first[on], size)], size))
            if hot.any():
                both = Prefix(raw), Prefix(raw[::-1])
                for on in np.array_split(np.flatnonzero(hot), int(hot.sum()) // 4096 + 1):
                    yield windows(raw, *both, first[on], doc[on], start[on], n[on])

    return tidy(fetch)


def repeated_windows(data: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether each position of joined segments starts a window that also starts earlier in them."""
    starts_window = np.zeros(len(data) + 1, np.int32)
    end = np.cumsum(sizes)
    np.add.at(starts_window, end - sizes, 1)
    np.add.at(starts_window, end - length + 1, -1)
    is_window = np.cumsum(starts_window[: len(data)]) > 0
    sa = suffix_array(data)
    fresh = permuted_common_prefixes(data, sa, length)[sa] < length
    group = np.cumsum(fresh)
    on = is_window[sa]
    sa, group = sa[on], group[on]
    gone = np.zeros(len(data), bool)
    if len(sa):
        earliest = np.minimum.reduceat(sa, np.flatnonzero(np.r_[True, group[1:] != group[:-1]]))
        gone[sa] = True
        gone[earliest] = False
    return gone


def _sort(length: int):
    names = ["doc", "start", "windows"]

    def shard(doc, start, sizes, data) -> pa.RecordBatch:
        gone = repeated_windows(data, sizes, length)
        base = np.cumsum(sizes) - sizes
        edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
        a, b = edge[::2], edge[1::2]
        seg = np.searchsorted(base, a, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(start[seg] + a - base[seg]), pa.array(b - a)], names=names)

    def hashed(key, doc, start, second) -> pa.RecordBatch:
        o = np.lexsort((start, doc, second, key))
        key, doc, start, second = key[o], doc[o], start[o], second[o]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(o)), 0))
        out = ~fresh & ((doc != doc[lead]) | (start != start[lead]))
        return pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(start[out]), pa.array(np.ones(int(out.sum()), np.int64))], names=names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def split(key, doc, start, size, data):
            at = np.cumsum(size) - size
            whole = size >= length
            fresh = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]
            settled = size == 0
            if settled.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[settled]), pa.array(start[settled]), pa.array(np.ones(int(settled.sum()), np.int64))], names=names)
            second = size == 8
            if second.any():
                yield hashed(key[second], doc[second], start[second], data[spread(at[second], size[second])].view(np.int64))
            on = np.flatnonzero(whole & fresh)  # a repeated row's segment comes twice
            while len(on):
                total = np.cumsum(size[on])
                cut = int(np.searchsorted(total, SHARD, "right"))
                while 0 < cut < len(on) and key[on[cut]] == key[on[cut - 1]]:
                    cut -= 1
                if cut == 0:  # one anchor beyond a shard: at most HOT segments
                    cut = int(np.searchsorted(key[on] != key[on[0]], True)) if (key[on] != key[on[0]]).any() else len(on)
                now, on = on[:cut], on[cut:]
                yield shard(doc[now], start[now], size[now], data[spread(at[now], size[now])])

        held, n = [], 0
        for b in batches:
            cells = b.column("bytes")
            size = np.diff(np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1]).astype(np.int64)
            first = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset]
            data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[first : first + int(size.sum())]
            cols = [b.column(c).to_numpy() for c in ("key", "doc", "start")] + [size, data]
            if not len(size):
                continue
            held.append(cols)
            n += int(size.sum())
            if n < SHARD:
                continue
            key, doc, start, size, data = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(key, key[-1]))  # rows are in order of key
            end = int(size[:last].sum())
            if last:
                yield from split(key[:last], doc[:last], start[:last], size[:last], data[:end])
            held, n = [[key[last:], doc[last:], start[last:], size[last:], data[end:]]], int(size[last:].sum())
        if held:
            yield from split(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return tidy(sort)


def _merge(length: int):
    """Byte ranges of each document from its windows, in order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (doc, start, windows) in whole_lists(batches, ["doc", "start", "windows"]):
            number = np.zeros(len(doc), np.int64)
            number[starts] = 1
            number = np.cumsum(number)
            end = start + windows - 1 + length
            reach = np.maximum.accumulate((number << 40) + end)
            new = np.r_[True, (number << 40)[1:] + start[1:] > reach[:-1]]
            a = np.flatnonzero(new)
            last = np.append(a[1:], len(doc)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(start[a]), pa.array(reach[last] - (number[last] << 40))], names=["doc", "a", "b"])

    return tidy(merge)


@tidy
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = pc.fill_null(pc.cast(pc.binary_length(batch.column("text")), pa.int64()), 0).to_numpy(zero_copy_only=False)
        removed, spans, kept = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
        cuts = batch.column("cuts")
        for i, text in enumerate(batch.column("text")):
            raw = text.as_buffer() if text.is_valid else b""
            raw = memoryview(raw)
            h, at = hashlib.sha256(), 0
            if cuts[i].is_valid:
                for c in sorted((x["a"], x["b"]) for x in cuts[i].as_py()):
                    a, b = min(c[0], len(raw)), min(c[1], len(raw))
                    h.update(raw[at:a])
                    removed[i] += b - a
                    spans[i] += b > a
                    at = b
            h.update(raw[at:])
            kept.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(removed), pa.array(spans), pa.array(kept, pa.string()), cuts], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cuts"])


def substring_dedup(docs: DataFrame, id_col: str, text_col: str, length: int = 100, hot: int = HOT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and cuts (the removed byte ranges) of every row."""
    if length < GRAM + 1 or length - GRAM + 1 > 127:
        raise ValueError("length must be from 25 to 150")
    spark = docs.sparkSession
    ws = Workspace(spark, "substrings")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = d.where(F.col("id").isNotNull())
    cut = named.mapInArrow(_cut(length), "key long, content long, doc long, place long, sure boolean")
    found = cut.repartition(parts, "key").sortWithinPartitions("key", "content", "doc", "place").mapInArrow(_collapse, "key long, doc long, start long, windows long")
    found = ws.save(found, "found")
    ws.release()
    mixed = found.where(F.col("key").isNotNull())
    often = mixed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("hot"))
    mixed = mixed.join(often, "key", "left").select("doc", F.struct("key", "start", "windows", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = ws.save(mixed.groupBy("doc").agg(F.collect_list("w").alias("wanted")), "wanted")
    # texts meet their lists by id at every size: lists grow with the corpus, so they are never broadcast
    texts = named.join(wanted.hint("merge"), F.col("id") == F.col("doc")).select("id", "text", "wanted")
    more = texts.mapInArrow(_fetch(length), PIECE).repartition(parts, "key").sortWithinPartitions("key", "doc", "start").mapInArrow(_sort(length), "doc long, start long, windows long")
    gone = found.where(F.col("key").isNull()).select("doc", "start", "windows").union(more)
    ranges = gone.repartition(parts, "doc").sortWithinPartitions("doc", "start").mapInArrow(_merge(length), "doc long, a long, b long")
    cuts = ws.save(ranges.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), "cuts")
    ws.drop("found", "wanted")
    ws.release()
    cuts_type = "array<struct<a:bigint,b:bigint>>"
    out = d.join(cuts.hint("merge"), F.col("id") == F.col("doc"), "left").select("id", "text", "cuts")
    return out.mapInArrow(_remove, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cuts {cuts_type}")
