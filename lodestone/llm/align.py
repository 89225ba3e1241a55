"""Alignment of two tokenizers' tokens over the same bytes, and how often pairs of tokens meet in a corpus.

A run of texts is one stream of bytes. The places where tokens of either tokenizer end are counted once
for the whole stream (``bincount``); where both end, the stream is cut into groups. Running sums of the
three marks say at any byte how many tokens and groups came before it, so that a text's figures are
differences at its borders, and the two tokens that cover an end of either side are found by its sums.
Every end of either side closes one stretch that just one token of each side covers: these stretches
are the links.

Tokens come from ``fragments``: a byte-level BPE vocabulary (A), whose special tokens' strings are plain
text here, over a space and the text, and a sentencepiece model (B), which adds that space itself.

Pairs are counted over the whole corpus from rows that hold each pair of a text once, with how often it
occurs. Counts return to the texts by a broadcast join where their table's size is checked to be small;
beyond that, the pairs with more than a 65,536th of all rows, which can't be more than 65,536, are joined
that way, and the others, none of which can fill a task, by a shuffle.

Defined cases: a text that is null, empty, or whose tokens don't join to a space and its very bytes has
no tokens: zeros, and an empty string of groups; each row is a document of its own, also where ids or
whole rows repeat or are null; of tokens that are counted alike, all are a token's best; texts are
read whole; an empty table gives no rows; columns that clash with the results' names are replaced by them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.worker import held, tidy
from lodestone.llm.workspace import Workspace, bounded

FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
#: Bytes of text that are aligned at a time, and pairs that may be joined by broadcast whatever their number.
SLICE, HOT = 1 << 20, 1 << 16


class Aligner:
    """Both vocabularies, and the strings that a group's ids are written with."""

    def __init__(self, a_path: str, b_path: str):
        from lodestone.llm.fragments import ByteLevel, Pieces

        self.a, self.b = ByteLevel(a_path, plain=True), Pieces(b_path)
        shown = [f"{i}{s}" for size, seps in ((len(self.a.bytes), ",|"), (len(self.b.bytes), ",;")) for i in range(size) for s in seps]
        last = [f"{i}" for i in range(len(self.b.bytes))]
        self._shown = pa.array(shown + last, pa.large_binary())
        self._b_shown, self._last_shown = 2 * len(self.a.bytes), len(shown)

    def align(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
        """(n_a, n_b, n_groups, n_links), groups and links of texts that aren't null or empty."""
        from lodestone.llm.bpe_codec import rows_of
        from lodestone.llm.fragments import stream_of

        data, at = stream_of(pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
        docs = len(at) - 1
        (ids_a, n_a, good_a), (ids_b, n_b, good_b) = self.a.encode(data, at), self.b.encode(data, at)
        good = good_a & good_b
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            data = data[np.repeat(good, np.diff(at))]
            size = np.where(good, np.diff(at), 0)
            at = np.append(0, np.cumsum(size))
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        marks_a, marks_b = np.bincount(end_a, minlength=len(data) + 1), np.bincount(end_b, minlength=len(data) + 1)
        either, cut = (marks_a | marks_b) > 0, (marks_a & marks_b) > 0
        sum_a, sum_b, sum_cut, sum_either = (np.cumsum(x, dtype=np.int32) for x in (marks_a, marks_b, cut, either))
        figures = [np.diff(x[at]).astype(np.int64) for x in (sum_a, sum_b, sum_cut, sum_either)]
        ends = np.flatnonzero(either)
        before = ends - 1  # tokens that ended by then lie before the ones that cover the end
        link_a, link_b = ids_a[sum_a[before]], ids_b[sum_b[before]]
        return figures, self._groups(ids_a, ids_b, end_a, end_b, cut, sum_a, sum_b, sum_cut, at), self._links(link_a, link_b, figures[3], docs)

    def _groups(self, ids_a, ids_b, end_a, end_b, cut, sum_a, sum_b, sum_cut, at) -> pa.Array:
        from lodestone.llm.bpe_codec import rows_of
        from lodestone.llm.fragments import stream_of

        border = np.append(0, np.flatnonzero(cut))  # where groups begin and end
        group_a, group_b = sum_cut[end_a - 1], sum_cut[end_b - 1]
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        shown[np.arange(len(ids_a)) + sum_b[border[group_a]]] = 2 * ids_a + cut[end_a]
        closing = np.zeros(len(cut), bool)
        closing[at[1:]] = True
        shown[np.arange(len(ids_b)) + sum_a[border[group_b + 1]]] = np.where(closing[end_b], self._last_shown + ids_b, self._b_shown + 2 * ids_b + cut[end_b])
        written, begins = stream_of(self._shown.take(pa.array(shown)))
        return rows_of(written, begins[(sum_a + sum_b)[at[1:]]], pa.string())

    def _links(self, link_a: np.ndarray, link_b: np.ndarray, n: np.ndarray, docs: int) -> pa.Array:
        """Each text's different pairs, and how often each occurs in it."""
        bits = len(self.b.bytes).bit_length()
        pair_bits = bits + len(self.a.bytes).bit_length()
        key = np.repeat(np.arange(docs), n) << pair_bits | link_a << bits | link_b
        key.sort()
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        key = key[first]
        pair = key & ((1 << pair_bits) - 1)
        struct = pa.StructArray.from_arrays([pa.array((pair >> bits).astype(np.int32)), pa.array((pair & ((1 << bits) - 1)).astype(np.int32)), pa.array(np.diff(np.append(first, int(n.sum()))).astype(np.int32))], names=["a", "b", "times"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(key >> pair_bits, np.arange(docs + 1)).astype(np.int32)), struct)


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodestone.llm.bpe_codec import byte_sizes, runs

        tool = held(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        for batch in batches:
            last = batch.num_columns - 1
            for a, b in runs(byte_sizes(batch.column(last)), SLICE):
                part = batch.slice(a, b - a)
                texts = part.column(last)
                some = np.flatnonzero(byte_sizes(texts) > 0)
                place = np.full(len(texts), -1, np.int64)
                place[some] = np.arange(len(some))
                at = pa.array(place, mask=place < 0)
                figures, groups, links = tool.align(texts.take(pa.array(some)))
                counts = [pc.fill_null(pa.array(f).take(at), 0) for f in figures]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(last)), *counts, pc.fill_null(groups.take(at), ""), links.take(at)], names=[*batch.schema.names[:-1], *FIGURES, "groups", "links"])

    return tidy(run, keeps=True)


def align_tokens(docs: DataFrame, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """The input's other columns, and n_a, n_b, n_groups, n_links, groups and links of ``text_col``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, empty without tokens; ``links`` holds each different pair of ids
    whose tokens overlap, as (a, b, times), and is null for a text that is null or empty.
    """
    new = [*FIGURES, "groups", "links"]
    cols = [c for c in docs.columns if c not in (*new, text_col)]
    rows = docs.select(*cols, F.col(text_col).alias("__text"))
    pair = T.StructType([T.StructField(c, T.IntegerType()) for c in ("a", "b", "times")])
    added = [*(T.StructField(c, T.LongType()) for c in FIGURES), T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(pair))]
    return rows.mapInArrow(_aligned(a_path, b_path), T.StructType([*(f for f in rows.schema if f.name != "__text"), *added]))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("pair", F.col("a").cast("long") * (1 << 32) + F.col("b"))


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n (rows of ``links`` with that pair) and best: whether no pair of that a has more."""
    counts = links.groupBy("a", "b").agg(F.count("*").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def counted_links(links: DataFrame, pairs: DataFrame, width: int = 24) -> DataFrame:
    """``links`` with n and best of their pair; ``pairs`` is a written table."""
    links, pairs = _keyed(links).drop("a", "b"), _keyed(pairs).drop("a", "b")
    if bounded(pairs, width):
        return links.join(F.broadcast(pairs), "pair")
    often = pairs.agg(F.sum("n").alias("rows")).first().rows / HOT
    hot = F.broadcast(pairs.where(F.col("n") > often))
    return links.join(hot, "pair").unionByName(links.join(hot, "pair", "left_anti").join(pairs.where(F.col("n") <= often), "pair"))


def align_corpus(docs: DataFrame, text_col: str, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """The rows of ``align_tokens`` without links, and n_best and count_sum over a row's links.

    A pair's count is the number of rows that hold it. ``digest`` keeps groups_sha256 in place of groups.
    """
    ws = Workspace(docs.sparkSession, "align")
    rows = align_tokens(docs, text_col, a_path, b_path)
    if digest:
        hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        rows = rows.withColumn("groups_sha256", hashed).drop("groups")
    rows = ws.save(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    links = rows.select("__row", F.inline("links"))
    pairs = ws.save(pair_counts(links), "pairs", narrow=True)
    sums = counted_links(links, pairs).groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    kept = [c for c in rows.columns if c not in ("links", "__row", "n_best", "count_sum")]
    return rows.drop("links", "n_best", "count_sum").join(sums, "__row", "left").select(*kept, *zero)
