"""Keyed rows in a base and later parts, merged when they are read.

A part holds whole rows, and its touched keys: all that it writes anew or takes away. A row counts if no
later part touches its key. So a change is written at its own size, a reader meets the base with the
small table of touched keys (broadcast where their number, kept beside them, is small; beyond that their
hashes mark bits of a broadcast bitmap, and only rows whose bit is marked are joined by key), and a compaction turns the merged rows into a base again. Several rows may have one key
(a document's postings): they are replaced together. Rows with a null key are never replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Touched keys that are sent to every task; keys are digests or ids of some 64 bytes.
SMALL = 1 << 17
#: Bits of the bitmap for each touched key, and the most in all (32 MB); a row of the bitmap has PAGE bits.
BITS, MOST, PAGE = 32, 1 << 28, 1 << 15


@dataclass
class Part:
    rows: DataFrame
    #: The keys that it touches, and how many; None for a base, which has nothing before it.
    touched: DataFrame | None = None
    count: int = 0


def merged(parts: list[Part], keys: list[str]) -> DataFrame:
    """The rows that count, of parts in the order of their writing."""
    later = [(k, p) for k, p in enumerate(parts) if p.touched is not None]
    if not later:
        return reduce(DataFrame.unionByName, (p.rows for p in parts))
    # nothing comes after the last part
    rows = reduce(DataFrame.unionByName, (p.rows.withColumn("__part", F.lit(k)) for k, p in enumerate(parts[:-1])), parts[0].rows.limit(0).withColumn("__part", F.lit(0)))
    touched = reduce(DataFrame.union, (p.touched.select(*keys, F.lit(k).alias("__last")) for k, p in later)).groupBy(*keys).agg(F.max("__last").alias("__last"))
    columns, count = parts[0].rows.columns, sum(p.count for _, p in later)
    left = lambda df, t: df.join(t, keys, "left").where(F.col("__last").isNull() | (F.col("__part") >= F.col("__last"))).select(*columns)
    if count <= SMALL:
        out = left(rows, F.broadcast(touched))
    else:
        sure, maybe = _split(rows, later, keys, count)
        out = left(maybe, touched).unionByName(sure.select(*columns))
    return out.unionByName(parts[-1].rows.select(*columns))


def _split(rows: DataFrame, later: list[tuple[int, Part]], keys: list[str], count: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys no later part touches, rows whose keys one may touch), by a bitmap of the touched keys' hashes."""
    bits = min(MOST, max(PAGE, 1 << (BITS * count - 1).bit_length()))
    bit = F.pmod(F.xxhash64(*keys), F.lit(bits))
    page, place = F.shiftright(bit, PAGE.bit_length() - 1).alias("__page"), bit.bitwiseAND(F.lit(PAGE - 1))
    marks = reduce(DataFrame.union, (p.touched.select(*keys) for _, p in later)).select(page, place.alias("__place"))
    pages = F.broadcast(marks.groupBy("__page").agg(F.bitmap_construct_agg("__place").alias("__bits")))
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright("__place", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.expr("shiftright(__byte, cast(__place % 8 AS int)) & 1") == 1, F.lit(False))
    met = rows.withColumns({"__page": page, "__place": place}).join(pages, "__page", "left").withColumn("__byte", byte).withColumn("__marked", marked).drop("__page", "__place", "__bits", "__byte")
    return met.where("NOT __marked").drop("__marked"), met.where("__marked").drop("__marked")


def touched(rows: DataFrame, gone: DataFrame | None, keys: list[str]) -> DataFrame:
    """The keys that a part of these rows touches, with those that it only takes away."""
    mine = rows.select(*keys)
    return (mine if gone is None else mine.unionByName(gone.select(*keys))).distinct()
