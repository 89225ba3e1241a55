"""Frames cut from their lineage in storage that all executors share, and numbering without a single task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def shared_root(spark) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local session, as executors of a cluster don't share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or _local_root()).rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint()


#: Rows of a part in which a join by key sorts its sides.
ROWS = 1 << 19


def parted(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """One side of a join by ``keys`` whose larger side has ``rows`` rows: dealt into parts of some ``ROWS`` rows.

    A number that is asked for is kept, while adaptive execution puts parts together up to a size of
    compressed bytes; nor is a side then sent to every task because its files are small.
    """
    n = -(-rows // ROWS)
    return df if n <= 1 else df.repartition(n, *keys).hint("merge")


def spread(spark, rows: int) -> int:
    """``rows`` for ``parted``; where they make more than one part, at least as many as make a part a core."""
    return rows if rows <= ROWS else max(rows, ROWS * spark.sparkContext.defaultParallelism)


def numbered_from_one(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """``df`` with its rows numbered from 1 without gaps in the given order, by ranges and their offsets.

    The order's ranges are sorted apart and stored, so that no task holds all rows and a second
    reading finds the same ranges.
    """
    placed = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # one row a range: as many as partitions
    met = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return met.withColumn(name, place + F.col("__before") + 1).drop("__part", "__at", "__before")
