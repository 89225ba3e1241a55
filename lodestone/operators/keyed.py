"""Insert-if-absent and replace on immutable frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` with ``outcome``: inserted, or already-present where the store or an earlier row has the key."""
    cols = new.columns
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in cols if c not in keys] or keys))
    have = store.select(*keys).distinct().withColumn("__have", F.lit(True))
    out = new.withColumn("__nth", nth).join(have, keys, "left")
    return out.select(*cols, F.when(F.col("__have").isNull() & (F.col("__nth") == 1), "inserted").otherwise("already-present").alias("outcome"))


def appended(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store with the rows that it lacked."""
    return store.unionByName(insert_absent(store, new, keys).where("outcome = 'inserted'").drop("outcome"))


def replace_by_key(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


#: Bits of a key's hash that name its range: 4,096 ranges.
RANGE_BITS = 12


def key_range(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << RANGE_BITS))


def range_sums(rows: DataFrame, key: str, body: list[str]) -> DataFrame:
    """range, n, one, two: the rows of each range of keys in 128 bits, whatever their order.

    Tasks reduce their rows to a row a range before anything moves.
    """
    text = F.to_json(F.struct(key, *body), {"ignoreNullFields": "false"})
    hashed = rows.select(key_range(key).alias("range"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit("second"), text).alias("two"))
    return hashed.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))


def differing_ranges(source: DataFrame, replica: DataFrame, key: str, body: list[str]) -> DataFrame:
    """range: those whose sums differ between the sides, or that one side lacks; at most 4,096 rows."""
    a, b = (range_sums(df, key, body).select("range", F.struct("n", "one", "two").alias(name)) for df, name in ((source, "a"), (replica, "b")))
    return a.join(b, "range", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("range")


def within(rows: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """The rows whose keys lie in ``ranges``, picked where they are."""
    return rows.join(F.broadcast(ranges), key_range(key) == ranges["range"], "left_semi")


def difference(source: DataFrame, replica: DataFrame, key: str, body: list[str]) -> DataFrame:
    """key, status for rows that aren't equal on both sides: Missing, Extra or Diverged."""
    digest = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)
    a = source.select(F.col(key).alias("key"), digest.alias("a"))
    b = replica.select(F.col(key).alias("key"), digest.alias("b"))
    status = F.when(F.col("b").isNull(), "Missing").when(F.col("a").isNull(), "Extra").when(F.col("a") != F.col("b"), "Diverged")
    return a.join(b, "key", "full_outer").select("key", status.alias("status")).where("status IS NOT NULL")
