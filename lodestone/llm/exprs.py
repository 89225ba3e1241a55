"""Small expression helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import bounded

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words of letters and digits: every ASCII character that is neither.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def alnum_words(text: Column) -> Column:
    """Words of letters and digits, ASCII letters in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), ALNUM_GAP), "")


def by_row_id(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` (nulls match nulls) with a written table, which is broadcast only if its measured size is small."""
    r = right.withColumnRenamed(key, "__key")
    r = F.broadcast(r) if bounded(right) else r
    return left.join(r, left[key].eqNullSafe(F.col("__key")), "left").drop("__key")
