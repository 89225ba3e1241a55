"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Both sides keep the smallest hash of k-word grams in each sliding window of grams, so that any
shared span of ``window`` words shares a kept hash. Documents whose kept hashes meet a benchmark
hash are extended: around each matching gram the windows of ``window`` words are compared, as
text, with the benchmark's windows. Items shorter than a window are one window of their own length
and are found by that length's grams.

Defined cases: every input row gives one row, repeated rows and ids too; null or wordless texts have
no words and no hits; null ids are kept; texts of any length are read whole; items without an id are
found like others, with a null among ``items``; repeated items count once; an empty benchmark leaves
every document clean; an empty table gives no rows; columns other than the named ones are ignored,
so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.exprs import alnum_words, by_row_id, let
from lodestone.llm.workspace import Workspace, bounded


def _gram(w: Column, i: Column, k: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *(F.get(w, i + j) for j in range(k)))


def _kept(w: Column, window: int, k: int) -> Column:
    """Distinct minimum gram hashes of each run of window - k + 1 grams; none for shorter texts."""
    n = window - k + 1

    def mins(g: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(g, 1, F.size(g) - n + 1), lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, n)))))

    grams = F.transform(F.slice(w, 1, F.size(w) - k + 1), lambda x, i: _gram(w, i, k, window))
    return F.when(F.size(w) >= window, let(grams, mins) if n > 1 else F.array_distinct(grams)).otherwise(F.array().cast("array<bigint>"))


def _text(w: Column, i: Column, m: int) -> Column:
    return F.array_join(F.slice(w, i + 1, m), " ")


def _starts(w: Column, m: int, g: int) -> Column:
    """The windows of m words around each gram of g words that is among ``marks``."""
    at = F.filter(F.sequence(F.lit(0), F.size(w) - g), lambda i: F.array_contains("marks", _gram(w, i, g, m)))
    near = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(F.lit(0), i - (m - g)), F.least(i, F.size(w) - m)))))
    windows = F.transform(near, lambda i: F.struct(i.alias("start"), F.lit(m).alias("m"), _text(w, i, m).alias("wtext")))
    return F.when(F.size(w) >= m, windows).otherwise(F.array().cast("array<struct<start:int,m:int,wtext:string>>"))


def _window_grams(wtext: str, m: int, g: int) -> Column:
    words = F.split(wtext, " ")
    return F.transform(F.sequence(F.lit(0), F.lit(m - g)), lambda i: _gram(words, i, g, m))


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item, m, wtext: each item's windows; one of its own length for a shorter item."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    m = F.least(F.size("w"), F.lit(window))
    rows = items.select("item", m.alias("m"), F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.array_join(F.slice("w", i + 1, m), " "))).alias("wtext"))
    return rows.distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = 10, k: int = 5) -> DataFrame:
    """id, n_words, n_hit (words inside an occurring window), items (sorted ids of items with one)."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    row = F.struct("id", "h").alias("row")  # what tells texts apart: ids may be null or repeat
    wins = benchmark_windows(bench, item_col, item_text_col, window)
    lengths = sorted(r.m for r in wins.select("m").distinct().collect())  # at most `window` values
    shapes = [(m, min(k, m) if m == window else m) for m in lengths]

    def prints(w: Column) -> Column:
        return F.array_distinct(F.concat(F.array().cast("array<bigint>"), *(_kept(w, m, g) for m, g in shapes)))

    marks = None
    for m, g in shapes:
        # a full window's kept gram is the smallest of its hashes; a short item's only gram is itself
        grams = _window_grams("wtext", m, g)
        part = wins.where(F.col("m") == m).select(F.array_min(grams).alias("mark"))
        marks = part if marks is None else marks.unionByName(part)
    if marks is None:
        return d.select("id", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    marks = marks.distinct()
    marks = F.broadcast(marks) if bounded(marks, 8) else marks
    found = d.select(row, F.explode_outer(let(alnum_words(F.col("text")), prints)).alias("mark")).join(marks, "mark").groupBy("row").agg(F.collect_set("mark").alias("marks"))

    def starts(w: Column) -> Column:
        return F.concat(*(_starts(w, m, g) for m, g in shapes))

    met = by_row_id(d.select(row, "text"), ws.save(found, "found", narrow=True), "row").where("marks IS NOT NULL")
    hits = met.select("row", F.explode(let(alnum_words(F.col("text")), starts)).alias("s")).select("row", "s.start", "s.m", "s.wtext").distinct()
    wins = wins.drop("m")
    met = hits.join(F.broadcast(wins) if bounded(wins) else wins, "wtext")
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "m")), lambda s: F.sequence(s["start"], s["start"] + s["m"] - 1)))))
    # in a struct, as a set leaves out bare nulls
    items = F.sort_array(F.transform(F.collect_set(F.struct("item")), lambda s: s["item"]))
    hit = ws.save(met.groupBy("row").agg(covered.cast("long").alias("n_hit"), items.alias("items")), "hit", narrow=True)
    out = by_row_id(d.select(row, F.size(alnum_words(F.col("text"))).cast("long").alias("n_words")), hit, "row")
    return out.select("row.id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
