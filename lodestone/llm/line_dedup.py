"""Line dedup by site-relative frequency, in DataFrame expressions only.

A page is a row, its host a column. For each host, the pages that contain a line are divided by
the host's pages; lines above the ratio are boilerplate and leave every page of that host.

Counting goes by (host, line hash) with partial sums; only the survivors' texts are then counted
exactly, so a hash collision cannot decide. A host has at most (mean lines a page) / ratio such
lines, which are kept as one set per host.

The default ratio comes from measured shares: of lines that repeat within a source, hardly any reach a
tenth of its pages, the next ones lie between 3 and 5 percent, and below 3 percent their number doubles
with each step down, as lines of copied documents come in. So 3 percent parts what a site repeats from
what documents share.

Defined cases: a null text is an empty one, which has one blank line; blank lines are never boilerplate; a
line counts once a page; a null host is a host of its own; repeated rows are pages of their own;
hosts whose line is on fewer than ``min_pages`` pages lose nothing; a page that loses every line
keeps an empty text; texts of any length are read whole; an empty table gives no rows; the results
replace input columns of their names (n_lines, n_dropped), which may serve as the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.workspace import Workspace, bounded

#: Share of a host's pages above which a line is boilerplate, and pages that it is on at least.
BOILERPLATE, MIN_PAGES = 0.03, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float, min_pages: int, ws: Workspace) -> DataFrame:
    """host, lines: the set of lines above the ratio, one row for each host that has any."""
    p = pages.select(host.cast("string").alias("host"), text.alias("text"))
    totals = p.groupBy("host").agg(F.count("*").alias("pages"))
    each = p.select("host", F.explode_outer(F.array_distinct(_lines(F.col("text")))).alias("line")).where(F.trim("line") != "")
    by_hash = each.groupBy("host", F.xxhash64("line").alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    small = bounded(totals := ws.save(totals, "totals", narrow=True))
    t = F.broadcast(totals) if small else totals
    above = (F.col("n") > F.col("pages") * F.lit(ratio)) & (F.col("n") >= min_pages)
    often = ws.save(by_hash.join(t.withColumnRenamed("host", "th"), F.col("host").eqNullSafe(F.col("th"))).where(above).select("host", "h"), "often", narrow=True)
    o = often.select(F.col("host").alias("oh"), F.col("h").alias("ohash"))
    o = F.broadcast(o) if bounded(often) else o
    exact = each.join(o, F.col("host").eqNullSafe(F.col("oh")) & (F.xxhash64("line") == F.col("ohash")), "left_semi").groupBy("host", "line").agg(F.count("*").alias("n"))
    kept = exact.join(t.withColumnRenamed("host", "th"), F.col("host").eqNullSafe(F.col("th"))).where(above)
    return ws.save(kept.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines")), "boilerplate", narrow=True)


def line_dedup(pages: DataFrame, host: Column, text_col: str, ratio: float = BOILERPLATE, min_pages: int = MIN_PAGES, salts: int = 64) -> DataFrame:
    """The pages with their text reduced, and n_lines, n_dropped beside the input's columns."""
    ws = Workspace(pages.sparkSession, "lines")
    drop = boilerplate(pages, host, F.col(text_col), ratio, min_pages, ws)
    cols = [c for c in pages.columns if c not in ("n_lines", "n_dropped")]
    d = pages.select(F.struct(*cols).alias("__row"), host.cast("string").alias("__host"), _lines(F.col(text_col)).alias("__lines"))
    b = drop.select(F.col("host").alias("__bh"), F.col("lines").alias("__drop"))
    if bounded(drop):
        met = d.join(F.broadcast(b), F.col("__host").eqNullSafe(F.col("__bh")), "left")
    else:  # a host may hold a third of all pages: its pages are dealt over salts, its set goes to each
        salted = b.withColumn("__bs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        d = d.withColumn("__salt", F.pmod(F.xxhash64(F.to_json("__row")), F.lit(salts)).cast("int"))
        met = d.join(salted, F.col("__host").eqNullSafe(F.col("__bh")) & (F.col("__salt") == F.col("__bs")), "left")
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.filter("__lines", lambda x: ~F.array_contains("__drop", x)))
    out = met.select("__row", F.size("__lines").cast("long").alias("__n"), kept.alias("__kept"))
    same = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in cols]
    return out.select(*same, F.col("__n").alias("n_lines"), (F.col("__n") - F.size("__kept")).alias("n_dropped"))
