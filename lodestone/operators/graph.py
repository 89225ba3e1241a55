"""Bounded walks over the provenance graph, set at a time, and its coverage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.stored import parted, stored


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst, edge_kind in both directions."""
    e = edges.select("src", "dst", "edge_kind")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_kind"))


def directed(edges: DataFrame, direction: str) -> DataFrame:
    e = edges.select("src", "dst", "edge_kind")
    if direction == "forward":
        return e
    if direction == "backward":
        return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_kind")
    if direction == "both":
        return symmetric(edges)
    raise ValueError(f"unknown direction {direction!r}")


#: Edges of one node that go to one place; a node with more is a hub. Hubs or digests up to this number are sent to every task.
HUB, SMALL = 10_000, 50_000


def _dealt(steps: DataFrame, hub: int):
    """(steps with their share, a function that deals a frontier over shares): hubs' edges lie in shares of about ``hub``."""
    hubs = stored(steps.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("node", F.ceil(F.col("n") / hub).alias("shares")))
    if hubs.isEmpty():
        return steps.withColumn("share", F.lit(0).cast("long")), lambda frontier: frontier.withColumn("share", F.lit(0).cast("long"))
    known = F.broadcast(hubs) if hubs.limit(SMALL + 1).count() <= SMALL else hubs
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    placed = steps.join(known, "node", "left").withColumn("share", F.pmod(F.xxhash64("next"), shares)).drop("shares")
    return placed, lambda frontier: frontier.join(known, "node", "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares")


def walk(seeds: DataFrame, edges: DataFrame, hops: int, direction: str = "forward", hub: int = HUB) -> DataFrame:
    """seed, node, depth: the fewest steps from each seed (column ``seed``) to each node within ``hops``.

    One frontier a level; nodes met before fall out by an anti-join, so cycles end by themselves. A node
    with over ``hub`` edges has them dealt over shares, and the frontier goes to each of them, so that no
    task holds all edges of a hub.
    """
    steps, dealt = _dealt(directed(edges, direction).select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), hub)
    seen = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, hops + 1):
        frontier = dealt(frontier).join(steps, ["node", "share"]).select("seed", F.col("next").alias("node")).distinct()
        frontier = frontier.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth < hops:  # each level is stored once: its plan would be part of every later one, twice
            frontier = stored(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def trace(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """Forward walk without the seeds: depth, kinds of all edges into the node, and its claim (null where it dangles)."""
    kinds = edges.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_list("edge_kind")).alias("edge_kinds"))
    reached = walk(seeds, edges, hops).where("depth > 0")
    return reached.join(kinds, "node", "left").join(nodes.select(F.col("record_digest").alias("node"), "claim", F.lit(False).alias("dangling")), "node", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True)))


def in_order(walked: DataFrame) -> DataFrame:
    """A walk's rows as they are shown: by seed, depth and node."""
    return walked.orderBy("seed", "depth", "node")


def neighbours(digests: DataFrame, edges: DataFrame) -> DataFrame:
    """digest, other, edge_kind, outgoing: edges out of and into each digest."""
    out = edges.select(F.col("src").alias("digest"), F.col("dst").alias("other"), "edge_kind", F.lit(True).alias("outgoing"))
    both = out.unionByName(edges.select(F.col("dst").alias("digest"), F.col("src").alias("other"), "edge_kind", F.lit(False).alias("outgoing")))
    d = digests.select("digest")
    if d.limit(SMALL + 1).count() <= SMALL:
        return both.join(F.broadcast(d), "digest", "left_semi")
    rows = max(2 * edges.count(), d.count())
    # an inner join, as Spark would move a semi-join below the dealing
    return parted(both, rows, "digest").join(parted(d, rows, "digest").distinct(), "digest")


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges["src"] == n["node"], "left_semi").join(n, edges["dst"] == n["node"], "left_semi")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, dangling, isolated_pct, mean_degree in one row; an empty graph has zeros."""
    inside = existing(edges, nodes)
    touched = inside.select(F.col("src").alias("node")).union(inside.select(F.col("dst").alias("node"))).distinct()
    counts = nodes.select("node").distinct().agg(F.count("*").alias("nodes"))
    out = counts.join(edges.agg(F.count("*").alias("all_edges"))).join(inside.agg(F.count("*").alias("edges"))).join(touched.agg(F.count("*").alias("touched")))
    n = F.when(F.col("nodes") == 0, None).otherwise(F.col("nodes"))
    return out.select("nodes", "edges", (F.col("all_edges") - F.col("edges")).alias("dangling"), F.coalesce((F.col("nodes") - F.col("touched")) * 100.0 / n, F.lit(0.0)).alias("isolated_pct"), F.coalesce(F.col("edges") * 2.0 / n, F.lit(0.0)).alias("mean_degree"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component: the smallest node of each connected part, by alternating large-star and small-star steps.

    Each step's links are checkpointed, so plans stay short. Links that ``rounds`` don't settle are an error.
    """
    e = existing(edges, nodes).where("src <> dst")
    links = stored(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(rounds):
        both = links.union(links.select("v", "u"))
        large = stored(both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        met = large.join(_least(large), "u")
        new = stored(met.select("u", F.col("m").alias("v")).union(met.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        settled = new.count() == links.count() and new.join(links, ["u", "v"], "left_anti").isEmpty()
        links = new
        if settled:
            break
    else:
        raise ValueError(f"components aren't settled after {rounds} rounds")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def _least(links: DataFrame) -> DataFrame:
    """u, m: the smallest of each node and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
