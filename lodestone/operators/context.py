"""Context assembly: append-only prefixes, their cost with eviction, and the cost of rebuilding."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.seal import seal

COSTS = "session string, turns long, prefill long, invalidations long, peak long"


def plan_append(retrieved: list[str], emitted: list[str]) -> dict[str, list[str]]:
    """What to append in order, without repeats, and what the prefix holds already."""
    held = set(emitted)
    fresh = list(dict.fromkeys(r for r in retrieved if r not in held))
    return {"append": fresh, "suppressed": list(dict.fromkeys(r for r in retrieved if r in held)), "prefix": seal("session-prefix", {"emitted": emitted + fresh})}


def append_sets(retrieved: DataFrame, emitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for many sessions: (to append, suppressed) of (session, record) rows."""
    key = ["session", "record"]
    r = retrieved.dropDuplicates(key)
    return r.join(emitted, key, "left_anti"), r.join(emitted, key, "left_semi")


def rebuild_cost(turns: DataFrame) -> DataFrame:
    """Costs if each turn's context is built anew from (session, turn, record, cost): plain aggregates."""
    each = turns.dropDuplicates(["session", "turn", "record"]).groupBy("session", "turn").agg(F.sum("cost").alias("tokens"))
    return each.groupBy("session").agg(F.count("*").alias("turns"), F.sum("tokens").alias("prefill"), F.lit(0).cast("long").alias("invalidations"), F.max("tokens").alias("peak"))


def append_cost(turns: DataFrame) -> DataFrame:
    """Costs of append-only assembly without a budget: each record is paid for at its first turn."""
    first = turns.groupBy("session", "record").agg(F.min("turn").alias("turn"), F.max("cost").alias("cost"))
    sums = first.groupBy("session").agg(F.sum("cost").alias("prefill"))
    n = turns.groupBy("session").agg(F.countDistinct("turn").alias("turns"))
    return n.join(sums, "session").select("session", "turns", "prefill", F.lit(0).cast("long").alias("invalidations"), F.col("prefill").alias("peak"))


def _simulate(budget: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A session in order of turns: the oldest records leave when the budget is passed, and the rest is paid again."""
        held: deque[tuple[str, int]] = deque()
        inside: set[str] = set()
        used = prefill = invalidations = peak = 0
        for _, turn in rows.sort_values(["turn", "place", "record"]).groupby("turn", sort=True):
            added = 0
            for record, cost in zip(turn["record"], turn["cost"], strict=True):
                if record not in inside:
                    held.append((record, int(cost)))
                    inside.add(record)
                    added += int(cost)
            used += added
            if used > budget:
                invalidations += 1
                while held and used > budget:
                    gone, cost = held.popleft()
                    inside.discard(gone)
                    used -= cost
                prefill += used
            else:
                prefill += added
            peak = max(peak, used)
        return pd.DataFrame([{"session": rows["session"].iloc[0], "turns": rows["turn"].nunique(), "prefill": prefill, "invalidations": invalidations, "peak": peak}])

    return run


def append_cost_with_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The fold with eviction, one session at a time: it depends on order, so it cannot be an aggregate."""
    t = turns.select(F.col("session").cast("string").alias("session"), "turn", F.col("record").cast("string").alias("record"), F.col("cost").cast("long").alias("cost"), (F.col("place") if "place" in turns.columns else F.lit(0)).alias("place"))
    return t.groupBy("session").applyInPandas(_simulate(budget), COSTS)
