"""BEST and TOP(k) under conditional preferences.

For the comparisons that leave the same attributes free, the tuples that could beat others are
reduced to the values of the other attributes (on the map side first), with a flag per comparison,
and joined back: no pair of tuples is formed, and a hot value costs its tasks one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..prefs.theory import Comparison, Theory
from .checkpoints import checkpointed


def flagged(rows: DataFrame, theory: Theory, names: list[str], within: list[str], mask: str | None = None, by_mask: dict | None = None) -> DataFrame:
    """rows with `_beaten`: whether another row of the same `within` beats it.

    With mask, a row follows the theory by_mask[its mask] instead (rows of one `within` share it)."""
    groups: dict[frozenset[str], list[tuple[Comparison, Theory, object]]] = {}
    for key, t in (by_mask or {None: theory}).items():
        for c in t.comparisons:
            groups.setdefault(c.free & frozenset(names), []).append((c, t, key))
    of = lambda a: F.col(f"`{a}`")
    out, beaten = rows, []
    for g, (free, members) in enumerate(sorted(groups.items(), key=lambda x: sorted(x[0]))):
        keys = [*within, *(n for n in names if n not in free)]
        alike = lambda key: F.lit(True) if key is None else F.col(mask) == F.lit(key)
        tests = [t.test(c.best, of) & alike(key) for c, t, key in members]
        best = rows.filter(reduce(Column.__or__, tests)).groupBy(*(F.col(f"`{k}`").alias(f"_k{g}_{i}") for i, k in enumerate(keys))).agg(*(F.max(x).alias(f"_b{g}_{i}") for i, x in enumerate(tests)))
        same = reduce(Column.__and__, (F.col(f"`{k}`").eqNullSafe(F.col(f"_k{g}_{i}")) for i, k in enumerate(keys)))
        worst = [t.test(c.worst, of) & alike(key) for c, t, key in members]
        # Only rows that could lose look for a winner.
        out = out.join(best, same & reduce(Column.__or__, worst), "left")
        beaten += [F.coalesce(F.col(f"_b{g}_{i}"), F.lit(False)) & w for i, w in enumerate(worst)]
        out = out.withColumn(f"_lost{g}", reduce(Column.__or__, beaten[-len(members) :])).drop(*best.columns)
    lost = reduce(Column.__or__, (F.col(f"_lost{g}") for g in range(len(groups))), F.lit(False))
    return out.withColumn("_beaten", lost).drop(*(f"_lost{g}" for g in range(len(groups))))


def best(rows: DataFrame, theory: Theory, names: list[str], within: list[str] = ["_TS"]) -> DataFrame:  # noqa: B006
    """The rows that no other row of their instant beats; equal rows stay or go together."""
    return flagged(rows, theory, names, within).filter(~F.col("_beaten")).drop("_beaten")


def top(rows: DataFrame, theory: Theory, names: list[str], k: int, within: list[str] = ["_TS"]) -> DataFrame:  # noqa: B006
    """k rows of each instant: the best, then the best of the rest, and so on; within the last
    level, rows of the smallest values. Each round takes a level of the instants that still lack rows."""
    if k <= 0:
        return rows.limit(0)
    left, taken, level = rows, None, 0
    while True:
        judged = checkpointed(flagged(left, theory, names, within))
        here = judged.filter(~F.col("_beaten")).drop("_beaten").withColumn("_level", F.lit(level))
        taken = here if taken is None else taken.unionByName(here)
        full = taken.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select(*within)
        left = judged.filter("_beaten").drop("_beaten").join(full, within, "left_anti")
        if left.isEmpty():
            break
        level += 1
    place = Window.partitionBy(*within).orderBy("_level", *(f"`{c}`" for c in rows.columns if c not in within))
    return taken.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_level", "_place")
