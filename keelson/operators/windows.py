"""Streams and tables as validity intervals, and the relations they make at each instant.

A leaf has `_vfrom` and `_vto` (both included, `_vto` null for ever). Instants are made only when a
relation is asked for, by exploding the part of an interval that lies on the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_instant(ts: Column, size: int | None, slide: int) -> Column:
    """Until when a tuple of instant ts is seen: its slide's start plus the range, less one."""
    if size is None:
        return F.lit(None).cast("long")
    return (ts - F.pmod(ts, F.lit(slide)) + (size - 1)).cast("long")


def windowed(stream: DataFrame, size: int | None, slide: int = 1) -> DataFrame:
    """A stream (with `_TS`) as intervals. Where the range is shorter than the slide, tuples that
    come after their window's end are never seen."""
    out = stream.withColumn("_vfrom", F.col("_TS").cast("long")).withColumn("_vto", last_instant(F.col("_TS"), size, slide)).drop("_TS")
    return out if size is None else out.filter("_vfrom <= _vto")


def at_instants(intervals: DataFrame, last: int, first: int = 0) -> DataFrame:
    """The relation at each instant first..last: `_TS` and the attributes."""
    low, high = F.greatest(F.col("_vfrom"), F.lit(first)), F.least(F.col("_vto"), F.lit(last).cast("long"))
    rows = intervals.filter((F.col("_vfrom") <= last) & (F.coalesce(F.col("_vto"), F.lit(last)) >= first) & (F.col("_vfrom") <= F.coalesce(F.col("_vto"), F.col("_vfrom"))))
    return rows.select(F.explode(F.sequence(low, high)).alias("_TS"), *(f"`{c}`" for c in intervals.columns if c not in ("_vfrom", "_vto")))


#: Instants in a block of the timeline.
BLOCK = 64


def block(ts: Column) -> Column:
    return F.floor(ts / BLOCK)


def by_block(intervals: DataFrame, low: str, high: str, name: str, last: int) -> DataFrame:
    """Intervals once for each block of the timeline that they touch; its number in `name`."""
    end = F.least(F.coalesce(high, F.lit(last)), F.lit(last)).cast("long")
    start = F.greatest(F.col(low), F.lit(0)).cast("long")
    return intervals.filter(start <= end).withColumn(name, F.explode(F.sequence(block(start), block(end))))


def changelog(changes: DataFrame, names: list[str]) -> DataFrame:
    """A log of insertions (`_FL` +) and deletions (-) as intervals. `_ORD` is the log's order.

    A deletion takes one equal tuple, the oldest; one that finds none is ignored: with the running
    sum of signs and its least value so far, a deletion is void where that least value falls. The
    n-th insertion of a value meets its n-th effective deletion."""
    keys = [f"`{n}`" for n in names]
    by = Window.partitionBy(*keys).orderBy("_TS", "_ORD")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("_FL") == "+", 1).otherwise(-1)
    log = changes.withColumn("_sum", F.sum(sign).over(so_far))
    log = log.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(so_far)))
    log = log.withColumn("_before", F.coalesce(F.lag("_low").over(by), F.lit(0)))
    log = log.filter((F.col("_FL") == "+") | (F.col("_low") == F.col("_before")))
    nth = F.row_number().over(Window.partitionBy(*keys, "_FL").orderBy("_TS", "_ORD"))
    log = log.withColumn("_n", nth)
    gone = log.filter("_FL = '-'").select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), F.col("_n").alias("_gn"), (F.col("_TS") - 1).alias("_vto"))
    same = F.col("_n") == F.col("_gn")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    rows = log.filter("_FL = '+'").join(gone, same, "left")
    return rows.select(*keys, F.col("_TS").cast("long").alias("_vfrom"), F.col("_vto").cast("long"))


def in_order(rows: DataFrame) -> DataFrame:
    """Without the rows that come late: those whose `_TS` is below an earlier row's (by `_ORD`).

    Late rows are told per block of the order by the largest instant of the blocks before, so no
    task holds the whole log."""
    blocked = rows.withColumn("_blk", F.floor(F.col("_ORD") / 65536))
    tops = blocked.groupBy("_blk").agg(F.max("_TS").alias("_top"))
    before = tops.select("_blk", F.max("_top").over(Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_old"))
    inside = F.max("_TS").over(Window.partitionBy("_blk").orderBy("_ORD").rowsBetween(Window.unboundedPreceding, 0))
    return blocked.join(before, "_blk").withColumn("_high", F.greatest("_old", inside)).filter("_TS >= _high").drop("_blk", "_old", "_high")


def changes(relation: DataFrame, names: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """What each instant inserts (`_FL` +) and deletes (-) against the one before, as bags.

    One count per tuple and instant, and one shuffle: a count goes in with a plus at its instant
    and with a minus at the next."""
    keys = [f"`{n}`" for n in names]
    counted = relation.groupBy("_TS", *keys).agg(F.count(F.lit(1)).alias("_n"))
    later = counted.select((F.col("_TS") + 1).alias("_TS"), *keys, (-F.col("_n")).alias("_n"))
    net = counted.unionByName(later if last is None else later.filter(F.col("_TS") <= last)).groupBy("_TS", *keys).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return net.select("_TS", F.when(F.col("_n") > 0, "+").otherwise("-").alias("_FL"), *keys, F.explode(F.sequence(F.lit(1), F.abs("_n").cast("int"))).alias("_k")).drop("_k")


def istream(intervals: DataFrame, last: int) -> DataFrame:
    """Tuples at the instant they come."""
    return intervals.filter((F.col("_vfrom") <= last) & (F.coalesce(F.col("_vto"), F.lit(last)) >= F.col("_vfrom") - 1)).select(F.col("_vfrom").alias("_TS"), *_rest(intervals))


def dstream(intervals: DataFrame, last: int) -> DataFrame:
    """Tuples at the first instant they are no longer seen."""
    return intervals.filter(F.col("_vto") + 1 <= last).select((F.col("_vto") + 1).alias("_TS"), *_rest(intervals))


def rstream(intervals: DataFrame, last: int) -> DataFrame:
    """All tuples at each instant."""
    return at_instants(intervals, last)


def _rest(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in ("_vfrom", "_vto")]
