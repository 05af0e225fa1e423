"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points, mapped through the cumulative shares of the sources, say which source fills
each slot. Within a source slots are ranked, and rank r takes block r of the source's shuffled,
endless stream of equal-token blocks. Points are exact 64-bit integers and the shuffle is a hash of
the id, so a rerun gives the same mix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, own_names, running_totals, small_table
from .rules import words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Slots of a schedule at most (one more per source); blocks are as long as that makes them.
SLOTS = 1 << 22
LEAST_BLOCK = 64
#: Sources that a mix may have; their table, one row each, is held by the driver.
MOST_SOURCES = 100_000
_GOLDEN = 0x9E3779B97F4A7C15
_CHUNK = 1 << 16


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Shares of `total` by weight; what a source can't take beyond `most` times its size is shared
    again by weight among the others, until none is above."""
    out, open_ = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}
    left = min(total, most * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= most * sizes[i]}
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        open_ -= full
    return out


class Plan:
    """What the driver knows of a mix: by source, its size, target and number of block visits."""

    def __init__(self, sources: list, sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> None:
        self.sources, self.sizes = sources, sizes
        self.targets = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], share * sum(sizes), most)
        self.words = [min(math.floor(t + 0.5), math.floor(most * n)) for t, n in zip(self.targets, sizes, strict=True)]
        self.block = max(LEAST_BLOCK, -(-sum(self.words) // SLOTS))
        self.blocks = [-(-n // self.block) for n in sizes]
        self.visits = [(w // n) * b + -(-(w % n) // self.block) if n else 0 for w, n, b in zip(self.words, sizes, self.blocks, strict=True)]
        self.offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).tolist()


def source_table(df: DataFrame) -> tuple[list, list[int]]:
    rows = df.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; name a coarser source column")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    return [r["source"] for r in rows], [int(r["n"]) for r in rows]


def schedule(df: DataFrame, plan: Plan) -> DataFrame:
    """slot, s (the source's number), epoch, block, words (the visit takes that many from the
    block's start). df only lends its session.

    Slots are made from a few chunk numbers, which Spark takes for a small table; the hints keep it
    from broadcasting them. Ranks come from counts per chunk of slots: a source of most slots is no task of its own. Visits
    that a source is short of when the points end are appended, source by source; slots that a
    source has too many of stay free."""
    spark, total = df.sparkSession, sum(plan.visits)
    # Where only sources without visits follow, the edge would be 2^64; a point at the clipped edge is a free slot.
    edges = np.array([min((c << 64) // max(total, 1), (1 << 64) - 1) for c in np.cumsum(np.array(plan.visits, object))][:-1], np.uint64)

    def points(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                i = np.arange(c * _CHUNK, min((c + 1) * _CHUNK, total), dtype=np.uint64)
                s = np.searchsorted(edges, i * np.uint64(_GOLDEN), "right")
                order = np.argsort(s, kind="stable")
                firsts = np.searchsorted(s[order], np.arange(len(plan.visits)))
                local = np.empty(len(s), np.int64)
                local[order] = np.arange(len(s)) - firsts[s[order]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), c)), pa.array(i.astype(np.int64)), pa.array(s.astype(np.int32)), pa.array(local)], names=["chunk", "slot", "s", "local"])

    chunks = -(-total // _CHUNK)
    slots = spark.range(0, chunks, 1, max(1, min(chunks, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(points, "chunk long, slot long, s int, local long")
    counts = slots.groupBy("chunk", "s").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("chunk", "s", (F.sum("n").over(Window.partitionBy("s").orderBy("chunk")) - F.col("n")).alias("earlier"))
    ranked = slots.hint("merge").join(before.hint("merge"), ["chunk", "s"]).select("slot", "s", (F.col("local") + F.col("earlier")).alias("rank"))
    got = {r["s"]: r["n"] for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    late, at = [], total
    for s, n in enumerate(plan.visits):
        if (have := got.get(s, 0)) < n:
            late.append((at, s, have, n))
            at += n - have
    if late:
        more = small_table(spark, late, "a long, s int, have long, n long").select(F.explode(F.expr("sequence(have, n - 1)")).alias("rank"), "a", "s", "have")
        ranked = ranked.unionByName(more.select((F.col("a") + F.col("rank") - F.col("have")).alias("slot"), "s", "rank"))
    known = F.broadcast(_of_sources(spark, plan))
    epoch, block = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    ahead = epoch * F.col("n") + block * plan.block
    length = F.least(F.lit(plan.block).cast("long"), F.col("n") - block * plan.block)
    return ranked.join(known, "s").filter("rank < visits").select("slot", "s", epoch.cast("long").alias("epoch"), block.alias("block"), F.least(length, F.col("w") - ahead).alias("words"))


def _of_sources(spark, plan: Plan) -> DataFrame:
    """The sources' numbers and figures: MOST_SOURCES rows at most."""
    rows = [(i, s, n, t, w, b, v, o) for i, (s, n, t, w, b, v, o) in enumerate(zip(plan.sources, plan.sizes, plan.targets, plan.words, plan.blocks, plan.visits, plan.offsets, strict=False))]
    return small_table(spark, rows, "s int, source string, n long, target double, w long, blocks long, visits long, offset long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, key_col: str | None = None) -> DataFrame:
    """id, size, source_size, target, taken: one row per row of df.

    Null and empty texts have no words and nothing is taken of them; a null source is a source of
    its own, the last. Rows of equal ids are all mixed; key_col, a key of each
    row, is told as key where it is given, and orders rows of one id. An empty table gives an empty result. Other
    columns are ignored."""
    keys = ["key"] if key_col else []
    thin = own_names(df, id=id_col, text=text_col, source=source_col, **dict.fromkeys(keys, key_col)).select("id", *keys, F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    thin = checkpointed(thin)
    plan = Plan(*source_table(thin), weights, share, most)
    known = F.broadcast(_of_sources(df.sparkSession, plan).select("s", F.col("source").alias("of"), "n", "target", "offset"))
    named = thin.join(known, F.col("source").eqNullSafe(F.col("of"))).select("s", F.xxhash64(F.lit(13), "id").alias("h"), "id", *keys, "size", "n", "target", "offset", F.lit(1).cast("long").alias("one"))
    rows = running_totals(named, ["s", "h", "id", "size", *keys], ["size", "one"])
    at = F.col("before_size") - F.col("offset")
    pieces = rows.select(F.col("before_one").alias("row"), "s", "id", *keys, "size", "n", "target", at.alias("at"), F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(at / plan.block), F.floor((at + F.col("size") - 1) / plan.block)))).alias("block"))
    used = schedule(df, plan).groupBy("s", "block").agg(F.collect_list("words").alias("visits"))
    low = F.greatest(F.col("at") - F.col("block") * plan.block, F.lit(0))
    high = F.least(F.col("at") + F.col("size") - F.col("block") * plan.block, F.lit(plan.block).cast("long"))
    taken = F.aggregate("visits", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0).cast("long"), F.least(F.col("high"), w) - F.col("low")))
    joined = pieces.withColumn("low", low).withColumn("high", high).hint("merge").join(used.hint("merge"), ["s", "block"], "left").withColumn("t", F.when(F.col("visits").isNotNull(), taken).otherwise(F.lit(0).cast("long")))
    return joined.groupBy("row").agg(F.first("id").alias("id"), *(F.first(k).alias(k) for k in keys), F.first("size").alias("size"), F.first("n").alias("source_size"), F.first("target").alias("target"), F.sum("t").alias("taken")).drop("row")


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.withColumnRenamed("id", "doc_id")
