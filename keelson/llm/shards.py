"""Contiguous shards of near equal bytes.

Rows stand in the order of the first id that has their text, so equal texts are neighbours. Byte
totals per partition, summed up in order, give every row the bytes before it; shards begin at equal
targets of that sum. A cut that falls among equal texts moves to their nearer end if together they
are small beside a shard; larger groups are split, so sizes stay near equal whatever the copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, running_totals

SHARDS = 24
#: Bytes that a row takes beside its text.
OVERHEAD = 8
#: Groups of equal texts up to this part of a shard are kept whole.
WHOLE = 0.01


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot: one row per row of df, slots from 0 without gaps.

    A null text has no bytes and goes with the empty ones. Rows of null ids come first; rows of
    equal ids are all placed. With fewer rows than shards some shards stay empty; an empty table
    gives an empty result. Other columns are ignored."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    thin = own_names(df, id=id_col, text=text_col).select("id", (F.length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2"))
    same = thin.groupBy("h1", "h2").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "lead")
    led = thin.join(same, ["h1", "h2"], "left").withColumn("lead", F.coalesce("lead", "id")).withColumn("one", F.lit(1).cast("long"))
    rows = running_totals(led, ["lead", "h1", "h2", "id"], ["size", "one"])
    total = rows.agg(F.max(F.col("before_size") + F.col("size"))).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    ahead = F.col("before_size")
    # The group at each cut: one row per cut at most.
    marks = F.array(*(F.lit(t).cast("long") for t in targets)) if targets else F.array().cast("array<bigint>")
    at = rows.withColumn("cut", F.explode(F.filter(marks, lambda t: (t >= ahead) & (t < ahead + F.col("size"))))) .select("cut", "h1", "h2")
    groups = rows.join(F.broadcast(at), ["h1", "h2"]).groupBy("cut").agg(F.min("before_size").alias("a"), F.max(ahead + F.col("size")).alias("b")).collect()
    moved = {r["cut"]: min((r["a"], r["b"]), key=lambda x: abs(x - r["cut"])) for r in groups if r["b"] - r["a"] <= max(WHOLE * total / shards, 0)}
    cuts = sorted(moved.get(t, t) for t in targets)
    placed = rows.withColumn("shard", sum((F.when(ahead >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0))
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("before_one")).collect()}
    begin = F.array(*(F.lit(first.get(k, 0)).cast("long") for k in range(shards)))
    return placed.select("id", "size", "text_crc32", "shard", (F.col("before_one") - F.element_at(begin, F.col("shard") + 1)).alias("slot"))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
