"""Sequences: per identifier, the tuples of a window in order of their instants.

A table of sequences has `_TS`, the identifier, `_SEQ` (tells sequences of one instant apart) and
`_items`, an array of structs of the instant `ts` and the other attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.ast import Predicate, Rule
from ..lang.tokens import LanguageError
from ..prefs.theory import Theory
from .checkpoints import checkpointed
from .preference import flagged
from .windows import at_instants, windowed


#: A set of rules is the bits of a long.
MOST_RULES = 62


def sequences(stream: DataFrame, identifier: list[str], attributes: list[str], size: int | None, slide: int, last: int) -> DataFrame:
    """SEQ. Of several tuples of an identifier at one instant the last by `_ORD` counts."""
    others = [a for a in attributes if a not in identifier]
    ids = [f"`{i}`" for i in identifier]
    one = stream.groupBy("_TS", *ids).agg(F.max_by(F.struct(F.col("_TS").cast("long").alias("ts"), *(f"`{a}`" for a in others)), "_ORD").alias("_item"))
    seen = at_instants(windowed(one, size, slide), last)
    return seen.groupBy("_TS", *ids).agg(F.sort_array(F.collect_list("_item")).alias("_items")).withColumn("_SEQ", F.lit(0).cast("long"))


def _keys(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns if c not in ("_items", "_SEQ")]


def consecutive(df: DataFrame) -> DataFrame:
    """CONSEQ: the longest runs of instants that follow each other."""
    flat = df.select(*_keys(df), F.posexplode("_items").alias("_p", "_item"))
    runs = flat.groupBy(*_keys(df), (F.col("_item.ts") - F.col("_p")).alias("_SEQ"))
    return runs.agg(F.sort_array(F.collect_list("_item")).alias("_items")).select(*_keys(df), "_items", F.col("_SEQ").cast("long"))


def suffixes(df: DataFrame) -> DataFrame:
    """ENDSEQ: what is left of each sequence from any of its positions on."""
    n = F.size("_items")
    out = df.select(*_keys(df), "_SEQ", "_items", F.explode(F.sequence(F.lit(1), n)).alias("_from"))
    return out.select(*_keys(df), F.expr("slice(_items, _from, size(_items) - _from + 1)").alias("_items"), F.xxhash64("_SEQ", "_from").alias("_SEQ"))


def of_length(df: DataFrame, least: int | None, most: int | None) -> DataFrame:
    """MINSEQ and MAXSEQ."""
    if least is not None:
        df = df.filter(F.size("_items") >= least)
    return df if most is None else df.filter(F.size("_items") <= most)


def flat(df: DataFrame, identifier: list[str], attributes: list[str]) -> DataFrame:
    """`_TS`, `_POS` from 1, and the attributes: identifier first."""
    others = [a for a in attributes if a not in identifier]
    rows = df.select("_TS", *(f"`{i}`" for i in identifier), F.posexplode("_items").alias("_p", "_item"))
    return rows.select("_TS", (F.col("_p") + 1).alias("_POS"), *(f"`{i}`" for i in identifier), *(F.col("_item").getField(a).alias(a) for a in others))


class TemporalTheory:
    """Rules whose conditions may speak of the past; for each set of rules that some past allows, a
    theory. The pasts of rules are tested on the array of earlier items."""

    def __init__(self, rules: tuple[Rule, ...], names: list[str]) -> None:
        self.rules, self.names, self.theories = rules, names, {}
        for r in rules:
            Theory([r], names)
            for p in r.condition:
                if p.past and p.past != "FIRST" and p.name not in names:
                    raise LanguageError(f"unknown attribute {p.name}")
        if len(rules) > MOST_RULES:
            raise LanguageError(f"more than {MOST_RULES} temporal rules")
        # Where the past of one rule holds, so do those of the rules that ask for no more: together
        # they must be consistent, whatever the data.
        pasts = [frozenset(p for p in r.condition if p.past) for r in rules]
        for past in set(pasts):
            Theory([r for r, other in zip(rules, pasts, strict=True) if other <= past], names)

    def allowed(self, r: Rule, past: Column) -> Column:
        """Whether the past allows a rule. What it says of an attribute last counts; all that SOME
        PREVIOUS asks for must hold at one position."""
        asked: dict[str, dict[str, Predicate]] = {}
        for p in r.condition:
            if p.past:
                asked.setdefault(p.past, {})[p.name] = p
        holds = lambda ps, x: _all(_within(p, x.getField(p.name)) for p in ps.values())
        tests = []
        if "FIRST" in asked:
            tests.append(F.size(past) == 0)
        if "PREVIOUS" in asked:
            tests.append((F.size(past) > 0) & F.coalesce(holds(asked["PREVIOUS"], F.try_element_at(past, F.lit(-1))), F.lit(False)))
        if "SOME" in asked:
            tests.append(F.exists(past, lambda x: F.coalesce(holds(asked["SOME"], x), F.lit(False))))
        if "ALL" in asked:
            tests.append((F.size(past) > 0) & F.forall(past, lambda x: F.coalesce(holds(asked["ALL"], x), F.lit(False))))
        return _all(tests)

    def mask(self, past: Column) -> Column:
        return sum((F.when(self.allowed(r, past), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(self.rules)), F.lit(0)).cast("long")

    def of(self, mask: int) -> Theory:
        if mask not in self.theories:
            self.theories[mask] = Theory([r for i, r in enumerate(self.rules) if mask >> i & 1], self.names)
        return self.theories[mask]


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _within(p: Predicate, x: Column) -> Column:
    out = F.lit(True)
    if p.low is not None:
        out = out & (x > F.lit(p.low) if p.low_open else x >= F.lit(p.low))
    if p.high is not None:
        out = out & (x < F.lit(p.high) if p.high_open else x <= F.lit(p.high))
    return out


def judged(df: DataFrame, rules: tuple[Rule, ...], identifier: list[str], attributes: list[str]) -> DataFrame:
    """Sequences with `_beaten`.

    Two sequences are compared where they first differ: positions are grouped by all that is before
    them, and at each the rules that this past allows decide between the items."""
    others = [a for a in attributes if a not in identifier]
    theory = TemporalTheory(rules, others)
    keys = [*(c for c in df.columns if c != "_items")]
    quoted = [f"`{k}`" for k in keys]
    plain = F.transform("_items", lambda x: F.struct(*(x.getField(a).alias(a) for a in others)))
    at = df.select(*quoted, plain.alias("_plain")).select(*quoted, "_plain", F.posexplode("_plain").alias("_p", "_item"))
    at = at.select(*quoted, F.expr("slice(_plain, 1, _p)").alias("_past"), *(F.col("_item").getField(a).alias(f"@{a}") for a in others))
    at = checkpointed(at.withColumn("_mask", theory.mask(F.col("_past"))))
    masks = [r[0] for r in at.filter("_mask <> 0").select("_mask").distinct().collect()]  # sets of rules; their number depends on the pasts that rules tell apart
    if not masks:
        return df.withColumn("_beaten", F.lit(False))
    renamed = at.filter("_mask <> 0").withColumnsRenamed({k: f"#{k}" for k in identifier}).withColumnsRenamed({f"@{a}": a for a in others})
    lost = flagged(renamed, None, others, ["_TS", "_past"], "_mask", {m: theory.of(m) for m in masks}).filter("_beaten")
    lost = lost.withColumnsRenamed({f"#{k}": k for k in identifier}).select(*quoted).distinct().withColumn("_lost", F.lit(True))
    mine, theirs = df.alias("x"), lost.withColumnsRenamed({k: f"_l_{k}" for k in keys})
    same = _all(F.col(f"`{k}`").eqNullSafe(F.col(f"`_l_{k}`")) for k in keys)
    return mine.join(theirs, same, "left").select(*quoted, "_items", F.coalesce("_lost", F.lit(False)).alias("_beaten"))


def best_sequences(df: DataFrame, rules: tuple[Rule, ...], identifier: list[str], attributes: list[str]) -> DataFrame:
    return judged(df, rules, identifier, attributes).filter(~F.col("_beaten")).drop("_beaten")


def top_sequences(df: DataFrame, rules: tuple[Rule, ...], identifier: list[str], attributes: list[str], k: int) -> DataFrame:
    """k sequences of each instant, level by level; in the last level those of the smallest
    identifier, then of the smallest items."""
    from pyspark.sql import Window

    if k <= 0:
        return df.limit(0)
    left, taken, level = df, None, 0
    while True:
        now = checkpointed(judged(left, rules, identifier, attributes))
        here = now.filter(~F.col("_beaten")).drop("_beaten").withColumn("_level", F.lit(level))
        taken = here if taken is None else taken.unionByName(here)
        full = taken.groupBy("_TS").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("_TS")
        left = now.filter("_beaten").drop("_beaten").join(full, "_TS", "left_anti")
        if left.isEmpty():
            break
        level += 1
    place = Window.partitionBy("_TS").orderBy("_level", *(f"`{i}`" for i in identifier), "_items")
    return taken.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= k).drop("_level", "_place")


def statistics(before: DataFrame, after: DataFrame, last: int) -> DataFrame:
    """Per instant, the number of sequences and their least, largest and (whole) mean length, going
    in and coming out; -1 where there are none."""
    def of(df: DataFrame, name: str) -> DataFrame:
        n = F.size("_items").cast("long")
        return df.groupBy("_TS").agg(F.count(F.lit(1)).alias(name), F.min(n).alias(f"{name}_min"), F.max(n).alias(f"{name}_max"), F.floor(F.sum(n) / F.count(F.lit(1))).alias(f"{name}_avg"))

    line = before.sparkSession.range(last + 1).withColumnRenamed("id", "_TS")
    both = line.join(of(before, "in"), "_TS", "left").join(of(after, "out"), "_TS", "left")
    return both.select("_TS", *(F.coalesce(F.col(f"`{c}`"), F.lit(0 if c in ("in", "out") else -1).cast("long")).alias(c) for c in both.columns[1:]))
