"""Quality rules by weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (-1) or abstains (0). Votes are counted by pattern, at most 3 to the
number of rules, and expectation-maximisation over those counts estimates how often each rule votes
what in good and in bad texts, its accuracies, and the share of good texts. It starts from how many
rules object to a text, the same for all rules, and nothing holds an estimate. Most faults
are seen by two rules that measure different things: that they agree is what tells a fault from a
kind of good text. A text's posterior of being good then decides, not a demand that every rule pass.
The measures are made once and kept in the checkpoint folder: the
patterns are counted from them and the verdicts drawn from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own_names

_WHITE = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
ROUNDS = 200
#: EM starts from these probabilities of being good, by the number of bad votes: none, one, more.
START = (0.95, 0.5, 0.05)
#: EM ends when the share of good texts moves by less.
STILL = 1e-9


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, an empty list for null."""
    solid = F.trim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, _GAP))


def base_measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides.

    Lists that a lambda reads stand in a projection of their own and are named more than once, so
    that they are made once a row and not once an element."""
    t = own_names(df, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size_of = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    t = t.select(
        "id",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(_WHITE)) != "").alias("lines"),
        size_of(_GAP).cast("long").alias("word_chars"),
        size_of(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        size_of(r"[^A-ZÀ-ÖØ-Þ]+").cast("long").alias("n_upper"),
        size_of(r"[^!]+").cast("long").alias("n_bang"),
        size_of(r"\P{L}+").cast("long").alias("n_letters"),
    )
    t = t.select(
        *("id", "word_chars", "n_symbols", "n_upper", "n_bang", "n_letters"),
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("codes"),
    )
    rest = [c for c in t.columns if c != "codes"]
    t = t.select(*rest, F.size(F.array_distinct("codes")).cast("long").alias("n_distinct"), "codes")
    rest = [c for c in t.columns if c != "codes"]
    t = t.select(*rest, F.when(F.size("codes") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("codes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("codes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("windows"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    t = t.select(*rest, F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    t = t.select(*rest, F.sort_array(F.transform(F.filter("sorted", lambda x, j: F.coalesce(F.get(F.col("sorted"), j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("sorted"), j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])).alias("at"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("at", zero, lambda a, x: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - x)).cast("long").alias("n"), (x + WINDOW).cast("long").alias("end")))
    return t.select(*rest, covered["n"].alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """Each rule: 1 good, -1 bad, 0 abstains. A text without words gets abstentions."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(F.col("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "symbols": rule(F.col("n_symbols") * 4 > n, F.col("n_symbols") * 50 <= n),
        "repeats": rule((F.col("n_repeat_words") * 5 > n) & (F.col("n_dup_lines") * 10 <= F.col("n_lines")), F.col("n_repeat_words") == 0),
        "lines": rule(F.col("n_dup_lines") * 5 > F.col("n_lines") * 2, F.col("n_dup_lines") == 0),
        "capitals": rule(F.col("n_upper") * 3 > F.col("word_chars"), F.col("n_upper") * 5 <= F.col("word_chars")),
        "shouts": rule(F.col("n_bang") * 2 > n, F.col("n_bang") * 20 <= n),
        "lengths": rule((F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20), F.col("word_chars").between(n * 3, n * 12)),
        # what the others measure by signs and windows, by letters and by different words
        "letters": rule(F.col("n_letters") * 10 < F.col("word_chars") * 9, F.col("n_letters") * 50 >= F.col("word_chars") * 47),
        "variety": rule((n >= 50) & (F.col("n_distinct") * F.col("n_distinct") < n * 16), F.col("n_distinct") * F.col("n_distinct") >= n * 36),
    }


def estimate(counts: dict[tuple[int, ...], int]) -> tuple[float, list[tuple[dict[int, float], dict[int, float]]]]:
    """EM over vote patterns: the share of good texts, and for each rule the probabilities of its
    votes in good and in bad texts. Estimates are smoothed by one imaginary text a vote; without
    texts all are even."""
    k = len(next(iter(counts), ()))
    soft = {p: START[min(p.count(-1), 2)] for p in counts}
    total, share, table = sum(counts.values()), 0.5, [({1: 1 / 3, 0: 1 / 3, -1: 1 / 3},) * 2] * k
    for _ in range(ROUNDS):
        old, sides = share, (soft, {p: 1 - x for p, x in soft.items()})
        good = [sum(n * side[p] for p, n in counts.items()) for side in sides]
        share = (good[0] + 1) / (total + 2)
        of = lambda j, v, side: sum(n * side[p] for p, n in counts.items() if p[j] == v)
        table = [tuple({v: (of(j, v, side) + 1) / (m + 3) for v in (1, 0, -1)} for side, m in zip(sides, good, strict=True)) for j in range(k)]
        soft = {p: posterior(share, table, p) for p in counts}
        if abs(share - old) < STILL:
            break
    return share, table


def posterior(share: float, table: list[tuple[dict[int, float], dict[int, float]]], pattern: tuple[int, ...]) -> float:
    """The probability that a text of these votes is good."""
    odds = math.log(share / (1 - share)) + sum(math.log(g[v] / b[v]) for v, (g, b) in zip(pattern, table, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, the base measures, each rule's vote, posterior, base_failed, kept.

    Null and empty texts have no words and fail the base. Whole texts are measured, however long.
    Rows of null or equal ids stay apart; repeated texts get equal verdicts; a posterior of just 0.5
    is kept. An empty table gives an empty result; other columns, whatever their names, are ignored."""
    rules = votes()
    n = F.col("n_words")
    measured = checkpointed(base_measures(df, id_col, text_col).select("*", *(v.alias(f"vote_{k}") for k, v in rules.items())).withColumn("base_failed", (n < 20) | (F.col("n_repeat_words") * 100 > n * 30)))
    names = [f"vote_{k}" for k in rules]
    counted = measured.groupBy(*names).count().limit(3 ** len(names)).collect()  # all patterns there can be
    share, table = estimate({tuple(r[x] for x in names): r["count"] for r in counted})
    odds = F.lit(math.log(share / (1 - share)))
    for name, (g, b) in zip(names, table, strict=bool(counted)):
        step = {v: math.log(g[v] / b[v]) for v in (1, -1, 0)}
        odds = odds + F.when(F.col(name) == 1, step[1]).when(F.col(name) == -1, step[-1]).otherwise(step[0])
    judged = measured.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
