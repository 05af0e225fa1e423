"""A session: registered tables, streams and queries over one timeline 0..last."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang import ast
from .lang.parser import parse_environment, parse_query
from .lang.tokens import LanguageError
from .operators import sequences as seq
from .operators import windows
from .plans.planner import Leaf, Planner
from .sources.csv import read_csv, write_csv


class Session:
    """Register sources, then ask queries. Names are read without regard to case.

    A query's result may be the source of later ones: of a SELECT, as a table; of ISTREAM, DSTREAM
    or RSTREAM, as a stream."""

    def __init__(self, spark: SparkSession, last: int = 10, delimiter: str = ",") -> None:
        self.spark, self.last, self.delimiter = spark, last, delimiter
        self.leaves: dict[str, Leaf] = {}
        self.results: dict[str, DataFrame] = {}
        self.outputs: dict[str, tuple[str, bool]] = {}
        self.texts: dict[str, str] = {}

    def _new(self, name: str) -> str:
        if name.upper() in self.leaves:
            raise LanguageError(f"{name.upper()} is registered already")
        return name.upper()

    @staticmethod
    def _attributes(attributes: list[str]) -> list[str]:
        names = [a.upper() for a in attributes]
        if twice := {n for n in names if names.count(n) > 1}:
            raise LanguageError(f"attributes named twice: {', '.join(sorted(twice))}")
        return names

    @staticmethod
    def _typed(df: DataFrame, attribute: str, name: str) -> Column:
        """A column in the language's types: INTEGER is a long, FLOAT a double, whatever their width."""
        wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
        c, kind = F.col(f"`{attribute}`"), dict(df.dtypes)[attribute]
        return (c.cast(wide[kind]) if kind in wide else c).alias(name)

    def register_stream(self, name: str, df: DataFrame, attributes: list[str], ts: str = "_TS", order: str | None = None) -> None:
        """An append-only stream: instants in `ts`; `order` tells which of two tuples came later."""
        names, ord_ = self._attributes(attributes), F.col(f"`{order}`") if order else F.monotonically_increasing_id()
        rows = df.select(F.col(f"`{ts}`").cast("long").alias("_TS"), *(self._typed(df, a, n) for a, n in zip(attributes, names, strict=True)), ord_.alias("_ORD"))
        name = self._new(name)
        self.leaves[name] = Leaf(name, "STREAM", names, rows)

    def register_table(self, name: str, df: DataFrame, attributes: list[str], ts: str = "_TS", flag: str = "_FL", order: str | None = None) -> None:
        """A table by its log of insertions and deletions."""
        names, ord_ = self._attributes(attributes), F.col(f"`{order}`") if order else F.monotonically_increasing_id()
        log = df.select(F.col(f"`{ts}`").cast("long").alias("_TS"), F.col(f"`{flag}`").alias("_FL"), *(self._typed(df, a, n) for a, n in zip(attributes, names, strict=True)), ord_.alias("_ORD"))
        name = self._new(name)
        self.leaves[name] = Leaf(name, "TABLE", names, windows.changelog(log, names))

    def register_relation(self, name: str, df: DataFrame, attributes: list[str]) -> None:
        """A table whose rows are there at every instant."""
        names = self._attributes(attributes)
        rows = df.select(*(self._typed(df, a, n) for a, n in zip(attributes, names, strict=True)), F.lit(0).cast("long").alias("_vfrom"), F.lit(None).cast("long").alias("_vto"))
        name = self._new(name)
        self.leaves[name] = Leaf(name, "TABLE", names, rows, always=True)

    def register_csv(self, kind: str, name: str, attributes: list[tuple[str, str]], path: str) -> None:
        """A file; rows that come late (below an instant already read) are skipped."""
        attributes = [(a.upper(), t.upper()) for a, t in attributes]
        rows = windows.in_order(read_csv(self.spark, path, attributes, kind == "TABLE", self.delimiter))
        names = [a for a, _ in attributes]
        if kind == "TABLE":
            self.register_table(name, rows, names, order="_ORD")
        else:
            self.register_stream(name, rows, names, order="_ORD")

    def query(self, text: str) -> DataFrame:
        """A query's result by instant: `_TS` first."""
        return Planner(self.leaves, self.last).plan(parse_query(text))[0]

    def register_query(self, name: str, text: str, output: str | None = None, changes: bool = False) -> DataFrame:
        name = self._new(name)
        result, kind = Planner(self.leaves, self.last).plan(parse_query(text))
        names = [c for c in result.columns if c != "_TS"]
        rows = result.withColumn("_ORD", F.monotonically_increasing_id()) if kind == "STREAM" else result
        self.leaves[name] = Leaf(name, kind, names, rows, view=kind == "TABLE")
        self.results[name], self.texts[name] = result, text
        if output:
            self.outputs[name] = (output, changes)
        result.createOrReplaceTempView(name.lower())
        return result

    def changes(self, name: str) -> DataFrame:
        """What each instant adds to and takes from a query's result: `_TS`, `_FL`, attributes."""
        result = self.results[name.upper()]
        return windows.changes(result, [c for c in result.columns if c != "_TS"], last=self.last)

    def statistics(self, text: str) -> DataFrame:
        """Per instant, how many sequences a sequence query compares and keeps, and how long."""
        q = parse_query(text)
        if not isinstance(q, ast.Sequences) or not q.rules:
            raise LanguageError("statistics are of sequence queries with preferences")
        before, ids, names = Planner(self.leaves, self.last).sequence_table(q)
        after = seq.best_sequences(before, q.rules, ids, names) if q.top is None else seq.top_sequences(before, q.rules, ids, names, q.top)
        return seq.statistics(before, after, self.last)

    def explain_preferences(self, text: str) -> DataFrame:
        """The comparisons that a query's preferences come to, one row each."""
        from .prefs.theory import Theory

        q = parse_query(text)
        rules = q.first.rules if isinstance(q, ast.Bag) else q.rules
        names = sorted({n for r in rules for n in (r.best.name, *r.indifferent, *(c.name for c in r.condition if c.name))})
        t = Theory(list(rules), names)
        show = lambda sets: " AND ".join(f"{a} in {sorted(s)} of {t.bounds[a]}" for a, s in sets)
        return self.spark.createDataFrame([(show(c.best), show(c.worst), ", ".join(sorted(c.free))) for c in t.comparisons], "best string, worst string, free string")

    def load(self, path: str) -> None:
        """An environment file; its paths are taken from its folder unless they are absolute."""
        here = os.path.dirname(os.path.abspath(path))
        at = lambda p: p if os.path.isabs(p) or "://" in p else os.path.join(here, p)
        with open(path, encoding="utf-8") as f:
            entries = parse_environment(f.read())
        for e in sorted(entries, key=lambda e: e.kind == "QUERY"):
            if e.kind != "QUERY":
                self.register_csv(e.kind, e.name, list(e.attributes), at(e.input))
                continue
            with open(at(e.input), encoding="utf-8") as f:
                self.register_query(e.name, f.read(), at(e.output) if e.output else None, e.changes)

    def run(self) -> None:
        """Writes the outputs of all registered queries."""
        for name, (path, changed) in self.outputs.items():
            write_csv(self.changes(name) if changed else self.results[name], path, self.delimiter)
