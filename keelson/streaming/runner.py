"""Continuous execution: one micro-batch after another, results per instant.

Leaves arrive as streams of rows with `_TS`. Instants are closed by a watermark without delay: a
batch that brings instant t closes all before t, and rows of a closed instant are dropped, as late
rows are in a batch run. Rows are kept in the state folder, by batch and instant, so a batch adds
files and reads only the instants that a window may still show (all of them only where a window is
unbounded, and for a table, whose log is the state). Each batch evaluates the plan of a batch run
over the instants that it closes, so any query of the language runs continuously, with BEST and
TOP(k) over a whole instant too. What was closed is written down after each batch: a restart goes on
from there, and at worst hands the sink a range of instants again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang import ast
from ..lang.parser import parse_query
from ..operators import windows
from ..plans.planner import Leaf, Planner


def _reach(tree) -> dict[str, int | None]:
    """By source: how many instants back a query may look; None for ever."""
    out: dict[str, int | None] = {}

    def note(s: ast.Source, w: ast.Window | None) -> None:
        size = None if w is None or w.range is None else w.range + w.slide
        old = out.get(s.name, 0)
        out[s.name] = None if size is None or old is None else max(old, size)

    def visit(x) -> None:
        if isinstance(x, ast.Bag):
            for q in (x.first, *(q for _, q in x.rest)):
                for s in q.sources:
                    note(s, s.window)
        elif isinstance(x, ast.ToStream):
            note(x.source, x.source.window)
        else:
            s = x.source.source if isinstance(x.source, ast.ToStream) else x.source
            inner = x.source.source.window if isinstance(x.source, ast.ToStream) else None
            wide = ast.Window(None) if x.window.range is None or inner and inner.range is None else ast.Window(x.window.range + (inner.range if inner else 0), x.window.slide)
            note(s, wide)

    visit(tree)
    return out


class Continuous:
    """Feeds one source of a query from a streaming DataFrame; other sources are the session's own.

    stream: `_TS`, `_FL` for a table's log, the attributes, and `_ORD` if the order of equal
    instants matters. sink(df, first, last) gets the result of each range of closed instants."""

    def __init__(self, spark: SparkSession, text: str, name: str, kind: str, attributes: list[str], leaves: dict[str, Leaf], state: str, sink: Callable[[DataFrame, int, int], None]) -> None:
        self.spark, self.tree, self.name, self.kind = spark, parse_query(text), name.upper(), kind
        self.attributes, self.leaves, self.state, self.sink = [a.upper() for a in attributes], dict(leaves), state, sink
        self.back = _reach(self.tree).get(self.name)
        #: The last batch, the last closed instant, and the largest instant seen.
        self.number, self.closed, self.top = self._recovered()

    def _recovered(self) -> tuple[int, int, int]:
        try:
            rows = self.spark.read.parquet(f"{self.state}/closed").orderBy(F.desc("number")).limit(1).collect()
        except AnalysisException:  # nothing was written yet
            return -1, -1, -1
        return (rows[0]["number"], rows[0]["closed"], rows[0]["top"]) if rows else (-1, -1, -1)

    def batch(self, rows: DataFrame, number: int) -> None:
        """For foreachBatch. A batch that comes again is ignored, or overwrites its own rows."""
        if number <= self.number:
            return
        rows = rows.filter(F.col("_TS") > self.closed)
        if "_ORD" not in rows.columns:
            rows = rows.withColumn("_ORD", F.monotonically_increasing_id() + F.lit(number << 48))
        rows = rows.persist()
        top = rows.agg(F.max("_TS")).first()[0]
        if top is not None:
            rows.write.mode("overwrite").partitionBy("_TS").parquet(f"{self.state}/rows/batch={number}")
            self.top = max(self.top, int(top))
            if self.top - 1 > self.closed:
                self._close(self.top - 1)
        rows.unpersist()
        self.number = number
        self.spark.createDataFrame([(number, self.closed, self.top)], "number long, closed long, top long").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/closed/batch={number}")

    def finish(self) -> None:
        """Closes the last instant that rows came for."""
        if self.top > self.closed:
            self._close(self.top)

    def _close(self, last: int) -> None:
        known = self.spark.read.parquet(f"{self.state}/rows").withColumn("_TS", F.col("_TS").cast("long"))
        known = known.filter(F.col("_TS") <= last)
        if self.kind == "STREAM" and self.back is not None:
            known = known.filter(F.col("_TS") > self.closed - self.back)
        names = ["_TS", *(["_FL"] if self.kind == "TABLE" else []), *self.attributes, "_ORD"]
        known = known.select(*(F.col(f"`{n}`") for n in names))
        held = known if self.kind == "STREAM" else windows.changelog(known, self.attributes)
        leaf = Leaf(self.name, self.kind, self.attributes, held)
        result, _ = Planner({**self.leaves, self.name: leaf}, last).plan(self.tree)
        first, self.closed = self.closed + 1, last
        self.sink(result.filter(F.col("_TS").between(first, last)), first, last)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).start()
