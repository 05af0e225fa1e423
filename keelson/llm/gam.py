"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in a cycle over the features, each on one feature's bins, so what a
feature adds is a lookup table in the end. Then the pairs of features that explain most of what is
left get tables of two dimensions the same way. A score is a sum of table entries: bins are looked
up and added for whole batches. Features are measured on the text alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Words, importable, lean, mix64, own_names, span_hashes, steps, text_buffer, window_hashes

#: Labelled rows that a model learns from at most: those of the smallest hash of their id.
MOST_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
CYCLES, PAIR_CYCLES, PAIRS, LEAVES, RATE = 120, 40, 8, 3, 0.15

#: The byte classes that are counted.
_CLASSES: dict[str, bytes] = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "symbol": b"#*$%&|<>@^~=+_\\/{}[]",
    "bar": b"|",
    "bang": b"!",
    "stop": b".,;:?",
    "wide": bytes(range(128, 256)),
}
FEATURES = ("words", "word_length", "upper", "digit", "symbol", "bar", "bang", "stop", "wide", "again", "unique", "windows", "lines", "dup_lines", "line_words", "wide_upper")


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(float)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Different keys of each text."""
    if not len(keys):
        return np.zeros(n)
    order = np.argsort(mix64(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    k, o = keys[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def measure(column: pa.Array) -> np.ndarray:
    """Features of each text, a row of FEATURES each; a null text measures as an empty one."""
    data, offsets = text_buffer(column)
    n, w = len(column), Words(data, offsets)
    h, owner = w.hashes(), w.owner()
    count = np.diff(w.first).astype(float)
    some, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1)
    of = {}
    for k, members in _CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        of[k] = _per_text(table[data], offsets)
    wide_upper = np.zeros(len(data), bool)
    if len(data) > 1:
        wide_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    inside = np.flatnonzero(owner[7:] == owner[:-7]) if len(h) > 7 else np.zeros(0, int)
    windows = window_hashes(h, 8)[inside]
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    line_owner = np.repeat(np.arange(n), np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n)[:n] + 1)
    full = ends > starts
    lines, line_owner = span_hashes(data, starts[full], ends[full]), line_owner[full]
    n_lines, n_windows = np.bincount(line_owner, minlength=n).astype(float), np.maximum(count - 7, 0)
    letters = np.maximum(of["upper"] + of["lower"], 1)
    return np.stack(
        [
            np.log1p(count),
            _per_text(w.ends - w.starts, w.first) / some,
            of["upper"] / letters,
            of["digit"] / size,
            of["symbol"] / some,
            of["bar"] / some,
            of["bang"] / some,
            of["stop"] / some,
            of["wide"] / size,
            _per_text(same, w.first) / some,
            _distinct(h, owner, n) / np.sqrt(some),
            1 - _distinct(windows, owner[inside], n) / np.maximum(n_windows, 1) * (n_windows > 0) - (n_windows == 0),
            np.log1p(n_lines),
            (n_lines - _distinct(lines, line_owner, n)) / np.maximum(n_lines, 1),
            count / np.maximum(n_lines, 1),
            _per_text(wide_upper, offsets) / np.maximum(of["wide"] / 2, 1),
        ],
        axis=1,
    )


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for p in self.pairs for j in p[:2]}
        for a, b, t in self.pairs:
            total += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float = 5.0) -> np.ndarray:
    """Leaf values of a small tree over ordered bins with gradient sums g and curvature sums h."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                win = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(win.argmax())
                best = max(best, (float(win[k]), int(m[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float = 5.0) -> tuple[float, np.ndarray]:
    """The best tree that cuts each of two features once: its gain and its table."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarter = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gs, hs = quarter(cg), quarter(ch)
    win = sum(a**2 / (b + smooth) for a, b in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(win.argmax()), win.shape)
    v = [a[i, j] / (b[i, j] + smooth) for a, b in zip(gs, hs, strict=True)]
    table = np.empty(g.shape)
    table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = v
    return float(win[i, j]), table


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels y (0 or 1); without rows it scores 0.5, with one label close to that."""
    k = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, j], BINS) if len(y) else np.zeros(0) for j in range(k)]
    coarse = [_edges(x[:, j], PAIR_BINS) if len(y) else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if not len(y):
        return Model(0.0, edges, tables, coarse, [])
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(CYCLES):
        for j in range(k):
            g, h = slopes()
            n = len(tables[j])
            step = RATE * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), LEAVES)
            tables[j] += step
            total += step[at[j]]
    low = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    shape = lambda a, b: (len(coarse[a]) + 1, len(coarse[b]) + 1)

    def grid(a, b):
        n, m = shape(a, b)
        cell = low[a] * m + low[b]
        g, h = slopes()
        return np.bincount(cell, g, n * m).reshape(n, m), np.bincount(cell, h, n * m).reshape(n, m)

    ranked = sorted(((_quadrants(*grid(a, b))[0], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)
    pairs = [(a, b, np.zeros(shape(a, b))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_CYCLES):
        for a, b, table in pairs:
            step = RATE * _quadrants(*grid(a, b))[1]
            table += step
            total += step[low[a], low[b]]
    return Model(base, edges, tables, coarse, pairs)


def _measured(batches):
    for batch in batches:
        for a, b in steps(batch.column(1), STEP_BYTES):
            part = batch.slice(a, b - a)
            x = measure(part.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["id", "x"])


def held_out(name: str = "id"):
    """Rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", most: int = MOST_ROWS) -> Model:
    """A model from the labelled rows of df that aren't held out, at most `most` of them."""
    texts = own_names(df, id=id_col, text=text_col)
    chosen = own_names(labels, id=label_id, y=label_col).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out()).orderBy(F.xxhash64("id"), "id", "y").limit(most)
    known = texts.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    rows = known.mapInArrow(lean(_measured), f"id {texts.schema['id'].dataType.simpleString()}, x array<double>").join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "x").limit(most).select("x", "y").collect()
    return fit(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([float(r["y"]) for r in rows]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: one row per row of df, in the same partitions.

    Null and empty texts are scored as texts without words. Equal texts get equal scores whatever
    their ids; other columns are ignored."""
    texts = own_names(df, id=id_col, text=text_col)

    def run(batches):
        for batch in batches:
            for a, b in steps(batch.column(1), STEP_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(measure(part.column(1).cast(pa.binary()))))], names=["id", "score"])

    return texts.mapInArrow(lean(run), f"id {texts.schema['id'].dataType.simpleString()}, score double")


def keep(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that the model calls good (0.5 or more), with all their columns."""
    importable(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b in steps(batch.column(at), STEP_BYTES):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(measure(part.column(at).cast(pa.binary()))) >= 0.5))

    return df.mapInArrow(lean(run), df.schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
