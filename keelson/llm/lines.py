"""Line dedup: drop lines whose normalised form stands in many documents.

Lines are cut at \\n, hashed (128 bits of the key) and reduced to one row per document and key
before anything is shuffled. Counting combines on the map side, so a line of every document costs
one row per task. Only the hashes of lines are joined with the frequent keys (a skewed join that
adaptive execution can split: nothing above it needs a key's rows together), and the texts are
shuffled once, by row, to meet the positions to drop."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, lean, lists, own_names, unused

MIN_DOCS = 10
MIN_POINTS = 1


def line_keys(text: bytes | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, ASCII letters in lower case."""
    return [x.strip(WHITE) for x in (text or b"").lower().split(b"\n")]


def _hashed(batches):
    """For each row: the distinct keys' hashes, two 64-bit halves."""
    for batch in batches:
        high, low, counts = [], [], []
        for text in batch.column(1).to_pylist():
            keys = {k for k in line_keys(text) if len(k) >= MIN_POINTS}
            for k in keys:
                x = xxhash.xxh3_128_intdigest(k)
                high.append(x >> 64)
                low.append(x & (1 << 64) - 1)
            counts.append(len(keys))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(lists(np.array(x, np.uint64).view(np.int64), np.array(counts, int), pa.int64()) for x in (high, low))], names=["id", "high", "low"])


def _kept(batches):
    for batch in batches:
        rows = []
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            if not drop:
                rows.append((len(lines), 0, text if text is not None else b""))
                continue
            gone = set(drop)
            kept = [x for x, k in zip(lines, line_keys(text), strict=True) if len(k) < MIN_POINTS or xxhash.xxh3_128_digest(k) not in gone]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
            names=["id", "n_lines", "n_dropped", "kept"],
        )


def _half(name: str):
    """A signed half of the hash as its eight bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(name), 16, "0"))


def _row_key(id_col, text):
    """Tells rows apart, also where ids are null or repeated. Rows that share a key share what they
    drop, which is harmless: lines of frequent keys, and those go everywhere."""
    return F.xxhash64(id_col, text)


def _hits(texts: DataFrame, min_docs: int) -> DataFrame:
    """of (a row's key), drop: the hashes of its lines that stand in `min_docs` documents or more;
    texts: the keys as id, and text."""
    keys = texts.mapInArrow(lean(_hashed), "id long, high array<long>, low array<long>").select("id", F.explode(F.arrays_zip("high", "low")).alias("k")).select("id", "k.high", "k.low")
    # A row's keys are distinct already, so counting rows counts documents.
    frequent = keys.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("high", "low")
    return keys.join(frequent, ["high", "low"]).groupBy(F.col("id").alias("of")).agg(F.collect_set(F.concat(_half("high"), _half("low"))).alias("drop"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """id, n_lines, n_dropped, kept (binary UTF-8): one row per row of df.

    A null or empty text has one empty line, and lines of an empty key are never dropped. A line
    repeated inside one row counts once. Each row is a document: rows that share an id, or whose id
    is null, count one by one. A line of just min_docs documents goes. Whole texts are cut, however
    long. An empty table gives an empty result; other columns are ignored."""
    texts = own_names(df, id=id_col, text=text_col).select("id", _row_key("id", "text").alias("row"), F.col("text").cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    hits = _hits(texts.select(F.col("row").alias("id"), "text"), min_docs)
    return texts.join(hits, F.col("row") == F.col("of"), "left").select("id", "text", "drop").mapInArrow(lean(_kept), f"id {kind}, n_lines long, n_dropped long, kept binary")


def dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """df with the kept lines for text: all its rows (one that loses every line has an empty text)
    and all its columns, whatever their names. A null text stays null, and an empty one empty. Rows
    that share an id, or have none, are documents of their own. Lines of just min_docs documents go.
    Whole texts are cut, however long. An empty table gives an empty one."""
    texts = own_names(df, id=id_col, text=text_col).select(_row_key("id", "text").alias("id"), F.col("text").cast("binary").alias("text"))
    of, drop = unused(df, "of"), unused(df, "drop")
    hits = _hits(texts, min_docs).withColumnsRenamed({"of": of, "drop": drop})
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts, drops = batch.column(at).to_pylist(), batch.column(len(df_columns)).to_pylist()
            out = []
            for text, drop in zip(texts, drops, strict=True):
                if not drop or text is None:
                    out.append(text)
                    continue
                gone = set(drop)
                parts = text.split("\n")
                kept = [x for x, k in zip(parts, line_keys(text.encode()), strict=True) if len(k) < MIN_POINTS or xxhash.xxh3_128_digest(k) not in gone]
                out.append("\n".join(kept))
            columns = list(batch.columns[: len(df_columns)])
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=df_columns)

    df_columns = df.columns
    return df.join(hits, _row_key(df[f"`{id_col}`"], df[f"`{text_col}`"]) == hits[of], "left").select(*(df[f"`{c}`"] for c in df_columns), drop).mapInArrow(lean(run), df.schema)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
