"""Substring dedup with difference-cover anchors.

A run of 13 words that two documents share is found without hashing every position: only windows of
7 words are hashed, and only where the position modulo 7 is 0, 1 or 3. For any two positions some
shift below 7 brings both onto that cover, so any two equal runs of 13 words hold an equal anchor.
Anchors that stand in two documents are then extended: the 13-word windows around them, and no
others, are hashed (128 bits) and compared.

Both comparisons work alike. A task sorts the hashes of a bounded chunk of documents and decides
what the chunk alone can decide; for each hash only its smallest document goes on to a bin of the
hash, packed many to a row. So a passage of every document costs a few entries per chunk, whatever
its number of copies, and no pair is ever formed. Texts are shuffled once and met twice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, Words, own_names, packed, parts, steps, text_buffer, window_hashes

WINDOW = 13
#: A difference cover modulo PERIOD; an anchor and the longest shift fit in a window.
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Entries that a task compares at a time; a longer document is a chunk of its own.
CHUNK = 1 << 21
#: Bytes of each hash that are sent, for anchors and for windows. Anchors are only candidates, and
#: their bin tells 16 bits more; 96 bits tell the windows of 100 TB apart.
HASH_BYTES = {1: (6,), 2: (8, 4)}
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_ROW = "bin int, mark boolean, docs binary, counts binary, pos binary, hash binary"


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted keys, another key begins; the end is added."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), n)


class _Entries:
    """Entries of documents, each a position and hashes, packed by document and 65,536 positions."""

    def __init__(self) -> None:
        self.ids, self.sums, self.n = [], [], 0
        self.doc, self.pos, self.hashes = [], [], []

    def add(self, row_id: int, row_sum: int, pos: np.ndarray, *hashes: np.ndarray) -> None:
        self.doc.append(np.full(len(pos), len(self.ids), np.int64))
        self.ids.append(row_id)
        self.sums.append(row_sum)
        self.pos.append(pos)
        self.hashes.append(hashes)
        self.n += len(pos)

    def arrays(self):
        doc, pos = np.concatenate(self.doc), np.concatenate(self.pos).astype(np.int64)
        return np.array(self.ids, np.int64), np.array(self.sums, np.int64), doc, pos, [np.concatenate(h) for h in zip(*self.hashes, strict=True)]


def _pack(ids, sums, doc, pos, *hashes) -> tuple[bytes, bytes, bytes, bytes]:
    """Entries by document: ids, sums and 65,536s of positions; counts; position steps; hashes cut
    to HASH_BYTES. High bytes stand apart from low ones, as most are zero."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    at = _runs(doc, pos >> 16)
    first = at[:-1]
    docs = np.stack([ids[doc[first]], sums[doc[first]], pos[first] >> 16]) if len(first) else np.zeros((3, 0), np.int64)
    low = (pos & 0xFFFF).astype(np.uint16)
    step = low.copy()
    step[1:] -= low[:-1]
    step[first] = low[first]
    halves = step.view(np.uint8).reshape(-1, 2).T
    return docs.tobytes(), packed(np.diff(at).astype(np.uint32)), np.ascontiguousarray(halves).tobytes(), packed(*(_cut(h[order], n) for h, n in zip(hashes, HASH_BYTES[len(hashes)], strict=True)) if hashes else ())


def _cut(h: np.ndarray, n: int) -> np.ndarray:
    return h.view(np.uint8).reshape(-1, 8)[:, :n]


def _hashes(data: bytes, width: int) -> np.ndarray:
    sizes = HASH_BYTES[width]
    n, at, out = len(data) // sum(sizes), 0, []
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(n, size)
        out.append(wide.view(np.uint64)[:, 0])
        at += n * size
    return np.stack(out)


def _unpack(docs: bytes, counts: bytes, pos: bytes):
    ids, sums, base = np.frombuffer(docs, np.int64).reshape(3, -1)
    n = np.frombuffer(counts, np.uint32).astype(np.int64)
    step = np.ascontiguousarray(np.frombuffer(pos, np.uint8).reshape(2, -1).T).view(np.uint16)[:, 0].astype(np.int64)
    # Steps within a document are never negative: positions ascend.
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    low = total - np.repeat(total[first] - step[first], n)
    return np.repeat(ids, n), np.repeat(sums, n), np.repeat(base << 16, n) + low


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bin", "mark", "docs", "counts", "pos", "hash"])


def _decide(entries: _Entries, bins: int, by_rank: bool):
    """A chunk's rows: the marks that it can decide itself, and by bin what others must see.

    by_rank False: equal hashes of two documents mark all of them. True: they mark all but those of
    the smallest id."""
    if not entries.n:
        return
    ids, sums, doc, pos, hashes = entries.arrays()
    order = np.lexsort((ids[doc], *hashes[::-1]))
    doc, pos, hashes = doc[order], pos[order], [h[order] for h in hashes]
    at = _runs(*hashes)
    size = np.diff(at)
    key = ids[doc]
    low, high = np.repeat(key[at[:-1]], size), np.repeat(key[at[1:] - 1], size)
    sent = np.ones(len(doc), bool)
    if by_rank:
        marked = key > low
        sent = ~marked
    else:
        marked = low != high
        sent[marked] = False
        sent[at[:-1]] = True  # one entry of a marked hash tells the other chunks
    if marked.any():
        yield (int(hashes[0][0] % np.uint64(bins)), True, *_pack(ids, sums, doc[marked], pos[marked])[:3], b"")
    to = mix_bin(hashes[0][sent], bins)
    cut = np.argsort(to, kind="stable")
    ends = np.searchsorted(to[cut], np.arange(bins + 1))
    doc, pos, hashes = doc[sent][cut], pos[sent][cut], [h[sent][cut] for h in hashes]
    for b in range(bins):
        i, j = ends[b], ends[b + 1]
        if j > i:
            yield (b, False, *_pack(ids, sums, doc[i:j], pos[i:j], *(h[i:j] for h in hashes)))


def mix_bin(x: np.ndarray, bins: int) -> np.ndarray:
    return ((x.astype(np.uint64) >> np.uint64(48)) % np.uint64(bins)).astype(np.int32)


def _texts(batches):
    """Per document with a whole window: id, sum, further columns of the row, word hashes (two)."""
    for batch in batches:
        for a, b in steps(batch.column(2), STEP_BYTES):
            part = batch.slice(a, b - a)
            w = Words(*text_buffer(part.column(2)))
            ids, sums = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            yield part, ids, sums, w


def _anchors(bins: int):
    def run(batches):
        chunk = _Entries()
        for _, ids, sums, w in _texts(batches):
            found = window_hashes(w.hashes(), ANCHOR)
            for k in np.flatnonzero(np.diff(w.first) >= WINDOW).tolist():
                i, j = w.first[k], w.first[k + 1]
                pos = np.flatnonzero(np.resize(_IN_COVER, j - i - ANCHOR + 1))
                chunk.add(int(ids[k]), int(sums[k]), pos, found[i + pos])
                if chunk.n >= CHUNK:
                    yield from map(_rows, _some(_decide(chunk, bins, False)))
                    chunk = _Entries()
        yield from map(_rows, _some(_decide(chunk, bins, False)))

    return run


def _some(rows, n: int = 16):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def _windows(bins: int):
    """Windows around marked anchors."""

    def run(batches):
        chunk = _Entries()
        for part, ids, sums, w in _texts(batches):
            one, two = (window_hashes(w.hashes(k), WINDOW, k) for k in (0, 1))
            marks = part.column(3)
            for k in np.flatnonzero(np.diff(w.first) >= WINDOW).tolist():
                if not (got := marks[k].as_py()):
                    continue
                i, n = w.first[k], w.first[k + 1] - w.first[k]
                near = np.zeros(n + 1, np.int64)
                at = _positions(got)
                np.add.at(near, np.maximum(at - (PERIOD - 1), 0), 1)
                np.add.at(near, np.minimum(at + 1, n), -1)
                pos = np.flatnonzero(np.cumsum(near)[: n - WINDOW + 1])
                chunk.add(int(ids[k]), int(sums[k]), pos, one[i + pos], two[i + pos])
                if chunk.n >= CHUNK:
                    yield from map(_rows, _some(_decide(chunk, bins, True)))
                    chunk = _Entries()
        yield from map(_rows, _some(_decide(chunk, bins, True)))

    return run


def _positions(got: bytes) -> np.ndarray:
    return np.frombuffer(got, np.uint32).astype(np.int64)


def _met(width: int, by_rank: bool, homes: int):
    """All entries of a bin: marks, packed by bin of the document."""

    def run(table: pa.Table) -> pa.Table:
        ids, sums, pos, hashes = [], [], [], []
        marks = []
        for r in table.to_pylist():
            x = _unpack(r["docs"], r["counts"], r["pos"])
            if r["mark"]:
                marks.append(x)
                continue
            ids.append(x[0])
            sums.append(x[1])
            pos.append(x[2])
            hashes.append(_hashes(r["hash"], width))
        if ids:
            ids, sums, pos = map(np.concatenate, (ids, sums, pos))
            hashes = np.concatenate(hashes, axis=1)
            order = np.lexsort((ids, *hashes[::-1]))
            ids, sums, pos, hashes = ids[order], sums[order], pos[order], hashes[:, order]
            at = _runs(*hashes)
            size = np.diff(at)
            low, high = np.repeat(ids[at[:-1]], size), np.repeat(ids[at[1:] - 1], size)
            # An entry that stood for a marked hash of its chunk is marked twice, which is harmless;
            # alone in its bin it was marked at home already.
            yes = ids > low if by_rank else low != high
            marks.append((ids[yes], sums[yes], pos[yes]))
        if not marks or not sum(len(m[0]) for m in marks):
            return pa.Table.from_pylist([], schema=_PACKED)
        ids, sums, pos = (np.concatenate([m[i] for m in marks]) for i in range(3))
        to = (sums.astype(np.uint64) >> np.uint64(20)) % np.uint64(homes)
        order = np.lexsort((sums, ids, to))
        ids, sums, pos, to = ids[order], sums[order], pos[order], to[order]
        at = _runs(to)
        same = _runs(to, ids, sums)
        doc = np.repeat(same[:-1], np.diff(same))  # each document by the place of its first mark
        rows = [(int(to[a]), *_pack(ids, sums, doc[a:b], pos[a:b])[:3]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_PACKED.types)], schema=_PACKED)

    return run


_PACKED = pa.schema([("home", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("pos", pa.binary())])
_MARKS = pa.schema([("id", pa.int64()), ("sum", pa.int64()), ("marks", pa.binary())])


def _by_document(table: pa.Table) -> pa.Table:
    """One row per document: its marked positions, ascending."""
    parts = [_unpack(r["docs"], r["counts"], r["pos"]) for r in table.to_pylist()]
    ids, sums, pos = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((pos, sums, ids))
    ids, sums, pos = ids[order], sums[order], pos[order].astype(np.uint32)
    at = _runs(ids, sums)
    first = at[:-1]
    return pa.Table.from_arrays([pa.array(ids[first]), pa.array(sums[first]), pa.array([pos[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], schema=_MARKS)


def _marked(packed_rows: DataFrame, width: int, by_rank: bool) -> DataFrame:
    homes = max(8, parts(packed_rows) // 4)  # marks are few; each bin sends a row to each home at most
    met = packed_rows.groupBy("bin").applyInArrow(_met(width, by_rank, homes), "home int, docs binary, counts binary, pos binary")
    return met.groupBy("home").applyInArrow(_by_document, "id long, sum long, marks binary")


def _reassembled(batches):
    for part, ids, _, w in _texts(batches):
        marks, texts = part.column(3), part.column(2)
        n, gone, kept = np.diff(w.first), [], []
        for k in range(part.num_rows):
            got, words = marks[k].as_py(), (texts[k].as_py() or b"").split()
            if not got:
                gone.append(0)
                kept.append(b" ".join(words))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(_positions(got))
            edge[at] += 1
            np.add.at(edge, at + WINDOW, -1)
            stay = np.cumsum(edge[:-1]) == 0
            gone.append(int(len(words) - stay.sum()))
            kept.append(b" ".join([x for x, s in zip(words, stay.tolist(), strict=True) if s]))
        yield pa.RecordBatch.from_arrays([part.column(4), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (binary: the kept words joined by one space): one row per row of df.

    Ids are integers; a null id ranks before all others. Rows that share an id never remove each
    other's words, and equal rows get equal results. A null text and one under 13 words lose
    nothing. An empty table gives an empty result; other columns are ignored."""
    least = -(1 << 63)
    texts = own_names(df, own=id_col, text=text_col).select(
        F.coalesce(F.col("own").cast("long"), F.lit(least)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sum"), F.col("text").cast("binary").alias("text"), F.col("own").cast("long").alias("own")
    )
    bins = 2 * parts(df)
    slim = texts.select("id", "sum", "text")
    shared = _marked(slim.mapInArrow(_anchors(bins), _ROW), 1, False)

    def meet(marks: DataFrame) -> DataFrame:
        marks = marks.withColumnsRenamed({"id": "mid", "sum": "msum"})
        return texts.join(marks, (F.col("id") == F.col("mid")) & (F.col("sum") == F.col("msum")), "left").select("id", "sum", "text", "marks", "own")

    later = _marked(meet(shared).mapInArrow(_windows(bins), _ROW), 2, True)
    return meet(later).mapInArrow(_reassembled, "id long, n_words long, n_removed long, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

