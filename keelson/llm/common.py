"""Helpers shared by the operators: vectorised word splitting and hashing over Arrow buffers,
packed integer columns, and exact global prefix sums over an ordered table."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Fixed: the six ASCII white space characters that part words, `[\x20\x09-\x0D]`.
WHITE = b" \t\n\x0b\x0c\r"
#: Text bytes that one vectorised step works on at most (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Rows of an Arrow batch at most.
BATCH_ROWS = 1024

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_ODD = [int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_BYTE = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_POWERS: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a folder that all executors share: the cluster's own setting. Only where
    that is unset and all runs on one machine (a local master) a temporary folder is taken."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keelson-"))


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles and checkpoints that nothing refers to any more. It does so when
    the driver collects garbage, and a loop of small jobs may fill disks long before that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    shrink(spark)


def shrink(spark: SparkSession) -> None:
    """Executors give heap that holds only garbage back to the system: a heap that a step has grown
    stays grown, beside the Python workers of the next. One small task per core collects it."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. Rows go by Arrow, as lists would start Python workers of
    another kind on all executors, which stay there."""
    kind = T.StructType.fromDDL(schema)
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(kind.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kind.names), kind)


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, unless it is installed there,
    and get whole texts in smaller batches than is usual for rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def own_names(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, whatever else the table holds."""
    importable(df.sparkSession)
    return df.select(*(df[f"`{old}`"].alias(new) for new, old in columns.items()))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        full = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        full[0] = 1
        got = np.multiply.accumulate(full)
        if len(got) <= 4 * STEP_BYTES:
            _POWERS[base] = got
    return got[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another and their n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts.

    starts, ends: byte positions; first: n + 1 word numbers at which the texts begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        solid = ~_IS_WHITE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, stops = solid.copy(), solid.copy()
        if len(data) > 1:
            begins[1:] &= ~solid[:-1] | edge[1:-1]
            stops[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; which: 0 or 1, two independent functions."""
        return span_hashes(self.data, self.starts, self.ends, which)

    def owner(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte spans by prefix sums of a polynomial whose odd base can be divided out."""
    odd = _ODD[which]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[which][data] * _powers(odd, len(data)), out=sums[1:])
    back = _powers(pow(odd, -1, 1 << 64), len(data) + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


_SLOTS = [np.random.Generator(np.random.PCG64(77 + k)).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in range(2)]


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each `size` consecutive word hashes; windows across two texts are the caller's to drop."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _SLOTS[which][k]
    return mix64(out)


def steps(column: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` text bytes at most."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def lean(run):
    """A worker's function over batches that gives what it no longer needs back to the system at its
    end: workers live on and serve other operators."""

    def runs(batches):
        yield from run(batches)
        trim()

    return runs


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, one after another, as bytes."""
    return b"".join(np.ascontiguousarray(x).tobytes() for x in columns)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.frombuffer(data[at : at + size], k))
        at += size
    return out


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from its values and the length of each row's list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def running_totals(df: DataFrame, order: list, values: list[str]) -> DataFrame:
    """Adds for each of `values` a column `before_<value>`: its sum over all rows that come earlier
    in `order`, exactly.

    The rows are dealt by range and sorted, written to the checkpoint folder (range bounds are
    sampled, so a second evaluation could cut elsewhere), totalled per partition, and the totals'
    prefix sums, one row per partition, go back to the partitions. Rows of equal keys may stand in
    any order, once and for all."""
    n = parts(df)
    spread = checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    totals = {r[0]: r[1:] for r in spread.groupBy("__part").agg(*(F.sum(v).cast("long") for v in values)).collect()}
    offsets, running = {}, [0] * len(values)
    for p in sorted(totals):
        offsets[p] = list(running)
        running = [a + (b or 0) for a, b in zip(running, totals[p], strict=True)]
    fields = df.schema.fields
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"before_{v} long" for v in values)])

    def run(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, more = at or list(offsets[batch.column(len(names))[0].as_py()]), []
            for k, v in enumerate(values):
                x = pc.fill_null(batch.column(names.index(v)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(x)
                more.append(pa.array(at[k] + sums - x))
                at[k] += int(sums[-1]) if len(sums) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, *(f"before_{v}" for v in values)])

    return spread.mapInArrow(run, schema)
