"""What the operators of this subpackage share: cut lineage, Arrow slices and word hashes."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

SLICE_BYTES = 2 << 20  # text that one numpy step looks at; a longer text makes a step of its own

# Word separators of the contracts, U+0020 and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)  # one more than the byte
_LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)
_WORD_BASE, _WORD_INVERSE = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The rows on the storage all executors share."""
    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """The same as a table: compressed, and read by columns, for many rows that are read several times."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, as soon as what was made of them is stored itself.

    The shuffle files of the jobs behind them go when the driver collects its garbage, which a small heap may not do
    for long, so it is asked to.
    """
    for table in tables:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        gc.collect()
        spark._jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about SLICE_BYTES of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    step = (np.cumsum(sizes) // SLICE_BYTES) if len(sizes) else sizes
    at = 0
    for end in [*(np.flatnonzero(np.diff(step)) + 1), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = int(end)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, each text followed by a newline, and where each text begins."""
    parts = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first `n` powers; those that a slice needs are kept for the next one."""
    steps = _POWERS.get(base)
    if steps is None or len(steps) < n:
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        np.multiply.accumulate(steps, out=steps)
        steps.flags.writeable = False
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = steps
    return steps[:n]


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and 64-bit hash (A-Z lower-cased) of each word.

    The hash of a word is a difference of running polynomial sums, shifted to the word's own origin;
    this is exact arithmetic modulo 2**64, so equal words hash alike wherever they stand.
    """
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return first, end, np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_LOWER[data], powers(_WORD_BASE, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    value = (sums[end] - sums[first]) * powers(_WORD_INVERSE, len(data))[first]
    return first, end, mix64(value ^ (end - first).astype(np.uint64))


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of `width` words in a row; a shorter text counts as one shingle, no words as none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    take = min(width, len(hashes))
    out = np.full(len(hashes) - take + 1, take, np.uint64)
    for k in range(take):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - take + 1 + k])
    return np.unique(out)
