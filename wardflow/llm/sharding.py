"""Shards of nearly equal bytes by histogram sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, text_or_empty

KEY_END = 1 << 63
ROUNDS = 12


def sort_key() -> Column:
    """40 bits of the text's hash, then 23 of the row's: equal texts lie side by side, and a large group of them can still be cut."""
    text = F.shiftrightunsigned(F.xxhash64(text_or_empty()), 24)
    return F.shiftleft(text, 23).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 41))


def keyed(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return docs.select(
        "doc_id", (F.octet_length(text_or_empty()) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text_or_empty()).alias("text_crc32"),
        sort_key().alias("_key"), *[c for c in keep if c != "doc_id"],
    )


def below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe; each partition counts, the counts are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("_key").to_numpy(), side="right")
            np.add.at(sums, at, batch.column("size").to_numpy())
            np.add.at(n, at, 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some]), pa.array(n[some])], names=["bin", "bytes", "n"])

    counts = rows.select("_key", "size").mapInArrow(count, "bin bigint, bytes bigint, n bigint")
    sums, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():  # one row per probe at most
        sums[r["bin"]], n[r["bin"]] = r["bytes"], r["n"]
    return np.cumsum(sums)[:-1], np.cumsum(n)[:-1]


def splitters(rows: DataFrame, parts: int, tolerance: float, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the table into `parts` ranges of equal bytes, and the rows below each.

    Every boundary keeps the closest probes below and above its target; `fan` new probes between them are
    counted in each round, until all are within `tolerance` of a part or at most one row lies between.
    """
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    goal = [total * i // parts for i in range(1, parts)]
    low = [(0, 0, 0)] * (parts - 1)
    high = [(KEY_END - 1, total, n)] * (parts - 1)
    known = {0: (0, 0), KEY_END - 1: (total, n)}
    for _ in range(ROUNDS):
        probes = set()
        for (a, at_a, na), (b, at_b, nb), g in zip(low, high, goal):
            if b - a > 1 and nb - na > 1 and min(g - at_a, at_b - g) > tolerance * total / parts:
                probes.update(a + (b - a) * k // (fan + 1) for k in range(1, fan + 1))
        probes -= known.keys()
        if not probes:
            break
        at = np.array(sorted(probes), np.int64)
        known.update(zip(at.tolist(), zip(*(x.tolist() for x in below(rows, at)))))
        keys = sorted(known)
        sums = np.array([known[k][0] for k in keys], np.int64)
        for i, g in enumerate(goal):
            b = min(int(np.searchsorted(sums, g, side="right")), len(keys) - 1)  # the first key with more below it
            low[i], high[i] = (keys[b - 1], *known[keys[b - 1]]), (keys[b], *known[keys[b]])
    chosen = [a if g - a[1] <= b[1] - g else b for a, b, g in zip(low, high, goal)]
    return np.array([k for k, _, _ in chosen], np.int64), np.array([rows_ for _, _, rows_ in chosen], np.int64)


def shard_documents(
    docs: DataFrame, shards: int = 40, cells: int = 16, tolerance: float = 0.02, fan: int = 16, keep: Sequence[str] = ()
) -> DataFrame:
    """Every document with its size, its shard of nearly equal bytes and its place (`slot`) in the shard.

    The order is by a hash of the text, then of the row. Each shard consists of `cells` key ranges of about
    equal bytes, which are the groups of the one exchange; `tolerance` is a share of such a range. A shard's
    rows before a cell are known from the counts, so a slot needs no window over a whole shard.

    A null text has no bytes and the checksum of an empty one. Rows that are equal in id and text are told
    apart by nothing, so either may come first. An empty table gives no rows. `keep` names columns to carry.
    """
    clash = {"size", "text_crc32", "shard", "slot"} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    cuts, rows_below = splitters(saved(keyed(docs)), shards * cells, tolerance, fan)
    starts = np.concatenate(([0], rows_below)) if shards * cells > 1 else np.zeros(1, np.int64)
    cell_of_rows = starts - starts[np.arange(len(starts)) // cells * cells]  # rows of the same shard before the cell

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.searchsorted(cuts, batch.column("_key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(cell_of_rows[cell])], names=[*batch.schema.names, "_cell", "_before"]
            )

    rows = keyed(docs, keep)
    schema = T.StructType(list(rows.schema.fields)).add("_cell", T.IntegerType()).add("_before", T.LongType())
    order = Window.partitionBy("_cell").orderBy("_key", "doc_id", "text_crc32")
    return rows.mapInArrow(assign, schema).select(
        "doc_id", "size", "text_crc32", F.floor(F.col("_cell") / cells).cast("int").alias("shard"),
        (F.col("_before") + F.row_number().over(order) - 1).cast("bigint").alias("slot"), *[c for c in keep if c != "doc_id"],
    )
