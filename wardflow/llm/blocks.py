"""What the two vector searches share: usable vectors, bounded blocks, and searching each block with the queries sent to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK_ROWS = 8192  # rows of a block, and queries of a group that meets a block, on average at most
LEAST_NODES, MOST_NODES = 64, 4096  # nodes above the blocks: about two a block, so that blocks lie close together in space
ROUTES = 16_384  # routes of queries to blocks that a task holds at once


def usable(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding of rows that take part: id and vector present, no null or non-finite component."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    return kept if zero else kept.filter(F.exists(x, lambda v: v != 0))


def matrix(column) -> np.ndarray:
    """Rows of packed doubles as one matrix; shorter vectors are filled up with zeros."""
    parts = [np.frombuffer(b) for b in column]
    width = max((len(p) for p in parts), default=0)
    if all(len(p) == width for p in parts):
        return np.stack(parts) if parts else np.zeros((0, width))
    out = np.zeros((len(parts), width))
    for row, p in zip(out, parts):
        row[:len(p)] = p
    return out


def list_matrix(lists: pa.Array) -> np.ndarray:
    """A list column without nulls as one matrix of doubles, filled up with zeros."""
    return matrix([np.asarray(v, np.float64).tobytes() for v in lists.to_pylist()])


def packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def fitted_width(x: np.ndarray, width: int) -> np.ndarray:
    """Cut or fill up columns to `width`."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def node_count(rows: DataFrame) -> int:
    """Nodes for a table of so many rows; beyond MOST_NODES blocks of rows a node falls into several blocks."""
    return min(MOST_NODES, max(LEAST_NODES, -(-2 * rows.count() // BLOCK_ROWS)))


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most `n` vectors, chosen by a hash of the id, on the driver."""
    order = F.xxhash64("vec_id")
    picked = rows.orderBy(order, "vec_id").limit(n).collect()
    return matrix([np.asarray(r["embedding"], np.float64).tobytes() for r in picked])


def placed(rows: DataFrame, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], convert: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """vec_id, vector as packed doubles, node and the numbers `place` gives for it; written to shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = convert(list_matrix(batch.column("embedding")))
                node, numbers = place(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), packed(x), pa.array(node, pa.int32()), pa.array(numbers.tolist(), pa.list_(pa.float64()))],
                    names=["vec_id", "v", "node", "numbers"],
                )

    return saved(rows.mapInArrow(run, "vec_id bigint, v binary, node int, numbers array<double>"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """Add `sub`: a node of many rows falls into blocks by a hash of the id, so a node may hold any share of the table."""
    size = rows.groupBy("node").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("subs"))
    return rows.join(F.broadcast(size), "node").withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int"))  # one row per node


def routed(asked: pd.DataFrame, who: np.ndarray, where: np.ndarray, names: np.ndarray, subs: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows that send query `who[i]` of `asked` to all blocks of node `names[where[i]]` but the one it has searched."""
    step = max(1, ROUTES // max(1, int(subs.max(initial=1))))
    for at in range(0, len(who), step):
        w, n = who[at:at + step], where[at:at + step]
        count = subs[n]
        w, node = np.repeat(w, count), np.repeat(names[n], count)
        sub = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count)
        new = (node != asked["node"].to_numpy()[w]) | (sub != asked["sub"].to_numpy()[w])
        yield asked.iloc[w[new]].assign(node=node[new].astype(np.int32), sub=sub[new].astype(np.int32))


def search(data: DataFrame, routes: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a search in every block with the queries routed to it (query_id, q, bound, node, sub).

    A block that more than BLOCK_ROWS queries visit is copied for each group of so many; blocks without visitors
    are not moved.
    """
    groups = routes.groupBy("node", "sub").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("groups"))
    keys = ["node", "sub", "group"]
    left = data.join(groups, ["node", "sub"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(*keys, "vec_id", "v", "numbers")
    right = routes.join(groups, ["node", "sub"]).withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).select(*keys, "query_id", "q", "bound")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def best(found: DataFrame, k: int, order: list) -> DataFrame:
    """The first k of each query's finds, with `rank` from 1. A query has k finds from each block at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest of both, ties to the smaller id."""
    scores, ids = np.concatenate((scores, more), axis=1), np.concatenate((ids, more_ids), axis=1)
    first = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, first, axis=1), np.take_along_axis(ids, first, axis=1)
