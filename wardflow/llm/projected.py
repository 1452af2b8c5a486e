"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test stops the search."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, fitted_width, in_blocks, matrix, merge, node_count, placed, routed, sample, search, usable
from .common import saved

DIMENSIONS = 8  # of the projection; even, so that the chi-square distribution is a finite sum
SAMPLE = 4  # vectors, for each cell of the tree above the blocks, that this tree is fitted on
LEAF = 32
ASKED = 256  # queries whose distances to all cells are held at once
SURE = 0.98


def chi_square(x: np.ndarray, m: int = DIMENSIONS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def chi_square_at(p: float, m: int = DIMENSIONS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < p else (low, middle)
    return high


def kd_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and value of each inner node of a complete tree, in breadth-first order."""
    splits, groups = [], [points]
    for _ in range(depth):
        after = []
        for g in groups:
            axis = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            value = float(np.median(g[:, axis])) if len(g) else 0.0
            splits.append((axis, value))
            after += [g[g[:, axis] < value], g[g[:, axis] >= value]]
        groups = after
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axes, values = np.array([a for a, _ in splits]), np.array([v for _, v in splits])
    for _ in range(depth):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] >= values[at])
    return at - (2**depth - 1)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        out += np.maximum(0, np.maximum(low[:, axis] - p, p - high[:, axis])) ** 2
    return out


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """The points of a kd-tree's leaves: halves along the widest axis."""
    todo, out = [np.arange(len(points))], []
    while todo:
        g = todo.pop()
        if len(g) <= LEAF:
            out.append(g)
            continue
        axis = int(np.argmax(np.ptp(points[g], axis=0)))
        order = g[np.argsort(points[g, axis], kind="stable")]
        todo += [order[len(g) // 2:], order[:len(g) // 2]]
    return out


def nearest_in_block(
    x: np.ndarray, x_low: np.ndarray, ids: np.ndarray, q: np.ndarray, q_low: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int, reach: float
) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of each query's k nearest found; ids of -1 where fewer were.

    Leaves come in the order of their box's projected distance r. With d the kth distance so far, a point
    nearer than d has a projected distance of at most r with the probability chi_square(r^2 / d^2) or more:
    a query stops when this reaches the level that `reach` stands for.
    """
    groups = leaves(x_low)
    width = max(map(len, groups))
    table = np.full((len(groups), width), -1)
    for row, g in zip(table, groups):
        row[:len(g)] = g
    away = box_distances(q_low, np.array([x_low[g].min(0) for g in groups]), np.array([x_low[g].max(0) for g in groups]))
    order = np.argsort(away, axis=1, kind="stable")
    scores, found = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
    active = np.arange(len(q))
    for turn in range(len(groups)):
        leaf = order[active, turn]
        d = np.minimum(-scores[active, -1], bound[active])
        goes_on = ~(away[active, leaf] >= reach * d**2) | (d == 0) & (away[active, leaf] == 0)
        active, leaf = active[goes_on], leaf[goes_on]
        if not len(active):
            break
        step = max(1, (4 << 20) // (8 * width * max(1, x.shape[1])))
        for at in range(0, len(active), step):
            who, points = active[at:at + step], table[leaf[at:at + step]]
            distance = np.sqrt(((x[points] - q[who, None, :]) ** 2).sum(axis=2))
            wrong = (points < 0) | (ids[points] == q_ids[who, None])
            more = np.where(wrong, -np.inf, -distance)
            scores[who], found[who] = merge(scores[who], found[who], more, np.where(wrong, -1, ids[points]), k)
    return -scores, found


def nearest(rows: DataFrame, every: int = 100, k: int = 10, sure: float = SURE, seed: int = 8) -> DataFrame:
    """For each row whose id is divisible by `every`, the k nearest other rows found, by Euclidean distance.

    All rows are projected on DIMENSIONS random Gaussian directions. The upper levels of a kd-tree, more for more rows
    (`node_count`) and fitted on SAMPLE projected vectors a cell, deal them to cells, cells to blocks of bounded size; each block has a
    kd-tree of its own. Every query first searches its own block, which gives an upper bound for its kth
    distance. Then it visits the other blocks that the chi-square test does not rule out. Projected neighbours
    are verified with exact distances of the whole vectors until the test stops.

    Null ids and vectors, zero vectors, and vectors with null or non-finite components take no part. Rows that
    share the query's id are its own and no candidates; of query rows with one id that with the least packed bytes counts.
    Shorter vectors count as filled up with zeros. Ties go to the smaller id.
    """
    kept = usable(rows, zero=False)
    depth = (node_count(rows) - 1).bit_length()
    drawn = sample(kept, max(4096, SAMPLE << depth))
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not len(drawn):
        return rows.sparkSession.createDataFrame([], empty)
    directions = np.random.default_rng(seed).normal(size=(drawn.shape[1], DIMENSIONS))
    splits, reach = kd_splits(drawn @ directions, depth), chi_square_at(sure)

    def project(x: np.ndarray) -> np.ndarray:
        if x.shape[1] <= len(directions):
            return x @ directions[:x.shape[1]]
        more = np.random.default_rng(seed + 1).normal(size=(x.shape[1] - len(directions), DIMENSIONS))
        return x @ np.concatenate((directions, more))

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = project(x)
        return cell_of(low, splits, depth), low

    known = in_blocks(placed(kept, cells, lambda x: x))
    axes = range(DIMENSIONS)
    boxes = known.groupBy("node").agg(
        F.first("subs").alias("subs"), *[F.min(F.col("numbers")[i]).alias(f"a{i}") for i in axes], *[F.max(F.col("numbers")[i]).alias(f"b{i}") for i in axes]
    ).collect()  # one row per cell
    names = np.array([r["node"] for r in boxes])
    subs = np.array([r["subs"] for r in boxes])
    low, high = (np.array([[r[f"{side}{i}"] for i in axes] for r in boxes]) for side in "ab")
    own = known.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "node", "sub")).alias("o"))
    queries = own.select("query_id", F.col("o.v").alias("q"), F.lit(float("inf")).alias("bound"), F.col("o.node").alias("node"), F.col("o.sub").alias("sub"))

    def block(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = matrix(data["v"]), matrix(asked["q"])
        wide = max(x.shape[1], q.shape[1])
        away, ids = nearest_in_block(
            fitted_width(x, wide), np.stack(data["numbers"].to_list()), data["vec_id"].to_numpy(), fitted_width(q, wide), project(q),
            asked["query_id"].to_numpy(), asked["bound"].to_numpy(float), k, reach,
        )
        hit = np.nonzero(np.isfinite(away))
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[hit[0]], "vec_id": ids[hit], "score": away[hit]})

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), ASKED):
                part = f.iloc[at:at + ASKED]
                away = box_distances(project(matrix(part["q"])), low, high)
                who, where = np.nonzero(~(away > reach * part["bound"].to_numpy(float)[:, None] ** 2))
                yield from routed(part, who, where, names, subs)

    result = "query_id bigint, vec_id bigint, score double"
    first = saved(search(known, queries, block, result))
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("most"))
    bounds = queries.drop("bound").join(reached, "query_id", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("most")).otherwise(F.lit(float("inf"))))
    routes = bounds.select("query_id", "q", "bound", "node", "sub").mapInPandas(others, "query_id bigint, q binary, bound double, node int, sub int")
    return best(first.unionByName(search(known, routes, block, result)).distinct(), k, [F.col("score")]).select("query_id", "rank", "vec_id", "score")
