"""Approximate nearest neighbours in many dimensions: a forest of random projections, grown until its measured recall suffices.

Where pivots do not prune, the exact search compares every visitor with its whole class. Here every
tree cuts a class at medians of random projections into leaves of bounded size, and rows meet only
inside a leaf, so work and shuffle grow with (rows x trees), not with their square.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import DEFAULT_SEED, hash_hex
from ..schemas import NEIGHBOUR
from ..session import cut_lineage
from .neighbours import _nearest_in_block, nearest_neighbours

LEAF_ROWS, LARGEST_LEAF = 1024, 8192
BITS = 4  # cuts of a node in one round, each by a projection of its own
PROBES = 256  # rows whose exact neighbours the recall is measured on
BATCH, MAX_TREES = 4, 64
_NODE = ["class_id", "tree", "node"]


@dataclass(frozen=True)
class ForestResult:
    """Neighbours like those of `nearest_neighbours`, the recall that the probes showed and the trees it took."""

    neighbours: DataFrame
    recall: float
    trees: int


def _projected(points: DataFrame, trees: range, bits: int, width: int, seed: int) -> DataFrame:
    """`(id, class_id, tree, places)`: each row once per tree with its place on each of the tree's directions."""
    directions = np.concatenate([np.random.default_rng([seed, t]).standard_normal((width, bits)) for t in trees], axis=1)

    @F.pandas_udf("array<double>")
    def project(features: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(features.to_numpy()) @ directions) if len(features) else [], dtype=object)

    slices = F.array(*[
        F.struct(F.lit(t).alias("tree"), F.slice("_all", n * bits + 1, bits).alias("places")) for n, t in enumerate(trees)
    ])
    rows = points.select("id", "class_id", project("features").alias("_all"))
    return rows.select("id", "class_id", F.explode(slices).alias("s")).select("id", "class_id", "s.*")


def _leaves(rows: DataFrame, rounds: int, leaf_rows: int, seed: int) -> DataFrame:
    """`(id, class_id, tree, node, part)`: the leaf of each row in each tree.

    A round cuts every node above `leaf_rows` at the medians of up to `BITS` directions. Rows that no direction tells
    apart (copies of one point, however many) are dealt into parts by the hash of their id: each part
    holds neighbours at the same distance.
    """
    open_rows = cut_lineage(rows.withColumn("node", F.lit(1).cast("bigint")))
    done: list[DataFrame] = []
    leaf = ["id", *_NODE, "part"]
    for step in range(rounds):
        axes = range(BITS)
        stats = open_rows.groupBy(*_NODE).agg(
            F.count("*").alias("n"),
            F.array(*[F.percentile_approx(F.col("places")[a], 0.5, 1000) for a in axes]).alias("middle"),
            F.array(*[F.max(F.col("places")[a]) - F.min(F.col("places")[a]) for a in axes]).alias("spread"),
        )
        need = F.least(F.ceil(F.log2(F.col("n") / leaf_rows)), F.lit(BITS)).cast("int")
        stats = cut_lineage(stats.withColumn("cuts", F.when((F.col("n") > leaf_rows) & (F.array_max("spread") > 0), need).otherwise(0)))
        joined = open_rows.join(stats.drop("spread"), _NODE)
        done.append(joined.filter("cuts = 0").select("id", *_NODE, _part(F.col("n"), leaf_rows, seed)))
        code: Column = F.lit(0).cast("bigint")
        for i, a in enumerate(axes):
            above = (F.col("places")[a] > F.col("middle")[i]).cast("bigint")
            code = code + F.when(F.col("cuts") > i, above * (1 << i)).otherwise(0)
        open_rows = cut_lineage(
            joined.filter("cuts > 0").withColumn("node", F.col("node") * (1 << BITS) + code)
            .withColumn("places", F.slice("places", BITS + 1, (rounds - step - 1) * BITS)).select(*rows.columns, "node")
        )
        if open_rows.isEmpty():
            break
    else:
        sizes = open_rows.groupBy(*_NODE).agg(F.count("*").alias("n"))
        done.append(open_rows.join(sizes, _NODE).select("id", *_NODE, _part(F.col("n"), leaf_rows, seed)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*leaf)


def _part(n: Column, leaf_rows: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), "tree"), F.ceil(n / leaf_rows)).cast("int").alias("part")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what the trees found for a row; a pair that several trees found counts once."""
    once = found.groupBy("id", "neighbour_id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour_id"))
    return once.withColumn("place", place).filter(F.col("place") <= k).select("id", "neighbour_id", "place", "distance")


def _met(points: DataFrame, visitors: DataFrame | None, leaves: DataFrame, k: int) -> DataFrame:
    """`(id, neighbour_id, distance)`: the k nearest leaf mates of each visitor in each tree; features go to leaves with visitors only."""
    if visitors is not None:
        held = leaves.join(visitors.select("id"), "id", "left_semi").select(*_NODE, "part").distinct()
        leaves = leaves.join(held, [*_NODE, "part"], "left_semi")
    asked = F.lit(True) if visitors is None else F.col("_asks").isNotNull()
    rows = leaves.join(points.select("id", "features"), "id")
    if visitors is not None:
        rows = rows.join(visitors.select("id", F.lit(True).alias("_asks")), "id", "left")
    rows = rows.withColumn("asks", asked)

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        pool = group.rename(columns={"id": "member_id", "features": "member"})
        return _nearest_in_block(group[group["asks"]].reset_index(drop=True), pool, k)

    kept = rows.select("id", "features", "asks", *_NODE, "part")
    return kept.groupBy(*_NODE, "part").applyInPandas(nearest, NEIGHBOUR)


def measured_recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours' places for which as near a neighbour was found; ties count as found."""
    reach = exact.groupBy("id").agg(F.max("distance").alias("reach"), F.count("*").alias("wanted"))
    near = found.join(reach, "id").filter(F.col("distance") <= F.col("reach") * (1 + 1e-12)).groupBy("id").agg(F.count("*").alias("n"))
    row = reach.join(near, "id", "left").agg(F.sum(F.least(F.coalesce("n", F.lit(0)), "wanted")).alias("hit"), F.sum("wanted").alias("all")).first()
    return 1.0 if not row["all"] else row["hit"] / row["all"]


def forest_neighbours(
    points: DataFrame, k: int, recall: float = 0.9, visitors: DataFrame | None = None, leaf_rows: int = LEAF_ROWS,
    probes: int = PROBES, max_trees: int | None = None, seed: int = DEFAULT_SEED,
) -> ForestResult:
    """`(id, neighbour_id, place, distance)` with the recall asked for, for `(id, class_id, features)` of finite numbers.

    Trees are tried in batches on `probes` visitors, picked by hash, until these find `recall` of their exact neighbours; their
    exact search costs (probes x rows). Then all visitors meet in the leaves of these trees, so rows are sent to
    leaves once, not for batches that fall short. Distances are exact, ids are unique, ties go to the smaller id among those
    found, rows of a class with fewer than k others have fewer neighbours.

    After each batch that falls short, leaves grow fourfold up to LARGEST_LEAF, and the trees with the smaller leaves are given up:
    what a tree finds keeps up with classes that grow, and few trees are in use. Where MAX_TREES do not reach the recall, or
    trees of the largest leaves would compare a row with as many others as its class has, the exact search answers (visitors x
    class members, in bounded blocks). A `max_trees` of the caller's choice is a limit of the cost: all trees stay in use, and
    this raises where they do not suffice.
    """
    if leaf_rows < 2 * (k + 1):
        raise ValueError(f"leaves of {leaf_rows} rows are too small for {k} neighbours")
    first = points.select(F.size("features").alias("width")).first()
    if first is None:
        return ForestResult(points.sparkSession.createDataFrame([], NEIGHBOUR).selectExpr("id", "neighbour_id", "1 AS place", "distance"), 1.0, 0)
    points = cut_lineage(points.select("id", "class_id", "features"))
    asked = points if visitors is None else cut_lineage(visitors.select("id", "class_id", "features"))
    picked = cut_lineage(asked.orderBy(hash_hex(f"{seed}-probe", F.col("id")), "id").limit(probes))
    exact = cut_lineage(nearest_neighbours(points, k, visitors=picked, seed=seed))
    largest = points.groupBy("class_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    in_use: list[DataFrame] = []  # the leaves of each batch
    found: DataFrame | None = None  # by the probes
    reached, trees, met, most = 0.0, 0, 0, MAX_TREES if max_trees is None else max_trees
    while trees < most:
        batch = range(trees, min(trees + BATCH, most))
        rounds = ceil(max(1.0, log2(max(2.0, largest / leaf_rows))) / BITS) + 1  # one more for uneven cuts
        leaves = cut_lineage(_leaves(_projected(points, batch, rounds * BITS, first["width"], seed), rounds, leaf_rows, seed))
        in_use.append(leaves)
        near = _met(points, picked, leaves, k)
        found = cut_lineage(_best(near if found is None else near.unionByName(found.select("id", "neighbour_id", "distance")), k))
        trees, met = batch.stop, met + len(batch) * leaf_rows
        reached = measured_recall(found, exact)
        if reached >= recall:
            every = _met(points, None if visitors is None else asked, reduce(DataFrame.unionByName, in_use), k)
            return ForestResult(cut_lineage(_best(every, k)), reached, trees)
        if max_trees is None and leaf_rows < LARGEST_LEAF:
            in_use, found, met = [], None, 0
        elif max_trees is None and met >= largest:
            break
        leaf_rows = max(leaf_rows, min(4 * leaf_rows, LARGEST_LEAF))
    if max_trees is None:
        near = nearest_neighbours(points, k, visitors=None if visitors is None else asked, seed=seed)
        return ForestResult(cut_lineage(near), 1.0, trees)
    raise ValueError(f"{trees} trees reach a recall of {reached:.3f}, not {recall}; raise max_trees or leaf_rows, or search exactly")
