"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, fitted_width, in_blocks, matrix, merge, node_count, placed, routed, sample, search, usable
from .common import saved

LEAF = 64
ROWS = 1024  # rows whose distances to all centres are held at once
SCALE = 256
LOW = -np.inf
EXACT = 2.0**53


@dataclass
class Node:
    """A centre, the farthest distance of a point below it, and either points or children.

    Children's centres are more than half the radius apart and their points at most half the radius away.
    """

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, centre: int | None = None) -> Node:
    points = np.arange(len(x)) if points is None else points
    centre = int(points[0]) if centre is None else centre
    away = np.linalg.norm(x[points] - x[centre], axis=1)
    node = Node(x[centre], float(away.max(initial=0.0)), points)
    if len(points) <= LEAF or node.radius == 0:
        return node
    half, rest, single = node.radius / 2, points, []
    first = away <= half
    while len(rest):
        own = rest[first]
        if len(own) > LEAF // 8:
            node.children.append(cover_tree(x, own, centre))
        else:
            single.append(own)  # a handful of points is looked at with others of the kind, under this node's centre
        rest = rest[~first]
        if len(rest):
            centre = int(rest[0])
            first = np.linalg.norm(x[rest] - x[centre], axis=1) <= half
    if single:
        own = np.concatenate(single)
        for at in range(0, len(own), LEAF):
            part = own[at:at + LEAF]
            middle = x[part].mean(axis=0)
            node.children.append(Node(middle, float(np.linalg.norm(x[part] - middle, axis=1).max()), part))
    return node


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; where doubles could round, they are summed as integers instead."""
    if np.abs(q).max(axis=0, initial=0) @ np.abs(x).max(axis=0, initial=0) < EXACT:
        return q @ x.T
    whole = np.array([[int(v) for v in row] for row in q], object) @ np.array([[int(v) for v in row] for row in x], object).T
    return whole


class Search:
    """Top k of each query among the points of a block, given scores that are known to be reached elsewhere."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int) -> None:
        self.q, self.q_ids, self.x, self.ids, self.k = q, q_ids, x, ids, k
        self.bound = bound
        kind = float if np.abs(q).max(axis=0, initial=0) @ np.abs(x).max(axis=0, initial=0) < EXACT else object
        self.scores = np.full((len(q), k), LOW, kind)
        self.found = np.full((len(q), k), -1, np.int64)

    def worst(self, queries: Node) -> float:
        """The least score that could still enter the result of some query of the group."""
        return np.maximum(self.scores[queries.points, -1].astype(float), self.bound[queries.points]).min()

    @staticmethod
    def most(a: Node, b: Node) -> float:
        """No inner product of a point below one and a point below the other is higher."""
        na, nb = np.linalg.norm(a.centre), np.linalg.norm(b.centre)
        most = a.centre @ b.centre + a.radius * nb + b.radius * na + a.radius * b.radius
        return most + 1e-9 * (na + a.radius) * (nb + b.radius)

    def visit(self, queries: Node, data: Node) -> None:
        if self.most(queries, data) < self.worst(queries):
            return
        if not queries.children and not data.children:
            self.compare(queries.points, data.points)
        elif data.children and (not queries.children or data.radius >= queries.radius):
            for child in sorted(data.children, key=lambda c: -self.most(queries, c)):
                self.visit(queries, child)
        else:
            for child in queries.children:
                self.visit(child, data)

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        scores = products(self.q[a], self.x[b])
        scores = np.where(self.q_ids[a][:, None] == self.ids[b], LOW, scores)
        ids = np.broadcast_to(self.ids[b], scores.shape)
        self.scores[a], self.found[a] = merge(self.scores[a], self.found[a], scores, ids, self.k)

    def run(self) -> pd.DataFrame:
        if len(self.q) and len(self.x):
            self.visit(cover_tree(self.q), cover_tree(self.x))
        row, _ = hit = np.nonzero(self.scores > LOW)
        limit = 2**63 - 1
        return pd.DataFrame({
            "query_id": self.q_ids[row], "vec_id": self.found[hit], "score": np.array([max(-limit, min(limit, int(s))) for s in self.scores[hit]], np.int64),
        })


def meetings(
    queries: Node, q: np.ndarray, bound: np.ndarray, middle: np.ndarray, radius: np.ndarray, nodes: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and nodes of rows that have to meet, as pairs of indices: the upper part of the dual-tree search.

    A pair of a query group and a node is left out if no product of theirs reaches the group's worst kth score, `bound`;
    what is left goes on to the groups below, and to the single queries of the last ones.
    """
    nodes = np.arange(len(middle)) if nodes is None else nodes
    size, far, own = np.linalg.norm(middle[nodes], axis=1), radius[nodes], np.linalg.norm(queries.centre)
    most = middle[nodes] @ queries.centre + queries.radius * size + far * own + far * queries.radius
    most += 1e-9 * (own + queries.radius) * (size + far)
    kept = most >= bound[queries.points].min()
    nodes, size, far = nodes[kept], size[kept], far[kept]
    if not len(nodes):
        return
    for child in queries.children:
        yield from meetings(child, q, bound, middle, radius, nodes)
    if not queries.children:
        one = q[queries.points]
        length = np.linalg.norm(one, axis=1)[:, None]
        who, where = np.nonzero(one @ middle[nodes].T + far * length + 1e-9 * length * (size + far) >= bound[queries.points][:, None])
        yield queries.points[who], nodes[where]


def top_products(rows: DataFrame, every: int = 50, k: int = 5, nodes: int | None = None) -> DataFrame:
    """For each row whose id is divisible by `every`, the k highest inner products with other rows, exactly.

    Components count as floor(256 * x). Rows are dealt to the nearest of a sample of vectors (a node with its
    covering radius; more nodes for more rows, by `node_count`, unless told), nodes to blocks of bounded size. Every query
    first searches one block of the node whose centre promises most. Then the queries are put into cover trees, and a
    group of them and a node are kept apart if no product of theirs can reach the group's worst kth score. In a block
    the queries sent to it and the rows are both put into cover trees and searched together.

    Null ids and vectors, and vectors with null or non-finite components, take no part. Rows that share the
    query's id are its own and no candidates; of query rows with one id that with the least packed bytes counts. Shorter
    vectors count as filled up with zeros. Scores beyond 64 bits are cut to the range. Ties go to the smaller id.
    """
    kept = usable(rows, zero=True)
    centres = np.floor(SCALE * sample(kept, nodes or node_count(rows)))
    width = centres.shape[1]

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = fitted_width(x, max(width, x.shape[1]))
        middle = fitted_width(centres, flat.shape[1])
        node = np.zeros(len(flat), np.int64)
        for at in range(0, len(flat), ROWS):
            part = flat[at:at + ROWS]
            node[at:at + ROWS] = ((middle**2).sum(1) - 2 * part @ middle.T).argmin(axis=1)
        return node, np.linalg.norm(flat - middle[node], axis=1)[:, None]

    if not len(centres):
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    known = in_blocks(placed(kept, nearest, lambda x: np.floor(SCALE * x)))
    radii = {r["node"]: (r["radius"], r["subs"]) for r in known.groupBy("node").agg(F.max(F.col("numbers")[0]).alias("radius"), F.first("subs").alias("subs")).collect()}
    names = np.array(sorted(radii))
    middle, radius, subs = centres[names], np.array([radii[n][0] for n in names.tolist()]), np.array([radii[n][1] for n in names.tolist()])
    own = known.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "node")).alias("o"))
    queries = own.select("query_id", F.col("o.v").alias("q"), F.col("o.node").alias("home"))

    def promising(frames):
        for f in frames:
            q = matrix(f["q"])
            flat = fitted_width(q, max(width, q.shape[1]))
            node = names[(flat @ fitted_width(middle, flat.shape[1]).T).argmax(axis=1)] if len(f) else []
            yield f.assign(node=np.asarray(node, np.int32), sub=[abs(hash(i)) % radii[n][1] for i, n in zip(f["query_id"], node)], bound=LOW)

    def reachable(frames):
        for f in frames:
            if len(f):
                q = matrix(f["q"])
                q = fitted_width(q, max(width, q.shape[1]))
                for who, where in meetings(cover_tree(q), q, f["bound"].to_numpy(float), fitted_width(middle, q.shape[1]), radius):
                    yield from routed(f, who, where, names, subs)

    schema = "query_id bigint, q binary, home int, node int, sub int, bound double"
    first_routes = saved(queries.mapInPandas(promising, schema))

    def block(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        x, q = matrix(data["v"]), matrix(asked["q"])
        wide = max(x.shape[1], q.shape[1])
        return Search(fitted_width(q, wide), asked["query_id"].to_numpy(), fitted_width(x, wide), data["vec_id"].to_numpy(), asked["bound"].to_numpy(float), k).run()

    result = "query_id bigint, vec_id bigint, score bigint"
    first = saved(search(known, first_routes, block, result))
    reached = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bounds = first_routes.drop("bound").join(reached, "query_id", "left").withColumn("bound", F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(LOW)))
    near = bounds.select("query_id", "q", "home", "node", "sub", "bound").repartitionByRange("home", "query_id")  # a batch holds queries that lie close
    second = search(known, near.sortWithinPartitions("home").mapInPandas(reachable, schema), block, result)
    return best(first.unionByName(second).distinct(), k, [F.desc("score")]).select("query_id", "rank", "vec_id", "score")
