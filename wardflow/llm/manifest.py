"""Merkle manifest of a table: blocks of eight-way trees in van Emde Boas order, block roots treated alike, sibling paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import number_rows
from .common import stored

FAN_BITS = 3  # eight nodes make a run
FAN = 1 << FAN_BITS
HEX = 64  # characters of a digest as text

BLOCK_SCHEMA = "tree bigint, total bigint, pos bigint, count int, nodes binary, root binary, ids array<bigint>, claims binary"
PATH = "array<struct<left: string, right: string>>"


def node_count(levels: int) -> int:
    return (FAN**levels - 1) // (FAN - 1)


def levels_for(leaves: int) -> int:
    """Levels of a tree with that many leaves, leaves and root included."""
    levels, width = 1, leaves
    while width > 1:
        width, levels = -(-width // FAN), levels + 1
    return levels


def address(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes `index` of a depth (0: the root) lie in a tree of that many levels.

    A tree is cut at half its height: first the upper tree, then the lower trees from left to right, each cut in
    the same way, so nodes on a way up lie close together whatever the size of a page.
    """
    at = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, shift = levels - upper, FAN_BITS * (depth - upper)
        at += node_count(upper) + (index >> shift) * node_count(lower)
        index = index & ((1 << shift) - 1)
        depth, levels = depth - upper, lower
    return at


@lru_cache(maxsize=None)
def addresses(levels: int) -> list[np.ndarray]:
    return [address(d, np.arange(FAN**d, dtype=np.int64), levels) for d in range(levels)]


def width(count: int, depth: int, levels: int) -> int:
    """Nodes at a depth over that many leaves."""
    return -(-count // FAN ** (levels - 1 - depth))


def build_block(leaves: np.ndarray, levels: int) -> np.ndarray:
    """All nodes over the leaves (rows of 32 bytes), in van Emde Boas order; absent nodes are zero."""
    nodes = np.zeros((node_count(levels), 32), np.uint8)
    nodes[addresses(levels)[levels - 1][:len(leaves)]] = leaves
    for depth in range(levels - 2, -1, -1):
        below = level_text(nodes, len(leaves), depth + 1, levels)
        run = FAN * HEX
        digests = b"".join(sha256(below[k:k + run].encode()).digest() for k in range(0, len(below), run))
        here = np.frombuffer(digests, np.uint8).reshape(-1, 32)
        nodes[addresses(levels)[depth][:len(here)]] = here
    return nodes


def level_text(nodes: np.ndarray, count: int, depth: int, levels: int) -> str:
    """The digests of a depth as text, from left to right."""
    return nodes[addresses(levels)[depth][:width(count, depth, levels)]].tobytes().hex()


def siblings(nodes: np.ndarray, count: int, levels: int) -> list[list[tuple[str, str]]]:
    """Per depth from the leaves up (the root has none): what stands left and right of each node in its run."""
    out = []
    for depth in range(levels - 1, 0, -1):
        text, run = level_text(nodes, count, depth, levels), FAN * HEX
        out.append([
            (text[at // run * run:at], text[at + HEX:(at // run + 1) * run]) for at in range(0, len(text), HEX)
        ])
    return out


def _block_levels(total: int, block_levels: int) -> int:
    """A tree that fits in one block ends there; blocks of a larger one are all full height, however few leaves they hold."""
    return block_levels + 1 if total > FAN**block_levels else levels_for(total)


def _build(block_levels: int):
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        total, first = rows["total"][0].as_py(), rows["pos"][0].as_py()
        leaves = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        nodes = build_block(leaves, _block_levels(total, block_levels))
        above = -(-total // FAN**block_levels)
        row = {
            "tree": rows["tree"][0].as_py(), "total": above, "pos": first // FAN**block_levels, "count": len(leaves), "nodes": nodes.tobytes(),
            "root": nodes[0].tobytes(), "ids": rows["doc_id"].to_pylist(), "claims": b"".join(c or b"" for c in rows["claim"].to_pylist()),
        }
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    return build


def climb(nodes: DataFrame, largest: int, block_levels: int) -> list[DataFrame]:
    """Tables of blocks, round by round: `nodes` is `(tree, total, pos, digest, doc_id, claim)`, `largest` the largest total.

    A block holds at most 8 ** `block_levels` leaves and gives its root to the next round; a tree of n leaves takes
    about log(n) / log(8 ** `block_levels`) rounds. A row with total 1 is the root of its tree.
    """
    rounds = []
    while True:
        block = F.shiftright("pos", FAN_BITS * block_levels).alias("block")
        built = stored(nodes.groupBy("tree", block).applyInArrow(_build(block_levels), BLOCK_SCHEMA))
        rounds.append(built)
        largest = -(-largest // FAN**block_levels)
        if largest == 1:
            return rounds
        nodes = built.filter("total > 1").select(
            "tree", "total", "pos", F.col("root").alias("digest"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("claim"),
        )


def _open(block_levels: int):
    """From blocks with the path of their root: one row per leaf with its own path."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                levels = _block_levels_of(block, block_levels)
                nodes = np.frombuffer(block["nodes"], np.uint8).reshape(-1, 32)
                n, inner, above = block["count"], siblings(nodes, block["count"], levels), [(s["left"], s["right"]) for s in block["path"]]
                paths = [[row[k >> (FAN_BITS * d)] for d, row in enumerate(inner)] + above for k in range(n)]
                leaves, claims = level_text(nodes, n, levels - 1, levels), block["claims"].hex()
                depth = levels - 1 + len(above)
                pairs = [s for p in paths for s in p]
                sides = pa.StructArray.from_arrays([pa.array([s[k] for s in pairs], pa.string()) for k in (0, 1)], names=["left", "right"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block["tree"]] * n, pa.int64()), pa.array(np.arange(n) + (block["pos"] << (FAN_BITS * block_levels))),
                        pa.array(block["ids"], pa.int64()), pa.array([leaves[k:k + HEX] for k in range(0, HEX * n, HEX)]),
                        pa.array([claims[k:k + HEX] for k in range(0, HEX * n, HEX)]) if claims else pa.nulls(n, pa.string()),
                        pa.array([block["subroot"]] * n, pa.string()), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * depth, sides),
                    ],
                    names=["tree", "pos", "doc_id", "leaf", "claim", "subroot", "path"],
                )

    return run


def _block_levels_of(block: dict, block_levels: int) -> int:
    """A block of a tree that goes on above it has full height; the last one of a tree has what its leaves need."""
    return block_levels + 1 if block["total"] > 1 else levels_for(block["count"])


def descend(rounds: list[DataFrame], roots: DataFrame, block_levels: int) -> DataFrame:
    """Paths of all leaves from the tables of `climb`: `roots` gives `(tree, subroot, path)` of each tree's root.

    The way goes down round by round; a block meets the path of its own root in a join with one row per block.
    """
    below, schema = None, f"tree bigint, pos bigint, doc_id bigint, leaf string, claim string, subroot string, path {PATH}"
    for blocks in reversed(rounds):
        ended = blocks.filter("total = 1").join(roots, "tree")
        if below is not None:
            ended = ended.unionByName(blocks.filter("total > 1").join(below.select("tree", "pos", "subroot", "path"), ["tree", "pos"]))
        below = ended.mapInArrow(_open(block_levels), schema)
    return below


@dataclass
class Manifest:
    """Blocks of the trees, their roots `(tree, subroot, path to the root)`, and the root of all (None: no rows)."""

    rounds: list[DataFrame]
    roots: DataFrame
    root: str | None
    block_levels: int

    def paths(self) -> DataFrame:
        """Per row: doc_id, leaf, claim, subroot, root, and the siblings on the way up, left and right of it at each level."""
        return descend(self.rounds, self.roots, self.block_levels).select(
            "doc_id", "leaf", "claim", "subroot", F.lit(self.root).alias("root"), "path",
        )


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of values one after the other: `-` for null, else UTF-8 length, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def build(docs: DataFrame, leaf: Column, claim: Column, group: str = "lang", key: str = "doc_id", block_levels: int = 4) -> Manifest:
    """Manifest of a table: a tree per group, leaves ascending by key, and a tree over the groups' roots.

    `leaf` is a row's digest (binary); `claim` the digest of what a reader holds for that row, carried along to be
    checked against the manifest. Groups are ordered by their bytes, null first and a group of its own; null keys
    come first, rows with one key are ordered by digest, and equal rows are a leaf each. An empty table has no
    root. Any other columns are free. Texts are read once; only digests, keys and groups are shuffled. Rows are
    numbered through a range partitioning that also splits equal keys and rows, so a hot group or key spreads.
    """
    spark = docs.sparkSession
    digests = stored(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(group).alias("g"), leaf.alias("digest"), claim.alias("claim"))
                     .withColumn("tie", F.monotonically_increasing_id()))
    order = [F.col(c).asc_nulls_first() for c in ("g", "doc_id", "digest", "tie")]
    numbered = number_rows(digests, order, "n")
    groups = digests.groupBy("g").agg(F.count("*").alias("total"))
    ranked = number_rows(groups, [F.col("g").asc_nulls_first()], "tree")
    first = numbered.groupBy("g").agg(F.min("n").alias("first"))
    of_group = F.col("g").eqNullSafe(F.col("h"))
    firsts = stored(ranked.select(F.col("g").alias("h"), "tree", "total").join(first, of_group).drop("g"))
    trees, largest = firsts.agg(F.count("*"), F.max("total")).first()
    if not trees:
        none = spark.createDataFrame([], BLOCK_SCHEMA)
        return Manifest([none], spark.createDataFrame([], f"tree bigint, subroot string, path {PATH}"), None, block_levels)
    nodes = numbered.join(firsts, of_group).select("tree", "total", (F.col("n") - F.col("first")).alias("pos"), "digest", "doc_id", "claim")
    rounds = climb(nodes, largest, block_levels)
    subroots = rounds[0].filter("total = 1")
    for later in rounds[1:]:
        subroots = subroots.unionByName(later.filter("total = 1"))
    tops = climb(
        subroots.select(
            F.lit(0).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("total"), (F.col("tree") - 1).alias("pos"), F.col("root").alias("digest"),
            F.col("tree").alias("doc_id"), F.lit(None).cast("binary").alias("claim"),
        ), trees, block_levels,
    )
    root = tops[-1].select(F.lower(F.hex("root"))).first()[0]
    over = spark.range(1).select(F.col("id").alias("tree"), F.lit(root).alias("subroot"), F.array().cast(PATH).alias("path"))
    roots = stored(descend(tops, over, block_levels).select(F.col("doc_id").alias("tree"), F.col("leaf").alias("subroot"), "path"))
    return Manifest(rounds, roots, root, block_levels)
