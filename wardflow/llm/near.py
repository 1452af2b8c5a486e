"""Similar sets without all pairs: circulant MinHash keys, a hub per bucket, exact checks, and the rest in blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, mix64, stored
from .components import components

LOOSE_SHINGLES, MEMBER_SHINGLES = 100_000, 400_000  # a block of the second check holds about so many


def set_id(shingle_set: np.ndarray) -> bytes:
    """16 bytes that name a set: equal sets, however often they occur, are one node."""
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def permuted(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def circulant_minhash(shingle_set: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates from two permutations of a circle of 2**32 places.

    The first permutation gives a shingle its place. Coordinate k is the least value of the second one after it
    has been turned by k places, so no further permutation is needed.
    """
    place = mix64(shingle_set).astype(np.uint32)
    turns = np.arange(size, dtype=np.uint32)
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 4096):
        out = np.minimum(out, permuted(place[None, at:at + 4096] - turns[:, None]).min(axis=1))
    return out


def band_keys(shingle_set: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates, bands kept apart."""
    signature = circulant_minhash(shingle_set, bands * rows).reshape(bands, rows).astype(np.uint64)
    key = mix64(np.arange(1, bands + 1, dtype=np.uint64))
    for k in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
    return key.view(np.int64)


FILTER_BITS = 1 << 27  # largest filter: 16 MB, whatever the number of nodes
FILTER_PARTS = 8


def _bits(ids: pa.Array, size: int) -> np.ndarray:
    """Two places in a filter for each id, which is a name of 16 bytes or a 64-bit hash."""
    if pa.types.is_integer(ids.type):
        hashes = ids.to_numpy(zero_copy_only=False).view(np.uint64)
        two = np.column_stack((hashes, mix64(hashes)))
    else:
        two = np.frombuffer(b"".join(ids.to_pylist()), np.uint8).view(np.uint64).reshape(-1, 2)
    return two & np.uint64(size - 1)


def filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit set that holds all nodes and few others: 16 bits for each node, but FILTER_BITS at most.

    It spares later steps the rows of most other nodes; where it is full it spares none, and joins decide anyway.
    """
    size = min(FILTER_BITS, 1 << max(16, (16 * nodes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, bool)
        for batch in batches:
            held[_bits(batch.column("node"), size).reshape(-1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(size // 8, np.uint8)
    for row in nodes.select("node").repartition(FILTER_PARTS, "node").mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    return total


def may_hold(held: np.ndarray, ids: pa.Array) -> np.ndarray:
    at = _bits(ids, 8 * len(held))
    return ((held[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def sieve(rows: DataFrame, held: np.ndarray) -> DataFrame:
    """The rows whose node the filter lets through, before they are shuffled to a join that decides exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held, batch.column("node"))))

    return rows.mapInArrow(run, rows.schema)


def similar(both: Column, n: Column, m: Column, percent: int) -> Column:
    return both * 100 >= (n + m - both) * percent


def link_groups(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, label) of all nodes with a similar other one, label being the smallest node that links lead to.

    `nodes`: node (distinct), keys array<bigint>. `sets_of` gets a table of nodes (column node) and returns
    node, shingles array<bigint>. Two nodes are linked when they share a key and the exact Jaccard similarity is
    at least `percent` hundredths.

    In every bucket (nodes with the same key) all nodes are first held against one hub, the node whose buckets
    hold most nodes: in a group of altered copies that is the original or close to it. Where a bucket still
    falls into several groups, nodes outside the bucket's largest one are held against all of the bucket's
    nodes, block by block, so that no pair is missed. Work on a bucket is linear in its nodes but for these.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(keyed.join(shared, "key"))
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = members.join(weight, "node")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("hub"))
    with_hub = members.join(hubs, "key")
    sets = stored(sets_of(members.select("node").distinct()).select("node", "shingles", F.size("shingles").alias("n")))
    pairs = with_hub.filter("node <> hub").select("node", "hub").distinct()
    links = stored(
        pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other"), F.col("n").alias("m")), "hub")
        .filter(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
        .filter(similar(F.size(F.array_intersect("shingles", "other")), F.col("n"), F.col("m"), percent))
        .select(F.col("node").alias("a"), F.col("hub").alias("b"))
    )
    first = components(links)
    drop(links)
    more = _links_of_the_rest(with_hub.filter("n > 2"), first, sets, percent)
    drop(members, sets)
    if more.isEmpty():
        return first
    joined = components(first.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    drop(first, more)
    return joined


def _links_of_the_rest(with_hub: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of a bucket that are in different groups so far; the hub's own checks are done."""
    members = (
        with_hub.filter("node <> hub").select("key", "node").join(groups, "node", "left")
        .select("key", "node", F.coalesce("label", "node").alias("label")).join(sets.select("node", F.col("n").alias("size")), "node")
    )
    per_group = members.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("size").alias("shingles"))
    open_ = (
        per_group.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("c", "shingles", "label")).alias("top"), F.sum("shingles").alias("all"))
        .filter("groups > 1")
        .select(
            "key", F.col("top.label").alias("main"), F.ceil(F.col("all") / MEMBER_SHINGLES).cast("int").alias("member_parts"),
            F.ceil((F.col("all") - F.col("top.shingles")) / LOOSE_SHINGLES).cast("int").alias("loose_parts"),
        )
    )
    rows = stored(members.join(open_, "key").select("key", "node", "label", "main", "member_parts", "loose_parts"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    loose = rows.filter("label <> main").withColumn("loose_part", part("loose_parts")).withColumn("member_part", every("member_parts"))
    other = rows.withColumn("member_part", part("member_parts")).withColumn("loose_part", every("loose_parts"))
    columns = ["key", "loose_part", "member_part", "node", "label"]
    dealt = loose.select(*columns, F.lit(True).alias("loose")).unionByName(other.select(*columns, F.lit(False).alias("loose")))

    def check(rows: pd.DataFrame) -> pd.DataFrame:
        return _block_links(rows[rows["loose"]], rows[~rows["loose"]], percent)

    found = stored(dealt.join(sets.select("node", "shingles"), "node").groupBy("key", "loose_part", "member_part").applyInPandas(check, "a binary, b binary").distinct())
    drop(rows)
    return found


def _block_links(loose: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a block that join groups: each loose node is held against all members, but two groups that are
    joined already get no further link, so a block gives fewer links than it has groups."""
    found: list[tuple[bytes, bytes]] = []
    if len(loose) and len(members):
        sizes = members["shingles"].map(len).to_numpy()
        names, codes = np.unique(np.concatenate(members["shingles"].to_list()), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ids = members["node"].to_numpy()
        groups, group_of = np.unique(np.concatenate((members["label"].to_numpy(), loose["label"].to_numpy())), return_inverse=True)
        joined = np.arange(len(groups))  # group -> the group it is joined to
        group_of, own_groups = group_of[:len(members)], group_of[len(members):]
        for node, own_group, own in zip(loose["node"], own_groups, loose["shingles"]):
            held = np.zeros(len(names), np.int64)
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            held[at[names[at] == own]] = 1
            both = np.add.reduceat(held[codes], starts)
            hits = np.flatnonzero((both * 100 >= (sizes + len(own) - both) * percent) & (joined[group_of] != joined[own_group]))
            for other in hits[np.unique(joined[group_of[hits]], return_index=True)[1]]:
                found.append((node, ids[other]))
                joined[joined == joined[group_of[other]]] = joined[own_group]
    return pd.DataFrame(found, columns=["a", "b"])
