"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full shingle sets, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles, stored, text_bytes, text_slices, words
from .near import band_keys, link_groups, set_id

BANDS, ROWS, WIDTH, PERCENT = 32, 4, 5, 75  # a pair at 0.75 shares a band but for 5 in a million


def _sets(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    data, starts = text_bytes(part.column("text"))
    first, _, hashes = words(data)
    cut = np.searchsorted(first, starts)
    return [shingles(hashes[a:b], width) for a, b in zip(cut, cut[1:])]


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, size of the shingle set, its id (null when empty) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = _sets(part, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "node", "keys"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Set id and shingles of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                sets = [s for s in _sets(part, width) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    names=["node", "shingles"],
                )

    return docs.select("text").mapInArrow(run, "node binary, shingles array<bigint>")


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: size of its shingle set, the smallest doc_id its links lead to, and whether that is its own.

    Documents with equal sets are linked; others are when 100 * intersection >= percent * union, checked on the
    full sets of pairs that share a band. Texts without words, and null ones, have no set, link with nothing and
    are kept. Rows with a null id are linked like others but cannot name a group; a group of such rows alone has
    a null component and is kept. Repeated rows of one id are all kept if the id is. Other columns are ignored.
    """
    known = stored(signatures(docs, bands, rows, width))
    nodes = known.filter("n_shingles > 0").groupBy("node").agg(F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        holders = nodes.join(wanted, "node").select("doc_id")
        found = shingle_sets(docs.join(holders.distinct(), docs["doc_id"].eqNullSafe(holders["doc_id"]), "left_semi"), width)
        return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])

    groups = link_groups(nodes.select("node", "keys"), sets_of, percent)
    labelled = nodes.select("node", F.col("doc_id").alias("least")).join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = labelled.join(smallest, "label").select("node", "component_id")
    return known.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
