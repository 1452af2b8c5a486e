"""Ranking, prefix sums and exact selection without one task ever holding a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PREFIX = 3  # hex digits: a group falls into 4,096 parts, one of which is sorted


def fit_quota(df: DataFrame, group: str, key: str, hashed: Column, quotas: DataFrame) -> DataFrame:
    """Per group, the exact (hash, key) up to which `quota` rows lie: `(g, h, k)`, written to shared storage.

    `quotas` is `(g, quota)`. The order is by (hash, key); rows must have unique keys. Counts of hash prefixes
    tell which prefix holds the edge; only the rows of that prefix are sorted, so no group, however large, is
    sorted as a whole. Groups with a quota of 0 have no row; a quota larger than the group is an error.
    """
    base = df.select(F.col(group).alias("g"), F.col(key).alias("k"), hashed.alias("h"), F.substring(hashed, 1, PREFIX).alias("p"))
    histogram = base.groupBy("g", "p").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("p"))
    wanted = quotas.filter("quota > 0")
    edges = (
        histogram.withColumn("upto", upto).join(wanted, "g").filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("g", "p", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))
    )
    place = F.row_number().over(Window.partitionBy("g", "p").orderBy("h", "k"))
    last = base.join(edges, ["g", "p"]).withColumn("place", place).filter(F.col("place") == F.col("rest")).select("g", "h", "k")
    cuts = cut_lineage(wanted.join(last, "g", "left").select("g", "h", "k"))
    short = cuts.filter("h IS NULL").select("g").head(5)
    if short:
        raise ValueError(f"quota larger than the group: {[r['g'] for r in short]}")
    return cuts


def mark_quota(df: DataFrame, group: str, key: str, hashed: Column, cuts: DataFrame, out: str) -> DataFrame:
    """Add `out`: whether a row is among those that `fit_quota` selected.

    One join with a row per group; a group with most of the rows is split by the adaptive skew join where the
    cuts are too many to be broadcast.
    """
    bounds = cuts.select(F.col("g").alias("_cut_group"), F.col("h").alias("_cut_hash"), F.col("k").alias("_cut_key"))
    inside = (hashed < F.col("_cut_hash")) | ((hashed == F.col("_cut_hash")) & (F.col(key) <= F.col("_cut_key")))
    return (
        df.join(bounds, F.col(group) == F.col("_cut_group"), "left").withColumn(out, F.coalesce(inside, F.lit(False)))
        .drop("_cut_group", "_cut_hash", "_cut_key")
    )


def running_total(
    df: DataFrame, group: str, position: str, amount: Column, out: str, chunk: int = 4096
) -> DataFrame:
    """Sum of `amount` over the earlier positions of the group, in two levels.

    Positions are unique integers within a group. Each window holds one chunk of positions, the
    upper level one row per chunk, so a group with a third of all rows spreads over many tasks.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(position) / chunk)).withColumn("_amount", amount)
    inside = Window.partitionBy(group, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    part = cut.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(group, "_chunk").agg(F.sum("_amount").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    )
    return (
        part.join(offsets, [group, "_chunk"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_chunk", "_amount", "_inside", "_before")
    )


def number_rows(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Consecutive numbers from 1 in the given (unique) order over the whole table.

    Rows are range-partitioned and sorted; each partition then adds the sizes of the ones before
    it. The sorted rows are checkpointed first, so both passes see the same ranges even if
    executors are lost in between. The size table has one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of the range shuffle
        .withColumn(out, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_id", "_part", "_offset")
    )
