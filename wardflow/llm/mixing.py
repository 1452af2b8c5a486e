"""Mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stored

SLICES = 4096  # parts of the shuffled order of a source, and of a stretch of virtual time

WORDS = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(docs: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """One row per source: its size and its share of all sizes by weight, at most `repeats` times its size.

    Sharing the excess again until no source is above its cap means one level for all: a source gets
    weight * level or its cap. With the sources ordered by cap / weight, the level is the largest of
    (what is left after the caps before) / (weights from here on).
    """
    by_name = Window.orderBy("_none", "_name")
    by_ratio = Window.orderBy("_ratio", "_none", "_name")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("_none", "_name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    return (
        docs.groupBy("_none", "_name").agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("double"))
        .withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest))
        .withColumn("target", F.least("_cap", F.col("_weight") * F.max("_level").over(every)))
        .select("_none", "_name", "source_size", "target", (F.lit(lcm(*weights)) / F.col("_weight")).cast("bigint").alias("_tick"))
    )


def sized(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each document with its size, its source and its place in a shuffled order, that of a hash."""
    return docs.select(
        "doc_id", word_count(F.col("text")).alias("size"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"),
        F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1)).alias("_order"), *[c for c in keep if c != "doc_id"],
    ).withColumn("_slice", F.shiftright("_order", 63 - 12))


def queued(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Each document with its source's target and the words of its source shuffled before it.

    Sums run in two levels, over the SLICES parts of a source and within a part, so a source with a third of all
    rows spreads over many tasks.
    """
    part = Window.partitionBy("_none", "_name").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_none", "_name", "_slice").agg(F.sum("size").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(part), F.lit(0))).drop("_sum").join(per_source, ["_none", "_name"])
    )
    within = Window.partitionBy("_none", "_name", "_slice").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(offsets, ["_none", "_name", "_slice"])
        .withColumn("_start", F.col("_offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .drop("_offset", "_slice")
    )


def sent(upto: Column, begin: Column) -> Column:
    """Words of a copy that are out when its source has sent `upto` words, `begin` of them before the copy."""
    return F.greatest(F.lit(0), F.least(F.col("size"), upto - begin))


def words_at(time: Column) -> Column:
    """Words that a source with copies enough has sent at a virtual time."""
    return F.call_function("div", time + F.col("_tick"), 2 * F.col("_tick"))


def time_of(word: Column) -> Column:
    """Virtual time of a source's k-th word, when half of it is out: (k - 1/2) / weight, in ticks so that it is whole."""
    return (2 * word - 1) * F.col("_tick")


def cut_point(queue: DataFrame, repeats: int, budget: int) -> tuple[int, bool, str] | None:
    """The last word of the mix: its virtual time, and the last source (in order) that still sends its word of that time.

    A copy's finish time is that of its last word. Copies of all sources compete, a source's copies one after the other. The words of the copies
    are counted by slices of virtual time, the slice in which the budget ends is sliced again, until it is
    one tick. Each count is one group-by; the driver sees one row of it. None when the budget takes every copy.
    """
    begin = F.col("_start") + F.col("_pass") * F.col("source_size")
    copies = queue.filter("size > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(
        "_none", "_name", "size", begin.alias("_begin"), "_tick", time_of(begin + F.col("size")).alias("_finish"),
        time_of(begin + 1).alias("_first"))
    total, last = copies.agg(F.sum("size"), F.max("_finish")).first()
    if total is None or budget >= total:
        return None
    low, high, before = 0, last, 0  # the cut lies in (low, high]; `before` words are out at low
    while high - low > 1:
        width = -(-(high - low) // SLICES)
        slice_of = lambda v: F.least(F.lit(SLICES - 1), F.greatest(F.lit(0), F.floor((v - 1 - low) / width)))
        out = lambda j: sent(words_at(F.least(F.lit(high), F.lit(low) + j * width)), F.col("_begin"))
        counts = (
            copies.filter((F.col("_first") <= high) & (F.col("_finish") > low))
            .withColumn("j", F.explode(F.sequence(slice_of(F.col("_first")), slice_of(F.col("_finish"))))).groupBy("j").agg(F.sum(out(F.col("j") + 1) - out(F.col("j"))).alias("n"))
        )
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("j")))  # a row per slice
        cut = upto.filter(F.col("upto") + before > budget).orderBy("j").first()
        before, low = before + cut["upto"] - cut["n"], low + cut["j"] * width
        high = min(high, low + width)
    # At one tick a source has one word at most; the first sources in order still send theirs.
    there = copies.filter(f"{high} % (2 * _tick) = _tick AND {high} BETWEEN _first AND _finish").select("_none", "_name").orderBy("_none", "_name")
    edge = there.limit(budget - before).agg(F.max(F.struct("_none", "_name")).alias("e")).first()["e"]
    return (high, False, "") if edge is None else (high, edge["_none"], edge["_name"])


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, budget: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every document with its size in words, its source's size and target, and the words taken of it.

    Sources in code point order (null last) get the weights (whole numbers) in turn. A source sends its documents in a
    shuffled order, up to `repeats` times. A word's virtual time is the number of words that its source has sent up to its
    middle, divided by the weight; over all sources words go out by virtual time, at the same time in order of the sources,
    and the mix ends at `budget` words (default: all sizes), which alone decides what is taken: sources that are short
    send all their copies, the others get on as their weights are, and so each meets its target to a word. A document in
    service at the end is cut. `copies` counts the copies of which at least half is taken.

    Null and blank texts have size 0 and nothing is taken of them. Null sources are one source. Repeated rows
    queue one by one. Columns named in `keep` are carried, others are not. The order is a hash of id and
    text, so reruns agree.
    """
    clash = {"size", "source_size", "target", "taken", "copies"} & set(keep)
    if clash:
        raise ValueError(f"kept columns clash with results: {sorted(clash)}")
    if any(w != int(w) or w < 1 for w in weights):
        raise ValueError("weights must be whole numbers above 0")
    rows = stored(sized(docs, keep))  # texts are read and counted once
    per_source = stored(targets(rows, weights, repeats))
    slim = stored(queued(rows.select("doc_id", "size", "_none", "_name", "_order", "_slice"), per_source))
    if budget is None:
        budget = per_source.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    end = cut_point(slim, repeats, budget)
    queue = queued(rows, per_source) if keep else slim
    if keep:
        drop(slim)
    amounts = []
    for p in range(repeats):
        begin, words = F.col("_start") + p * F.col("source_size"), F.col("size")
        if end is not None:
            high, none, name = end
            late = (F.lit(high) % (2 * F.col("_tick")) == F.col("_tick")) & (F.struct("_none", "_name") > F.struct(F.lit(none).alias("_none"), F.lit(name).alias("_name")))
            words = sent(words_at(F.lit(high)) - late.cast("bigint"), begin)
        amounts.append(words)
    return queue.select(
        "doc_id", "size", "source_size", "target", sum(amounts, F.lit(0)).cast("bigint").alias("taken"),
        sum([((a * 2 >= F.col("size")) & (a > 0)).cast("int") for a in amounts], F.lit(0)).alias("copies"), *[c for c in keep if c != "doc_id"],
    )
