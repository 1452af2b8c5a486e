"""Flow exploration: categories, unknown labels, shares, correlations, variances, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CLASSES, DEFAULT_CATEGORY, class_ids, taxonomy
from .comoments import comoments


def drop_label_proxy(flows: DataFrame) -> DataFrame:
    """Without the column that tells how hard a record is to classify."""
    return flows.drop("difficulty_level")


def categorise(flows: DataFrame, default: str | None = DEFAULT_CATEGORY, table: DataFrame | None = None) -> DataFrame:
    """Add `category`; unknown labels take the default, or are removed when it is None."""
    table = taxonomy(flows.sparkSession) if table is None else table
    if default is None:
        return flows.join(table, "label")
    return flows.join(table, "label", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def encode_category(flows: DataFrame, fallback: str | None = None) -> DataFrame:
    """Add `class_id`; categories outside the list take the fallback's id, or are an error to keep NULL."""
    found = flows.join(class_ids(flows.sparkSession), "category", "left")
    if fallback is None:
        return found
    return found.withColumn("class_id", F.coalesce("class_id", F.lit(CLASSES.index(fallback))))


def binary_label(category: Column) -> Column:
    return F.when(category == "Normal", 0).otherwise(1)


def unknown_labels(flows: DataFrame, by: str = "split") -> DataFrame:
    """Rows and share (%) of each label the taxonomy does not know, per split.

    Labels are counted before the taxonomy is looked at, so the anti-join sees one row per label.
    """
    counts = flows.groupBy(by, "label").agg(F.count("*").alias("rows"))
    share = F.round(F.col("rows") * 100.0 / F.col("_all"), 2)
    return (
        counts.withColumn("_all", F.sum("rows").over(Window.partitionBy(by)))
        .join(taxonomy(flows.sparkSession), "label", "left_anti")
        .select(by, "label", "rows", share.alias("share_pct"))
    )


def unknown_summary(flows: DataFrame, by: str = "split") -> DataFrame:
    """Unknown rows and share (%) per split; splits without any have a zero row."""
    counts = flows.groupBy(by, "label").agg(F.count("*").alias("rows"))
    known = taxonomy(flows.sparkSession).select("label", F.lit(True).alias("_known"))
    missed = F.sum(F.when(F.col("_known").isNull(), F.col("rows")).otherwise(0))
    return counts.join(known, "label", "left").groupBy(by).agg(
        missed.alias("unknown_rows"), F.round(missed * 100.0 / F.sum("rows"), 2).alias("share_pct")
    )


def known_rows(flows: DataFrame) -> DataFrame:
    return flows.join(taxonomy(flows.sparkSession), "label", "left_semi")


def counts_with_share(df: DataFrame, key: str) -> DataFrame:
    """Rows and share (%) per value; the share's total runs over the counted rows only."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    total = F.sum("rows").over(Window.partitionBy())  # one row per value
    return counts.select(key, "rows", F.round(F.col("rows") * 100.0 / total, 2).alias("share_pct"))


def protocol_by_category(flows: DataFrame, rows: str = "protocol_type") -> DataFrame:
    """Cross-tab; the fixed class list saves the pass that would look for pivot values."""
    return flows.groupBy(rows).pivot("category", list(CLASSES)).agg(F.count(F.lit(1))).na.fill(0)


def class_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"))


def class_shortfall(df: DataFrame, key: str) -> DataFrame:
    """Rows per class, the majority's size, and what each class lacks to reach it."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    return counts.withColumn("majority", F.max("rows").over(Window.partitionBy())).withColumn(  # one row per class
        "shortfall", F.col("majority") - F.col("rows")
    )


def top_values(df: DataFrame, group: str, value: str, k: int = 5) -> DataFrame:
    """The k most frequent values per group, ties by value; windows see counted rows only."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("rows"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("rows"), F.asc(value)))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


# --- numeric columns ----------------------------------------------------------------------------

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [name for name, kind in df.dtypes if kind in numeric and name not in exclude]


def _melt(one_row: DataFrame, names: Sequence[str], out: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).cast("double").alias(out)) for n in names])
    return one_row.select(F.inline(pairs))


def column_variances(df: DataFrame, columns: Sequence[str], population: bool = False) -> DataFrame:
    """Variance per column, from one aggregate over all of them."""
    measure = F.var_pop if population else F.var_samp
    return _melt(df.agg(*[measure(c).alias(c) for c in columns]), columns, "variance")


def smallest_variances(df: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    return column_variances(df, columns).orderBy(F.asc_nulls_last("variance"), "column").limit(k)


def near_constant(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Population variance per column and whether the column is kept (variance above threshold)."""
    return column_variances(df, columns, population=True).withColumn("kept", F.col("variance") > threshold)


def label_correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of each column with the label, over the rows that have both; NULL when a side is constant."""
    return comoments(df, columns, [label]).select(F.col("a").alias("column"), "correlation")


def top_correlated(correlations: DataFrame, k: int) -> DataFrame:
    """Strongest first; constant columns have no correlation and come last."""
    return correlations.withColumn("strength", F.abs("correlation")).orderBy(
        F.desc_nulls_last("strength"), F.asc("column")
    ).limit(k)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs of the given columns, from one pass whose plan does not grow with their number."""
    return comoments(df, columns).select("a", "b", "correlation")


def strongest_matrix(df: DataFrame, columns: Sequence[str], label: str, k: int = 15) -> DataFrame:
    """Correlations among the k columns most correlated with the label, and with the label itself."""
    top = [r["column"] for r in top_correlated(label_correlations(df, columns, label), k).collect()]  # k rows
    return correlation_matrix(df, [*top, label])


# --- single rows --------------------------------------------------------------------------------

def first_row(df: DataFrame, order: str, where: Column, by: Sequence[str] = ()) -> DataFrame:
    """First matching row in file order, per group; an aggregate, not a sort."""
    rest = [c for c in df.columns if c not in by]
    found = df.filter(where).groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return found.filter(F.col("r").isNotNull()).select(*by, "r.*")


def most_confident(df: DataFrame, by: str, confidence: str, key: str) -> DataFrame:
    """Row of highest confidence per group, the earlier one on ties."""
    rest = [c for c in df.columns if c != by]
    best = F.max_by(F.struct(*rest), F.struct(F.col(confidence), -F.col(key)))
    return df.groupBy(by).agg(best.alias("r")).select(by, "r.*")


def representative_case(
    df: DataFrame, confidence: str, key: str, lo: float = 0.85, hi: float = 0.95, by: Sequence[str] = ()
) -> DataFrame:
    """First row with confidence in [lo, hi), per group; if there is none, the most confident row."""
    inside = (F.col(confidence) >= lo) & (F.col(confidence) < hi)
    row = F.struct(*df.columns)
    chosen = df.groupBy(*by).agg(
        F.min_by(row, F.when(inside, F.col(key))).alias("_in"),
        F.max_by(row, F.struct(F.col(confidence), -F.col(key))).alias("_top"),
    ).select(F.coalesce("_in", "_top").alias("r"))
    return chosen.filter(F.col("r").isNotNull()).select("r.*")


def confident_probes(df: DataFrame, key: str, probabilities: str, limit: int = 100, above: float = 0.7) -> DataFrame:
    """Of the first `limit` probes, those the model is sure about."""
    return df.orderBy(key).limit(limit).filter(F.array_max(probabilities) > above)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: the n smallest hashes, found without sorting the table."""
    from ..functions.rng import hash_hex

    return df.orderBy(hash_hex(seed, F.col(key)), key).limit(n)
