"""Flow record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import FLOW


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV with the fixed column names and types; a short or bad field becomes NULL."""
    return spark.read.schema(FLOW).csv(path, header=False)
