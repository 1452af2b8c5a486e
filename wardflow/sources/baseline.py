"""Golden baselines: the finding ids each fixture file is expected to give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schemas import BASELINE


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """`(file, expected_ids)` per fixture; a missing file is an empty baseline."""
    try:
        documents = spark.read.schema(BASELINE).json(path, multiLine=True)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        documents = spark.createDataFrame([], BASELINE)
    return explode_baseline(documents)


def parse_baseline(payloads: DataFrame) -> DataFrame:
    """The same from a column of JSON text."""
    return explode_baseline(payloads.select(F.from_json("payload", BASELINE).alias("b")).select("b.*"))


def explode_baseline(documents: DataFrame) -> DataFrame:
    return documents.select(F.inline("fixtures")).select(
        "file", F.coalesce("expected_ids", F.array().cast("array<string>")).alias("expected_ids")
    )


def expected_ids(baseline: DataFrame) -> DataFrame:
    """One row per expected id, repeats kept."""
    return baseline.select("file", F.explode("expected_ids").alias("rule_id"))
