"""Inputs that a check could not look at, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import file_kind
from . import callsites as cs


def unreadable(files: DataFrame) -> DataFrame:
    """`(path, reason)` of the files `(path, content)` that give no findings because they cannot be read.

    `content` is NULL where a file is not UTF-8. A notebook may not be JSON or have no list of cells; the source of
    a notebook or Python file may not parse (looked at where it holds a word that a rule asks about).
    """
    kind = file_kind(F.col("path"))
    opened = files.select("path", "content", kind.alias("kind")).filter(F.col("kind").isNotNull())
    source = F.when(F.col("kind") != "requirements", F.col("content"))
    looked_at = opened.withColumn("problem", cs.document_problem(source, F.col("kind") == "notebook"))
    reason = F.when(F.col("content").isNull(), "not UTF-8").otherwise(F.col("problem"))
    return looked_at.select("path", reason.alias("reason")).filter(F.col("reason").isNotNull())
