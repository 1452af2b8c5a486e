"""Requirement lists as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: every line ending the format knows.
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def names_requirement(line: Column) -> Column:
    """Not blank, not a comment, not an option."""
    return ~line.rlike(r"^(?:#|-|$)")


def numbered_lines(content: Column) -> Column:
    """Array of lines; a final line ending starts no further line."""
    return F.split(F.regexp_replace(content, f"(?:{LINE_END})\\z", ""), LINE_END)



def explode_lines(files: DataFrame) -> DataFrame:
    """`(path, line_no, raw)` of `(path, content)`."""
    return files.select("path", F.posexplode(numbered_lines(F.col("content"))).alias("pos", "raw")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "raw"
    )


def requirement_lines(files: DataFrame) -> DataFrame:
    """Lines that name a requirement, with the margins taken off in `line`."""
    return (
        explode_lines(files).withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", ""))
        .filter(names_requirement(F.col("line")))
    )
