"""Evaluation of the checks on a fixture corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evalscore, rules
from ..sources.baseline import expected_ids
from .audit import corpus_hits


def fixture_findings(fixtures: DataFrame) -> DataFrame:
    """`(file, check, rule_id)` of fixtures `(file, check, content)`: each runs its own check only."""
    hits = rules.as_findings(rules.dedupe_hits(corpus_hits(fixtures.select(F.col("file").alias("path"), "content", "check"), check="check")))
    own = fixtures.select("file", "check")
    return hits.select("file", "check", "rule_id").join(own, ["file", "check"], "left_semi")


def evaluate(fixtures: DataFrame, baseline: DataFrame) -> DataFrame:
    """Score per check against the golden ids."""
    return evalscore.check_scores(
        fixtures.select("file", "check"), expected_ids(baseline), fixture_findings(fixtures).select("file", "rule_id")
    )
