"""Severity ladder arithmetic. Severities are never compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import REPORT_LEVEL, SECURITY_SCORE, SEVERITY_LADDER, TOOL_SEVERITY, lookup

_RANKS = {name: i for i, name in enumerate(SEVERITY_LADDER)}
BLOCKING_RANK = _RANKS["high"]


def rank(severity: Column) -> Column:
    """Position on the ladder; unknown names rank as info."""
    return lookup(_RANKS, severity, 0)


def at_rank(position: Column) -> Column:
    ladder = F.array(*[F.lit(s) for s in SEVERITY_LADDER])
    top = len(SEVERITY_LADDER) - 1
    return F.element_at(ladder, (F.greatest(F.lit(0), F.least(position, F.lit(top))) + 1).cast("int"))


def bump(severity: Column, steps: Column) -> Column:
    """Up the ladder, stopping at critical."""
    return at_rank(rank(severity) + steps)


def downgrade(severity: Column, steps: Column | int = 1) -> Column:
    """Down the ladder, stopping at low; low and info stay as they are."""
    steps = F.lit(steps) if isinstance(steps, int) else steps
    position = rank(severity)
    lowered = F.greatest(position - steps, F.lit(_RANKS["low"]))
    return F.when(position <= _RANKS["low"], severity).otherwise(at_rank(lowered))


def from_tool(raw: Column) -> Column:
    """External scanner severity to ours; anything unknown is medium."""
    return lookup(TOOL_SEVERITY, raw, "medium")


def report_level(severity: Column) -> Column:
    return lookup(REPORT_LEVEL, severity)


def security_score(severity: Column) -> Column:
    return lookup(SECURITY_SCORE, severity)


def is_blocking(severity: Column) -> Column:
    return rank(severity) >= BLOCKING_RANK
