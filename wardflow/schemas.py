"""Declared schemas; nothing in the library infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T

from .dims import FLOW_COLUMNS

_STRING, _INT, _LONG, _DOUBLE, _BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
)
_STRINGS = T.ArrayType(_STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _flow_type(name: str) -> T.DataType:
    if name in ("protocol_type", "service", "flag", "label"):
        return _STRING
    if name in ("src_bytes", "dst_bytes"):
        return _LONG
    return _DOUBLE if name.endswith("_rate") else _INT


FLOW = T.StructType([T.StructField(name, _flow_type(name)) for name in FLOW_COLUMNS])

FIX = _struct(summary=_STRING, diff=_STRING, replacement=_STRING, confidence=_STRING)

FINDING = _struct(
    rule_id=_STRING, check=_STRING, severity=_STRING, category=_STRING, file=_STRING, line_start=_INT,
    line_end=_INT, message=_STRING, evidence=_STRING, fix=FIX,
)

CALL_SITE = _struct(
    kind=_STRING, qualified_name=_STRING, attr=_STRING, bare_name=_STRING, first_arg_name=_STRING,
    first_arg_text=_STRING, first_arg_is_literal=_BOOL, kwargs=T.MapType(_STRING, _STRING), strings=_STRINGS,
    line_start=_INT, line_end=_INT, evidence=_STRING, object=_STRING, args=T.ArrayType(_struct(name=_STRING, text=_STRING)),
)

NOTEBOOK = _struct(problem=_STRING, code=T.ArrayType(_struct(cell_idx=_INT, source=_STRING, outputs=_STRINGS)))

BASELINE = _struct(
    schema_version=_INT, fixtures=T.ArrayType(_struct(file=_STRING, expected_ids=_STRINGS))
)

NEIGHBOUR = _struct(id=_LONG, neighbour_id=_LONG, distance=_DOUBLE)

VERDICT = _struct(
    run_id=_STRING, ord=_INT, rule_id=_STRING, file=_STRING, line_start=_INT, confirmed=_BOOL,
    confidence=_STRING, reasoning=_STRING,
)
