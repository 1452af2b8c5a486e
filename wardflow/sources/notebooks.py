"""Notebook JSON to ordered cells. A notebook is one row, so nothing here shuffles."""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import MAGIC_LINE, blank_magic
from ..schemas import NOTEBOOK

_ARROW_NOTEBOOK = to_arrow_type(NOTEBOOK)


@contextmanager
def without_cycle_search() -> Iterator[None]:
    """Python's search for reference cycles is off inside, for work on one batch that makes many objects and no cycles.

    Documents and syntax trees are freed by their reference counts. The search would go through everything a worker
    keeps, once for every few thousand objects made.
    """
    searched = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if searched:
            gc.enable()


def valid_text(text: str) -> str:
    """Escapes may spell halves of surrogate pairs, which no UTF-8 text can hold."""
    if text.isascii():
        return text
    try:
        text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
    return text


def _leaves(value: object) -> list[str]:
    """All texts among the values of a JSON value, in order; keys are left out."""
    found, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            found.append(valid_text(v))
        elif isinstance(v, (list, dict)):
            todo += reversed(v if isinstance(v, list) else list(v.values()))
    return found


def read_notebook(content: str, with_outputs: bool = True) -> dict:
    """`problem` (NULL if there is none) and the code cells of one document.

    The standard library's reader takes whatever notebooks hold in practice: NaN, repeated keys, texts of any
    length. `source` may be a string or a list of strings; a cell with another kind of source is left out.
    The texts of saved outputs are gathered for those who ask for them.
    """
    try:
        document = json.loads(content)
    except (ValueError, RecursionError):
        return {"problem": "not JSON", "code": None}
    cells = document.get("cells", []) if isinstance(document, dict) else None
    if not isinstance(cells, list):
        return {"problem": "no list of cells", "code": None}
    code = []
    for i, cell in enumerate(cells):
        if isinstance(cell, dict) and cell.get("cell_type") == "code":
            source = cell.get("source", "")
            if isinstance(source, list):
                try:
                    source = "".join(source)
                except TypeError:  # what is no text is left out
                    source = "".join(s for s in source if isinstance(s, str))
            if isinstance(source, str):
                code.append({"cell_idx": i, "source": valid_text(source), "outputs": _leaves(cell.get("outputs")) if with_outputs else []})
    return {"problem": None, "code": code}


_MAGIC = re.compile(MAGIC_LINE.replace("(?md)", "(?m)"))  # only a newline ends a line here anyway


def joined_code(code: list[dict]) -> tuple[str, list[int]]:
    """What `module_text` and `cell_starts` give, for a worker that goes on with the cells it has read."""
    starts = [1]
    for cell in code:
        starts.append(starts[-1] + cell["source"].count("\n") + 1)
    return "\n".join([_MAGIC.sub("", s) if "!" in s or "%" in s else s for s in (cell["source"] for cell in code)]), starts


@F.arrow_udf(NOTEBOOK)
def _read(contents: pa.Array) -> pa.Array:
    with without_cycle_search():
        return pa.array([None if c is None else read_notebook(c) for c in contents.to_pylist()], type=_ARROW_NOTEBOOK)


# The optimizer copies deterministic expressions into filters; a document is to be read once.
_read_once = _read.asNondeterministic()


def parsed(content: Column | str) -> Column:
    """Struct (problem, code) of a document."""
    return _read_once(content)


def code_cells(content: Column | str) -> Column:
    """Array of (cell_idx, source, outputs) of the code cells; `cell_idx` counts all cells, markdown included.

    `outputs` are the texts of the saved outputs, decoded. NULL where the document has no cells to read.
    """
    return parsed(content)["code"]


def explode_code_cells(notebooks: DataFrame) -> DataFrame:
    """`(path, code_idx, cell_idx, source, outputs)`: one row per code cell of `(path, content)`.

    The outer explode keeps the optimizer from testing the array's size (parsing every document a
    second time) in front of it.
    """
    return (
        notebooks.select("path", F.posexplode_outer(code_cells("content")).alias("code_idx", "c"))
        .filter(F.col("c").isNotNull()).select("path", "code_idx", "c.cell_idx", "c.source", "c.outputs")
    )


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def module_text(code: Column) -> Column:
    """The code cells joined by newlines, shell lines blanked."""
    return F.array_join(F.transform(code, lambda c: blank_magic(c["source"])), "\n")


def cell_starts(code: Column) -> Column:
    """1-based line of the joined module each cell starts at, plus where a next cell would start."""
    return F.aggregate(
        F.transform(code, lambda c: newline_count(c["source"]) + 1),
        F.array(F.lit(1)),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
    )


def with_module(notebooks: DataFrame) -> DataFrame:
    """Add `code`, `module` and `cell_starts` to `(path, content)`; NULL where a document has no cells."""
    return (
        notebooks.withColumn("code", code_cells("content"))
        .withColumn("module", module_text(F.col("code")))
        .withColumn("cell_starts", cell_starts(F.col("code")))
    )


def code_cell_of(line: Column, cell_starts: Column) -> Column:
    """0-based code cell that holds a line of the joined module."""
    last = F.size(cell_starts) - 2
    return F.least(last, F.size(F.filter(cell_starts, lambda s: s <= line)) - 1)


def line_in_cell(line: Column, cell_starts: Column) -> Column:
    """Line within its code cell, kept inside the cell."""
    cell = code_cell_of(line, cell_starts)
    start, after = F.element_at(cell_starts, cell + 1), F.element_at(cell_starts, cell + 2)
    return F.greatest(F.lit(1), F.least(line - start + 1, after - start))


def marked_line(line: Column, cell_starts: Column) -> Column:
    """The same line when a marker line is put between cells."""
    return line + code_cell_of(line, cell_starts)
