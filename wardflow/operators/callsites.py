"""Calls and assignments of a source text, as facts for the relational rules.

This is the one step that needs Python per file: the standard library parses the text, and only
the few facts the rules ask about leave the worker. Everything after it is Spark expressions.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schemas import CALL_SITE
from ..sources.notebooks import joined_code, read_notebook, valid_text, without_cycle_search

# --- Fixed values: the calls the rules look at --------------------------------------------------
LOADERS = ("joblib.load", "pickle.load", "pickle.loads", "cPickle.load", "torch.load", "numpy.load")
FIT_METHODS = ("fit", "fit_transform", "fit_resample")
SPLIT = "train_test_split"
DROP = "drop"
DROP_KEYWORDS = ("columns", "labels")
REMEMBERED_TEXTS, REMEMBERED_LENGTH = 4096, 16_384  # texts whose facts a Python worker keeps: so many, up to this length
ORIGINS = ", "  # between the names a callee may have, where several imports bind its root

# A file without any of these words has no fact a rule could use, so it is never sent to Python.
WORTH_PARSING = (
    r"(?i)load|fit|train_test_split|difficulty|_label|_target|target_|label_|outcome|result_class"
    r"|class_id|_fraud|_leak|leak_|cheat_"
)

_FIELDS = CALL_SITE.fieldNames()
_ARROW_FACTS = to_arrow_type(T.ArrayType(CALL_SITE))
_READ = T.StructType([T.StructField("cell_starts", T.ArrayType(T.IntegerType())), T.StructField("facts", T.ArrayType(CALL_SITE))])
_ARROW_READ = to_arrow_type(_READ)
NO_PARSE = "source does not parse"


_LEAVES = (ast.Constant, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_NAMED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_SCOPED = (*_FUNCTIONS, ast.ClassDef, *_COMPREHENSIONS)
# Most nodes bind nothing and open no scope: one look at their class tells.
_PLAIN = frozenset({
    ast.Module, ast.Expr, ast.Assign, ast.AnnAssign, ast.AugAssign, ast.Call, ast.Attribute, ast.Subscript, ast.Tuple, ast.List, ast.keyword,
    ast.BinOp, ast.Compare, ast.If, ast.For, ast.Return, ast.Slice, ast.Dict, ast.Starred,
})
_ASSIGNMENTS = (ast.Assign, ast.AnnAssign)


class _Scope:
    """Names bound in a module, class, function or comprehension; imports with every origin they may have."""

    def __init__(self, outer: _Scope | None, is_class: bool = False) -> None:
        self.outer, self.is_class = outer, is_class
        self.origins: dict[str, set[str]] = {}

    def bind(self, name: str, origin: str | None = None) -> None:
        known = self.origins.setdefault(name, set())
        if origin is not None:
            known.add(origin)

    def lookup(self, name: str) -> set[str]:
        """All origins in the nearest scope that binds the name; a class's names are not seen from its functions."""
        scope: _Scope | None = self
        while scope is not None:
            if name in scope.origins and (scope is self or not scope.is_class):
                return scope.origins[name]
            scope = scope.outer
        return set()


def _kinds_below(base: type) -> list[type]:
    return [base, *(kind for sub in base.__subclasses__() for kind in _kinds_below(sub))]


# Values of a field that are no node to go on with.
_NO_NODES = frozenset(kind for base in _LEAVES for kind in _kinds_below(base)) | {str, bytes, int, float, complex, bool, type(None), type(...)}


def _children(node: ast.AST) -> list[ast.AST]:
    found: list[ast.AST] = []
    for field in node._fields:
        value = getattr(node, field, None)
        kind = type(value)
        if kind is list:
            found += [v for v in value if type(v) not in _NO_NODES]
        elif kind not in _NO_NODES:
            found.append(value)
    return found


def _enter(node: ast.AST, scope: _Scope) -> list[tuple[ast.AST, _Scope]]:
    """What `node` binds, and its children with the scope each belongs to, in source order."""
    if isinstance(node, ast.Import):
        for item in node.names:
            top = item.name.split(".")[0]
            scope.bind(item.asname or top, item.name if item.asname else top)
        return []
    if isinstance(node, ast.ImportFrom):
        for item in node.names:
            scope.bind(item.asname or item.name, f"{node.module}.{item.name}" if node.module and not node.level else None)
        return []
    if isinstance(node, _NAMED):
        scope.bind(node.name)
    if isinstance(node, ast.ExceptHandler) and node.name:
        scope.bind(node.name)
    if isinstance(node, _SCOPED):
        inner = _Scope(scope, isinstance(node, ast.ClassDef))
        outside: set[int] = set()
        if isinstance(node, _FUNCTIONS):
            a = node.args
            for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))):
                inner.bind(arg.arg)
            outside = {id(n) for n in (node.args, *getattr(node, "decorator_list", ()), getattr(node, "returns", None)) if n is not None}
        elif isinstance(node, ast.ClassDef):
            outside = {id(n) for n in (*node.decorator_list, *node.bases, *node.keywords)}
        return [(child, scope if id(child) in outside else inner) for child in _children(node)]
    return [(child, scope) for child in _children(node)]


def _nodes_of_interest(tree: ast.Module) -> list[tuple[ast.AST, _Scope]]:
    """Assignments and calls with their scopes: depth first, parents before children, in source order."""
    found, stack = [], [(tree, _Scope(None))]
    while stack:
        node, scope = stack.pop()
        kind = type(node)
        if kind is ast.Name:  # the most frequent node has no children
            if type(node.ctx) is not ast.Load:
                scope.bind(node.id)
            continue
        if kind is ast.Call or kind in _ASSIGNMENTS:
            found.append((node, scope))
        if kind in _PLAIN:
            stack += [(child, scope) for child in reversed(_children(node))]
        else:
            stack += reversed(_enter(node, scope))
    return found


def _dotted(node: ast.expr, scope: _Scope) -> set[str]:
    """Full dotted names a callee may have, by every import its root may come from."""
    tail: list[str] = []
    while isinstance(node, ast.Attribute):
        tail.insert(0, node.attr)
        node = node.value
    return {".".join([origin, *tail]) for origin in scope.lookup(node.id)} if isinstance(node, ast.Name) else set()


def _is_one_token(segment: str) -> bool:
    """Whether the source of a text constant is a single literal, not several put side by side."""
    quote = segment[-1:]
    if segment.count("'") + segment.count('"') == 2 and segment.count(quote) == 2:
        return True
    tokens = tokenize.generate_tokens(io.StringIO(f"({segment})").readline)
    return sum(t.type == tokenize.STRING for t in tokens) == 1


def _strings(rows: list[bytes], node: ast.expr | None) -> list[str]:
    """Text constants in a constant, list or tuple, nested ones included; concatenated ones are left out."""
    if isinstance(node, (ast.List, ast.Tuple)):
        return [text for item in node.elts for text in _strings(rows, item)]
    if isinstance(node, ast.Constant) and isinstance(node.value, str) and _is_one_token(_segment(rows, node)):
        return [valid_text(node.value)]  # an escape may spell half of a surrogate pair
    return []


def _segment(rows: list[bytes], node: ast.AST) -> str:
    """Source text of a node; positions count UTF-8 bytes."""
    part = rows[node.lineno - 1:node.end_lineno]
    part[-1] = part[-1][:node.end_col_offset]
    part[0] = part[0][node.col_offset:]
    return b"\n".join(part).decode("utf-8", "replace")


def _args(node: ast.Call, rows: list[bytes]) -> list[tuple[str | None, str]]:
    """Arguments in order as (keyword, `*`, `**` or None, text in normal form)."""
    def text(value: ast.expr) -> str:
        try:
            return valid_text(ast.unparse(value))
        except (RecursionError, ValueError):
            return _segment(rows, value)

    placed = [("*", text(a.value)) if isinstance(a, ast.Starred) else (None, text(a)) for a in node.args]
    return placed + [(k.arg or "**", text(k.value)) for k in node.keywords]


def call_sites(source: str, wanted: frozenset[str] = frozenset()) -> list[tuple] | None:
    """Facts in source order; None for a text that does not parse.

    Calls of the names in `wanted` (`*`: of all) carry their object and arguments, for declared rules.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows = source.replace("\r\n", "\n").replace("\r", "\n").encode("utf-8", "replace").split(b"\n")
    facts: list[tuple] = []
    for node, scope in _nodes_of_interest(tree):
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            texts = _strings(rows, node.value)
            if texts:
                facts.append((
                    "annotated" if isinstance(node, ast.AnnAssign) else "assign", None, None, None, None, None,
                    None, {}, texts, node.lineno, node.end_lineno, _segment(rows, node.value), None, [],
                ))
        elif isinstance(node, ast.Call):
            attr = node.func.attr if isinstance(node.func, ast.Attribute) else None
            bare = node.func.id if isinstance(node.func, ast.Name) else None
            names = _dotted(node.func, scope)
            if bare and any(name.endswith("." + SPLIT) for name in names):
                bare = SPLIT  # imported under another name
            loaders = sorted(names.intersection(LOADERS))
            asked = "*" in wanted or (attr or bare) in wanted or any(name.rpartition(".")[2] in wanted for name in names)
            if not (asked or loaders or attr in FIT_METHODS or SPLIT in (attr, bare) or attr == DROP):
                continue
            full = ORIGINS.join(loaders or sorted(names)) or None
            first = node.args[0] if node.args else None
            kwargs = {k.arg: _segment(rows, k.value) for k in node.keywords if k.arg}
            dropped = [
                text for k in node.keywords if attr == DROP and k.arg in DROP_KEYWORDS for text in _strings(rows, k.value)
            ]
            facts.append((
                "call", full, attr, bare, first.id if isinstance(first, ast.Name) else None,
                None if first is None or isinstance(first, ast.Starred) else _segment(rows, first),
                isinstance(first, (ast.List, ast.Tuple, ast.Set)), kwargs, dropped,
                node.lineno, node.end_lineno, _segment(rows, node),
                _segment(rows, node.func.value) if asked and attr else None, _args(node, rows) if asked else [],
            ))
    return facts


def _records(source: str, wanted: frozenset[str]) -> list[dict] | None:
    found = call_sites(source, wanted) if source else []
    return None if found is None else [
        dict(zip(_FIELDS, fact)) | {"kwargs": list(fact[7].items()), "args": [dict(zip(("name", "text"), a)) for a in fact[13]]} for fact in found
    ]


_remembered = lru_cache(maxsize=REMEMBERED_TEXTS)(_records)  # of a Python worker: equal texts in different batches


def _facts(text: str, wanted: frozenset[str]) -> list[dict] | None:
    return _remembered(text, wanted) if len(text) <= REMEMBERED_LENGTH else _records(text, wanted)


def facts_of(sources: pa.Array, wanted: frozenset[str] = frozenset()) -> pa.Array:
    """Facts of a batch of texts. Corpora are full of copies, so each distinct text is parsed and encoded once."""
    texts = sources.dictionary_encode()
    with without_cycle_search():
        facts = [_facts(t, wanted) for t in texts.dictionary.to_pylist()]
    places = texts.indices.fill_null(len(facts))  # no text: no facts
    distinct = pa.array([*facts, []], type=_ARROW_FACTS)
    return distinct.take(places)


@lru_cache(maxsize=None)
def _call_sites_udf(wanted: frozenset[str]):
    @F.arrow_udf(T.ArrayType(CALL_SITE))
    def parse(sources: pa.Array) -> pa.Array:
        return facts_of(sources, wanted)

    # Optimizer rules that copy an expression (such as a filter put in front of an explode) would parse
    # every file twice; they leave a non-deterministic one where it is.
    return parse.asNondeterministic()


def worth_parsing(text: Column, wanted: frozenset[str] = frozenset()) -> Column:
    """Whether a text has a word that some rule could use; an imported name is spelled out where it is imported."""
    if "*" in wanted:
        return text.isNotNull()
    return text.rlike("|".join([WORTH_PARSING, *sorted(map(re.escape, wanted))]))


def with_call_sites(sources, text: str = "module", wanted: frozenset[str] = frozenset()):
    """Add `facts`, the array of call sites of a text column; one parse serves every rule."""
    return sources.withColumn("facts", _call_sites_udf(wanted)(F.when(worth_parsing(F.col(text), wanted), F.col(text))))


# --- documents that are read and parsed in one step ------------------------------------------------

@lru_cache(maxsize=None)
def _worth(wanted: frozenset[str]) -> re.Pattern:
    return re.compile("|".join([WORTH_PARSING, *sorted(map(re.escape, wanted))]), re.ASCII)


def _read_texts(contents: pa.Array, in_notebook: pa.Array) -> Iterator[tuple[str | None, str | None, list[int] | None]]:
    """What keeps a document from being read, its source text and, of a notebook, the lines its cells start at."""
    for content, is_notebook in zip(contents.to_pylist(), in_notebook.to_pylist()):
        if content is None or not is_notebook:
            yield None, content, None
            continue
        read = read_notebook(content, with_outputs=False)
        yield (read["problem"], None, None) if read["code"] is None else (None, *joined_code(read["code"]))


def _facts_if_worth(text: str, wanted: frozenset[str]) -> list[dict] | None:
    return _facts(text, wanted) if "*" in wanted or _worth(wanted).search(text) else []


def facts_of_documents(contents: pa.Array, in_notebook: pa.Array, wanted: frozenset[str] = frozenset()) -> pa.Array:
    """Cell starts and facts of a batch of documents, as `with_module` and `with_call_sites` give them one after the other."""
    numbers: dict[str, int] = {}  # of the distinct texts
    starts, places = [], []
    with without_cycle_search():
        for _, text, lines in _read_texts(contents, in_notebook):
            starts.append(lines)
            places.append(None if text is None else numbers.setdefault(text, len(numbers)))
        facts = [_facts_if_worth(t, wanted) for t in numbers]
    distinct = pa.array([*facts, []], type=_ARROW_FACTS)
    at = pa.array(places, pa.int32()).fill_null(len(facts))  # no text: no facts
    return pa.StructArray.from_arrays([pa.array(starts, type=_ARROW_READ.field("cell_starts").type), distinct.take(at)], fields=list(_ARROW_READ))


def problems_of_documents(contents: pa.Array, in_notebook: pa.Array) -> pa.Array:
    """Why a document gives no facts: it cannot be read, or its source does not parse."""
    none: frozenset[str] = frozenset()
    of_text: dict[str | None, str | None] = {None: None}
    problems = []
    with without_cycle_search():
        for problem, text, _ in _read_texts(contents, in_notebook):
            if text not in of_text:
                of_text[text] = NO_PARSE if _facts_if_worth(text, none) is None else None
            problems.append(problem or of_text[text])
    return pa.array(problems, pa.string())


@lru_cache(maxsize=None)
def _documents_udf(wanted: frozenset[str]):
    @F.arrow_udf(_READ)
    def read_and_parse(contents: pa.Array, in_notebook: pa.Array) -> pa.Array:
        return facts_of_documents(contents, in_notebook, wanted)

    return read_and_parse.asNondeterministic()  # as above


@F.arrow_udf(T.StringType())
def _problems(contents: pa.Array, in_notebook: pa.Array) -> pa.Array:
    return problems_of_documents(contents, in_notebook)


_problems_once = _problems.asNondeterministic()


def document_facts(content: Column, in_notebook: Column, wanted: frozenset[str] = frozenset()) -> Column:
    """Struct (cell_starts, facts) of a notebook or source text. The cells stay in the worker that reads and parses them."""
    return _documents_udf(wanted)(content, in_notebook)


def document_problem(content: Column, in_notebook: Column) -> Column:
    """Why a notebook or source text gives no facts, NULL where it does."""
    return _problems_once(content, in_notebook)


# --- context of a fact -------------------------------------------------------------------------------

def split_line(facts: Column) -> Column:
    """Earliest line that calls the splitter, NULL when none does."""
    is_split = lambda f: (f["bare_name"] == SPLIT) | (f["attr"] == SPLIT)
    return F.array_min(F.transform(F.filter(facts, is_split), lambda f: f["line_start"]))


def dropped_columns(facts: Column) -> Column:
    """Columns named by keyword in any drop call of the file."""
    drops = F.filter(facts, lambda f: f["attr"] == DROP)
    return F.array_distinct(F.flatten(F.transform(drops, lambda f: f["strings"])))
