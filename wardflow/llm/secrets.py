"""Secret scan: one automaton for all rules, one pass over the bytes of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Rule, Scanner
from .common import text_slices

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}\Z")
_VALUE_OF = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?(?P<value>.+)\Z""", re.S)
# A private key from its header to its END line, or to its last body character where that line is missing. Line ends may
# be written as \n or \r\n escapes, as in JSON; lines may be indented or quoted.
_EOL = r"""(?:[\x20\t"',+>]*(?:\r|\n|\\r|\\n)[\x20\t"'>]*)"""
_GAP = rf"(?:{_EOL}|[\x20\t])"
_TOP = rf"{_GAP}+(?:[A-Za-z][A-Za-z0-9-]*:[\x20-\x5b\x5d-\x7e]*{_EOL}+)*"
_KEY = (
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"(?:{_TOP}(?:[A-Za-z0-9+/=]+{_GAP}*)*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    # Without an END line, words behind spaces only count where they look like a line of a key, as prose may follow.
    rf"|(?:(?:{_TOP}{_EOL}|{_EOL}+)[A-Za-z0-9+/=]+|{_GAP}+[A-Za-z0-9+/=]{{16,}})"
    rf"(?:{_EOL}+[A-Za-z0-9+/=]+|[\x20\t]+(?:[A-Za-z0-9+/=]{{16,}}|[A-Za-z0-9+/]+={{1,2}}))*)?"
)


def _long_value(match: bytes) -> bool:
    return _VALUE.match(_VALUE_OF.match(match)["value"]) is not None


@dataclass(frozen=True)
class _at_least:
    n: int

    def __call__(self, match: bytes) -> bool:
        return len(match) >= self.n


# The three kinds that a contract counts, in its order, then further public token formats.
BASE = (
    Rule("assign", _ASSIGN, _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", _at_least(18)),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", _at_least(40)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", _at_least(20)),
    Rule("google", r"AIza[A-Za-z0-9_-]+", _at_least(39)),
    Rule("hub", r"hf_[A-Za-z0-9]+", _at_least(24)),
    Rule("service", r"sk-[A-Za-z0-9_-]+", _at_least(24)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _at_least(40)),
    Rule("key_block", _KEY),
)

SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>"


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def found(scanner: Scanner, data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of the rules; offsets count code points."""
    spans = sorted((b, k, e) for k, b, e in scanner.spans(data))
    if not spans or data.isascii():
        return [(scanner.rules[k].name, b, e) for b, k, e in spans]
    edges = sorted({x for b, _, e in spans for x in (b, e)})
    at, seen, points = 0, 0, {}
    for x in edges:
        seen += len(data[at:x].decode())
        at, points[x] = x, seen
    return [(scanner.rules[k].name, points[b], points[e]) for b, k, e in spans]


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """One row per document with the spans of all rules, by start, then by the order of the rules.

    Each rule's matches are the leftmost, longest ones that do not overlap; matches of different rules may.
    A null text counts as empty and has no spans. Repeated rows and null ids give one row each; other columns
    are not carried. The automaton is built once on the driver and sent to the tasks.
    """
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("rule names repeat")
    kept = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(kept)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in text_slices(batch):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                spans = [[{"kind": k, "start": b, "end": e} for k, b, e in found(scanner, t or b"")] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each stretch covered by secrets replaced by `mark`; columns and rows as before.

    A text without secrets, an empty one and a null stay as they are; n_chars, where it is a column, follows
    the new text.
    """
    kept = tuple(rules)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(kept)
        for batch in batches:
            for part in text_slices(batch):
                texts = [t if t is None else _redacted(scanner, t, mark.encode()) for t in part.column("text").cast(pa.binary()).to_pylist()]
                new = pa.array(texts, pa.binary()).cast(part.schema.field(text).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:text], new, *part.columns[text + 1:]], schema=part.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _redacted(scanner: Scanner, data: bytes, mark: bytes) -> bytes:
    parts, at = [], 0
    for begin, end in sorted((b, e) for _, b, e in scanner.spans(data)):
        if begin >= at:
            parts += [data[at:begin], mark]
        at = max(at, end)
    return b"".join([*parts, data[at:]])
