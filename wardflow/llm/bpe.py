"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

LONG_TEXT = 1 << 16  # from here on a text is encoded piece by piece
LONG_SPACES = 1 << 12  # a run of white space that the tokenizer's own matcher should not see

SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"

# A place between a letter or digit and a space or line end: no match of the split pattern crosses it.
_SAFE = regex.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
_SPACE_RUN = regex.compile(r"\s{%d,}" % LONG_SPACES)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """Consecutive parts of a long text whose encodings, joined, are the encoding of the whole."""
    start = 0
    while len(text) - start > LONG_TEXT:
        cut = _SAFE.search(text, start + LONG_TEXT // 2)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(enc: tiktoken.Encoding, pattern: str, text: str) -> np.ndarray:
    """Ids of one text. A part with a huge run of white space is matched here and encoded match by match,
    because the tokenizer's backtracking matcher gives up on such runs."""
    parts = []
    for piece in pieces(text) if len(text) > LONG_TEXT else (text,):
        if _SPACE_RUN.search(piece):
            for match in regex.finditer(pattern, piece):
                parts.append(np.asarray(enc._encode_single_piece(match.group()), np.uint32))
        else:
            parts.append(enc.encode_to_numpy(piece, disallowed_special=()))
    return np.concatenate(parts).astype("<u4", copy=False) if len(parts) != 1 else parts[0].astype("<u4", copy=False)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """One row per document: `ids` as little-endian unsigned 32-bit integers and the bytes they decode to.

    A null text counts as empty (no ids). Repeated rows and null ids give one row each; other columns are
    not carried. The rank file must be readable at `rank_file` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in text_slices(batch):
                ids = [encode(enc, pattern, t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                        pa.array([enc.decode_bytes(i.tolist()) for i in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
