"""Periodic runs of words: a dictionary of basic factors and the distances between their successive occurrences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

SCHEMA = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Numbers(dict):
    """Numbers words from 0 as they turn up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _stretches(at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, number of places and distance of each stretch of consecutive places that share a distance."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(distance) != 0)
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), distance[first]


def find_runs(words: np.ndarray, counts: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (document, start, length, period) of the maximal runs, ordered by all four.

    `words` numbers the words of all documents in a row, `counts` says how many each document has. Per power of
    two m, every factor of m words that turns up again in its document is named by the pair of its halves' names.
    A factor inside a run of period p <= m recurs p words later and no sooner, so its successive occurrences are p
    apart, and consecutive factors of a run agree on that distance. A stretch of them proposes the period and,
    extended by the length of the last factor, is the whole run: one word more on either side would add a factor
    to it. A run therefore shows at each m from its period on; the least of these is the one that counts.
    """
    if times < 3:
        raise ValueError("a run must hold its period three times or more")
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    end_of = ends[doc]
    at = np.flatnonzero((counts >= least)[doc])
    key = doc[at] * (int(words.max()) + 1 if len(words) else 1) + words[at]
    found, m = [], 1
    while len(at):
        order = np.argsort(key, kind="stable")  # places of one factor stay in ascending order
        placed, key = at[order], key[order]
        again = key[1:] == key[:-1]
        distance = placed[1:] - placed[:-1]
        link = again & (2 * distance > m) & (distance <= m)
        by_place = np.argsort(placed[:-1][link], kind="stable")
        start, links, period = _stretches(placed[:-1][link][by_place], distance[link][by_place])
        length = links + (m - 1) + period
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([doc[start[long]], start[long], length[long], period[long]], 1))
        # Only a factor that occurs again can begin or end a longer one that does.
        shared = np.append(again, False) | np.insert(again, 0, False) if len(again) else np.zeros(len(placed), bool)
        name = np.full(len(words), -1, np.int64)
        names = np.cumsum(np.insert(~again, 0, True)) - 1
        name[placed[shared]] = names[shared]
        at = np.sort(placed[shared])
        at = at[at + 2 * m <= end_of[at]]
        at = at[(name[at + m] >= 0) & (times * (m + 1) <= counts[doc[at]])]
        key = name[at] * (int(names[-1]) + 1) + name[at + m]
        m *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    runs[:, 1] -= (ends - counts)[runs[:, 0]]
    return runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]


def kept_words(total: int, first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each of the words stays: it lies in no run after that run's first period."""
    edges = np.zeros(total + 1, np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(edges, start + runs[:, 3], 1)
    np.add.at(edges, start + runs[:, 2], -1)
    return np.cumsum(edges[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """One row per document: its periodic runs of words, and its words, joined by one space, without the repeats.

    A run is a stretch of consecutive words with smallest period q, at least `least` words and `times` periods long
    (`times` is 3 or more), that no neighbouring word extends with period q; places count words from 0. Words are
    what spaces and the control signs U+0009 to U+000D separate. A null, empty or blank text has no runs and an
    empty result. Repeated rows and null ids give one row each; other columns are not carried. A document is
    looked at as a whole, so its words must fit in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                # bytes.split() without arguments splits at exactly the six separators.
                split = [t.split() if t else [] for t in part.column("text").cast(pa.binary()).to_pylist()]
                counts = np.array([len(s) for s in split], np.int64)
                numbers = _Numbers()
                words = np.array([numbers[w] for s in split for w in s], np.int64)
                first = np.cumsum(counts) - counts
                runs = find_runs(words, counts, least, times)
                keep = kept_words(len(words), first, runs)
                touched = np.zeros(len(counts), bool)
                touched[runs[:, 0]] = True
                collapsed = [
                    b" ".join(compress(s, keep[first[k]:first[k] + len(s)]) if touched[k] else s) for k, s in enumerate(split)
                ]
                edges = np.searchsorted(runs[:, 0], np.arange(len(counts) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), rows), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
