"""Periodic runs against every period tried at every place, on made word sequences, odd rows and the registered query."""

import random
import re

import numpy as np
import pytest

from wardflow.llm import periods, queries

from .conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, least=24, times=3):
    """All maximal runs: for each period the stretches where words that far apart agree, the smallest period counting."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]


def made(seed):
    """Words from a small alphabet with repeats of many periods, some of them cut or changed within."""
    draw, words = random.Random(seed), []
    while len(words) < draw.randint(0, 160):
        part = [draw.randint(0, 2) for _ in range(draw.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 13, 16, 17, 21]))]
        words += (part * 8)[:draw.randint(1, 6 * len(part))]
        if draw.random() < 0.2:
            words[draw.randrange(len(words))] = 9
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (10, 4)])
def test_runs_of_made_words(least, times):
    docs = [made(seed) for seed in range(600)] + [[], [1], [1] * 23, [1] * 24, [1] * 500, list(range(300)), [0, 1] * 200, ([0] * 20 + [1]) * 9]
    counts = np.array([len(d) for d in docs])
    got = [[] for _ in docs]
    for doc, start, length, period in periods.find_runs(np.array([w for d in docs for w in d]), counts, least, times).tolist():
        got[doc].append((start, length, period))
    assert got == [plain(d, least, times) for d in docs]
    assert sum(map(len, got)) > 200
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(0, np.int64), np.zeros(0, np.int64), 24, 2)


def check(rows, docs):
    assert len(rows) == len(docs)
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows)
    want = []
    for doc_id, text in docs:
        words = WORD.findall(text or "")
        runs = plain(words) if len(words) < 5000 else []
        want.append((str(doc_id), runs, " ".join(collapse(words, runs))))
    assert got == sorted(want)


def test_odd_rows(odd, odd_rows, none):
    check(periods.periodic_runs(odd).collect(), [(r[0], r[1]) for r in odd_rows])
    assert periods.periodic_runs(none).count() == 0


def test_a_very_long_text_and_a_hot_repeat(spark):
    draw = random.Random(3)
    head, body = [f"w{draw.random()}" for _ in range(50_000)], [f"v{draw.random()}" for _ in range(30_000)]
    docs = [(1, " ".join(head + body * 3 + body[:7] + head[::-1]), "en", "a", 1)] + [(k, "tick tock " * 40 + f"end {k}", "en", "a", 1) for k in range(2, 300)]
    rows = {r["doc_id"]: r for r in periods.periodic_runs(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert [tuple(r) for r in rows[1]["runs"]] == [(50_000, 90_007, 30_000)] and rows[1]["collapsed"].split() == head + body + head[::-1]
    assert all([tuple(r) for r in rows[k]["runs"]] == [(0, 80, 2)] and rows[k]["collapsed"] == f"tick tock end {k}" for k in range(2, 300))


def test_separators_are_the_six(spark):
    apart = "a\tb\nc\x0bd\x0ce\rf g\x1ch\x85i\xa0j　k"
    (row,) = periods.periodic_runs(spark.createDataFrame([(1, apart, "en", "a", 1)], SCHEMA)).collect()
    assert row["collapsed"] == " ".join(WORD.findall(apart)) and row["collapsed"].count(" ") == 6


def test_planted_changes(spark):
    """The contract's change, word by word as it is stated, on words of several counts."""
    import zlib

    docs = [(k, " \n".join(f"x{i}" for i in range(k % 57)), "en", "a", 1) for k in range(400)] + [(None, "a b", "en", "a", 1), (401, None, "en", "a", 1)]
    got = {r["doc_id"]: (r["text"] or "").split() for r in queries.plant_periods(spark.createDataFrame(docs, SCHEMA)).collect()}
    changed = 0
    for doc_id, text, *_ in docs:
        words, h = (text or "").split(), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        assert got[doc_id] == words
    assert changed > 20
