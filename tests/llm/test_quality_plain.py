"""The classifier against a plain numpy version, and each further secret rule against examples."""

import zlib

import numpy as np
import pytest

from wardflow.llm import quality, secrets
from wardflow.llm.common import table


def isotonic(y, n):
    """Max-min formula: the value at i is the greatest, over starts, of the least mean up to an end."""
    mean = lambda a, b: np.average(y[a:b + 1], weights=n[a:b + 1])
    return np.array([max(min(mean(a, b) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))])


def plain_scores(texts, ids, labels, ridge=1.0, width=4.0, seed=20):
    x = np.array([quality.statistics((t or "").encode()) for t in texts])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    draw, m = np.random.default_rng(seed), quality.FEATURES
    directions, phases = draw.normal(size=(x.shape[1], m)) / width, draw.uniform(0, 2 * np.pi, m)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([np.cos(z @ directions + phases) * np.sqrt(2 / m), np.ones((len(z), 1))])
    part = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    known = np.array([i in labels for i in ids])
    y = np.array([labels.get(i, 0.0) for i in ids])
    rows = known & (part > 1)
    more = np.sqrt(np.diag([ridge] * m + [1e-9]))  # ridge as rows of their own
    weights = np.linalg.lstsq(np.vstack([z[rows], more]), np.concatenate([y[rows], np.zeros(m + 1)]), rcond=None)[0]
    margin = z @ weights
    rows = known & (part == 1)
    bins = np.floor(np.clip(margin[rows], -1, 2) * (quality.BINS / 3))
    keys = np.unique(bins)
    means = lambda v: np.array([v[bins == k].mean() for k in keys])
    n = np.array([(bins == k).sum() for k in keys])
    at, raw = means(np.clip(margin[rows], -1, 2)), isotonic(means(y[rows]), n)
    steps = np.concatenate(([0], np.cumsum(np.diff(raw) > 1e-12)))
    centres = [np.average(at[steps == s], weights=n[steps == s]) for s in range(steps[-1] + 1)]
    values = [raw[steps == s][0] for s in range(steps[-1] + 1)]
    return 0.999 * np.interp(margin, centres, np.clip(values, 0, 1)) + 0.001 / (1 + np.exp(-4 * (margin - 0.5)))


def test_scores_equal_a_plain_fit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").toPandas()
    labels = table(spark, sf_dir, "labels").filter("quality IN (0, 1)").groupBy("doc_id").avg("quality").toPandas()
    want = dict(zip(docs["doc_id"], plain_scores(docs["text"], docs["doc_id"].tolist(), dict(zip(labels["doc_id"], labels.iloc[:, 1])))))
    got = {r["doc_id"]: r for r in quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()}
    assert set(got) == set(want)
    ids = sorted(want)
    assert np.allclose([got[i]["score"] for i in ids], [want[i] for i in ids], atol=1e-6)
    assert [got[i]["held_out"] for i in ids] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
    assert [got[i]["predicted"] for i in ids] == [int(got[i]["score"] >= 0.3) for i in ids]


# kind, a token of the least length, and texts without one: too short, or another alphabet
RULES = [
    ("github", "ghp_" + "aB3" * 12, ["ghp_" + "aB3" * 11, "ghx_" + "aB3" * 12]),
    ("github", "ghs_" + "Z9" * 18, ["ghp-" + "Z9" * 18]),
    ("slack", "xoxb-" + "12345-abcdeFGHI", ["xoxb-1234-abcdeFG", "xoxc-12345-abcdeFGHI"]),
    ("google", "AIza" + "Sy-_7" * 7, ["AIza" + "Sy-_7" * 6, "AIZA" + "Sy-_7" * 7]),
    ("hub", "hf_" + "QwErT7" * 3 + "abc", ["hf_" + "QwErT7" * 3, "HF_" + "QwErT7" * 3 + "abc"]),
    ("service", "sk-" + "proj-AbCdEfGhIjKlMnOp", ["sk-AbCdEf-hIjK", "sk_" + "proj-AbCdEfGhIjKlMnOp"]),
    ("jwt", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.s5-_GhJk9PqR", ["eyJhbGci.eyJzdWIi.s5GhJk", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0s5GhJk9PqR"]),
]


@pytest.mark.parametrize("kind, token, others", RULES)
def test_further_secret_rules(spark, kind, token, others):
    rows = [(0, f"é {token} end"), (1, f"({token})"), (2, token)] + [(10 + i, f"see {text} end") for i, text in enumerate(others)]
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] == kind] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    n = len(token)
    assert found[0] == [(kind, 2, 2 + n)] and found[1] == [(kind, 1, 1 + n)] and found[2] == [(kind, 0, n)]
    assert all(found[i] == [] for i in found if i >= 10)
    left = secrets.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("doc_id < 3")
    assert not any(token in r["text"] for r in left.collect())
