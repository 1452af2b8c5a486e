"""Truth tables, exactness of the distributed building blocks, and round trips."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wardflow.dims import decision_matrix
from wardflow.functions import ordering as od
from wardflow.functions import severity as sev
from wardflow.functions import text as tx
from wardflow.functions.rng import hash_hex
from wardflow.operators import decide as dc
from wardflow.operators import evalscore as ev
from wardflow.operators import export as ex
from wardflow.operators import findings as fg
from wardflow.operators import flows as fl
from wardflow.operators import history as hs
from wardflow.operators import metrics as mt
from wardflow.operators import neighbours as kn
from wardflow.operators import prep as pp
from wardflow.operators.rules import fix_struct
from wardflow.schemas import VERDICT


def _column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_pinned(spark):
    specs = ["numpy==1.26.4", "numpy", "numpy>=1.26", "numpy~=1.26", "numpy @ git+https://x/y", "git+https://x/y@abc123"]
    assert _column(spark, specs, "string", tx.is_pinned) == [True, False, True, True, True, True]


def test_label_proxy_names(spark):
    yes = ["difficulty_level", "difficulty", "attack_label", "some_target", "target_class", "label_encoded", "outcome", "RESULT_CLASS",
           "class_id", "is_credit_fraud", "data_leak", "leak_score", "Cheat_feature"]
    no = ["src_bytes", "dst_bytes", "protocol_type", "duration", "count", "flag", "service", "num_failed_logins"]
    assert _column(spark, yes + no, "string", tx.is_label_proxy) == [True] * len(yes) + [False] * len(no)


def test_severity_ladder(spark):
    ladder = ["critical", "high", "medium", "low", "info"]
    assert _column(spark, ladder, "string", sev.downgrade) == ["high", "medium", "low", "low", "info"]
    assert _column(spark, ladder, "string", lambda c: sev.bump(c, F.lit(1))) == ["critical", "critical", "high", "medium", "low"]


def test_confidence_buckets(spark):
    edges = [0.4999, 0.50, 0.6999, 0.70, 0.85, 0.9499, 0.95, 1.0]
    expected = ["LOW", "LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    assert _column(spark, edges, "double", dc.severity_bucket) == expected
    assert _column(spark, edges, "double", dc.strict_severity) == ["LOW", "LOW", "LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(edges)], "i int, confidence double")
    joined = dc.severity_bucket_join(df, decision_matrix(spark)).orderBy("i").collect()
    assert [r["severity"] for r in joined] == expected


def test_decisions(spark):
    rows = [(0, "172.16.0.100", [0.01, 0.99, 0.0, 0.0, 0.0]), (1, "172.16.0.55", [0.97, 0.03, 0.0, 0.0, 0.0]),
            (2, "192.168.1.10", [0.97, 0.03, 0.0, 0.0, 0.0]), (3, "10.0.0.1", [0.01, 0.99, 0.0, 0.0, 0.0]), (4, "1.1.1.1", [0.3, 0.1, 0.2, 0.2, 0.2])]
    got = {r["id"]: r for r in dc.decide(spark.createDataFrame(rows, "id int, destination_ip string, probs array<double>")).collect()}
    assert [got[i]["action"] for i in range(5)] == ["ALERT_ONLY", "ISOLATE_HOST", "HUMAN_REVIEW_REQUIRED", "ALERT_ONLY", "ALERT_ONLY"]
    assert [got[i]["safety_triggered"] for i in range(5)] == [False, False, True, False, False]
    assert got[2]["destination_role"] == "db-server" and got[4]["is_attack"] and got[4]["severity"] == "LOW"


def test_multiset_scores(spark):
    def score(expected, actual):
        make = lambda ids: spark.createDataFrame([("f", i) for i in ids] or [], "file string, rule_id string")
        r = ev.multiset_score(make(expected), make(actual)).agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).first()
        return tuple(r)

    assert score(["a", "a"], ["a"]) == (1, 0, 1)
    assert score(["a", "a"], ["a", "a", "a"]) == (2, 1, 0)
    assert score(["a"], ["b"]) == (0, 1, 1)


def test_check_metrics(spark):
    df = spark.createDataFrame([(3, 1, 2), (0, 0, 0)], "tp int, fp int, fn int")
    rows = [tuple(round(x, 4) for x in r) for r in df.select(*ev.score_columns()).collect()]
    assert rows == [(0.75, 0.6, 0.6667), (1.0, 1.0, 1.0)]
    overall = ev.overall_recall(spark.createDataFrame([(3, 1), (1, 2)], "tp int, fn int")).first()[0]
    assert overall == pytest.approx(4 / 7)


def _findings(spark, rows):
    base = spark.createDataFrame(rows, "run_id string, seq bigint, rule_id string, severity string, file string, line_start int")
    return base.select("*", F.lit("leakage").alias("check"), F.lit("c").alias("category"), F.col("line_start").alias("line_end"),
                       F.lit("m").alias("message"), F.lit("e").alias("evidence"), fix_struct(F.lit("do"), F.lit("medium")).alias("fix"))


WGET, JOBLIB, PIP, PICKLE = ("supply_chain.untrusted-wget-source", "deserialization.unsafe-joblib-load",
                             "supply_chain.unpinned-pip-install", "deserialization.unsafe-pickle-load")
PROXY, BEFORE, ON_TEST = "leakage.label-proxy-feature", "leakage.preprocessing-before-split", "leakage.fit-on-test"


@pytest.mark.parametrize("rules,expected", [
    ([WGET, JOBLIB], {"scenario.supply-chain-to-rce": "high"}), ([WGET], {}), ([JOBLIB], {}), ([], {}),
    ([WGET, JOBLIB, PIP, PICKLE], {"scenario.supply-chain-to-rce": "critical"}),
    ([PROXY], {"scenario.label-leakage-to-inflated-metrics": "high"}),
    ([PROXY, BEFORE, ON_TEST], {"scenario.label-leakage-to-inflated-metrics": "critical"}),
    (["adversarial.fgsm-trivial-evasion"], {"scenario.evadable-classifier-in-production": "high"}),
])
def test_scenarios(spark, rules, expected):
    found = _findings(spark, [("r", i, rule, "high", f"f{i}", 1) for i, rule in enumerate(rules)])
    got = fg.synthesise_scenarios(found).collect()
    assert {r["rule_id"]: r["severity"] for r in got} == expected
    assert all(r["file"] == "f0" and r["line_start"] is None for r in got)


def test_verdicts(spark):
    found = _findings(spark, [("r", 0, "a", "critical", "f", 1), ("r", 1, "a", "critical", "f", 1), ("r", 2, "b", "low", "f", None), ("r", 3, "c", "high", "f", 2)])
    verdicts = spark.createDataFrame([("r", 0, "a", "f", 1, False, "low", "x"), ("r", 1, "a", "f", 1, False, "low", "y"), ("r", 2, "b", "f", None, False, "low", "z"),
                                      ("r", 3, "c", "f", 2, True, "high", "w"), ("r", 4, "no", "f", 2, True, "high", "w")], VERDICT)
    got = {r["seq"]: r for r in fg.adjudicate(found, verdicts).collect()}
    assert [got[i]["severity"] for i in range(4)] == ["medium", "critical", "low", "high"]
    assert [got[i]["fix"]["confidence"] for i in range(4)] == ["medium", "medium", "medium", "high"]
    matched = fg.match_verdicts(verdicts, found)
    assert [r["ord"] for r in matched.filter("seq IS NULL").collect()] == [4]
    log = fg.evidence_log(matched).filter("seq = 0").orderBy("ord").collect()
    assert [r["added"] for r in log] == [f"\n[LLM judgement] confirmed=False confidence=low: {x}" for x in "xy"]


def test_keep_first(spark):
    found = _findings(spark, [("r", 0, "a", "high", "f", 1), ("r", 1, "a", "low", "f", 1), ("r", 2, "a", "low", "f", None), ("r", 3, "a", "low", "f", None)])
    assert sorted(r["seq"] for r in fg.keep_first(found, F.col("seq")).collect()) == [0, 2, 3]


def test_clean_run_summary(spark):
    runs = spark.createDataFrame([("r",), ("s",)], "run_id string").select(
        "run_id", F.lit("t").alias("target"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"),
        F.lit("cli").alias("invocation"), F.create_map(F.lit("a"), F.lit("b")).alias("extra"))
    got = {r["run_id"]: r for r in hs.build_runs(_findings(spark, [("r", 0, "a", "high", "f", 1)]), runs).collect()}
    assert (got["s"]["total_findings"], got["s"]["max_severity"], got["s"]["blocking"]) == (0, None, False)
    assert (got["r"]["total_findings"], got["r"]["max_severity"], got["r"]["blocking"]) == (1, "high", True)


def test_sarif_document(spark, tmp_path):
    found = _findings(spark, [("r", i, rule, "high", "/src/f.py", None if i == 2 else i) for i, rule in enumerate(["b-x.y", "a.z", "a.z"])])
    ex.write_sarif(ex.sarif_lines(found, fg.default_check_runs(found, "r"), "/src"), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "run_id=r").glob("*.txt"))
    document = json.loads("".join(p.read_text() for p in parts))
    run = document["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["a.z", "b-x.y"]
    assert [r["ruleId"] for r in run["results"]] == ["b-x.y", "a.z", "a.z"]
    location = run["results"][0]["locations"][0]["physicalLocation"]
    assert location["artifactLocation"]["uri"] == "f.py" and location["region"]["startLine"] == 0
    assert "startLine" not in run["results"][2]["locations"][0]["physicalLocation"]["region"] and "fixes" not in run["results"][0]
    assert len(run["invocations"][0]["toolExecutionNotifications"]) == 5


# --- exactness under skew -----------------------------------------------------------------------

@pytest.mark.parametrize("prefix", [3, 1])
def test_quota_is_exact_on_a_hot_group(spark, monkeypatch, prefix):
    monkeypatch.setattr(od, "PREFIX", prefix)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, g string")
    quotas = {"hot": 777, **{f"g{i}": i for i in range(7)}}
    hashed = hash_hex(42, F.col("id"))
    wanted = spark.createDataFrame(list(quotas.items()), "g string, quota bigint")
    kept = od.mark_quota(df, "g", "id", hashed, od.fit_quota(df, "g", "id", hashed, wanted), "kept").filter("kept")
    with pytest.raises(ValueError):
        od.fit_quota(df, "g", "id", hashed, spark.createDataFrame([("g1", 3000)], "g string, quota bigint"))
    import hashlib

    want = set()
    for g, q in quotas.items():
        mine = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, x in rows if x == g)
        want |= {i for _, i in mine[:q]}
    assert {r["id"] for r in kept.collect()} == want


def test_stratified_split_sizes(spark):
    df = spark.createDataFrame([(i, 0 if i < 700 else 1 if i < 1000 else 2 if i < 1033 else 3) for i in range(1037)], "id bigint, y int")
    split = pp.fit_stratified_split(df, "id", "y")
    quotas = {r["g"]: r["quota"] for r in split.quotas.collect()}
    assert sum(quotas.values()) == 1037 - math.ceil(0.2 * 1037)
    got = {(r["y"], r["split"]): r["n"] for r in split.apply(df).groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert {y: got[(y, "train")] for y in range(4)} == quotas
    # the published fold: 125,973 rows in five classes
    sizes = {"DoS": 45927, "Normal": 67343, "Probe": 11656, "R2L": 995, "U2R": 52}
    shares = pp.largest_remainder(spark.createDataFrame(list(sizes.items()), "g string, n bigint"), 100778)
    assert {r["g"]: r["quota"] for r in shares.collect()} == {"DoS": 36741, "Normal": 53874, "Probe": 9325, "R2L": 796, "U2R": 42}


def test_stratified_split_of_many_classes(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 20_000).alias("y"))
    split = pp.fit_stratified_split(df, "id", "y").apply(df)
    per_class = split.groupBy("y").agg(F.count_if(F.col("split") == "train").alias("n"))
    assert split.filter("split = 'train'").count() == 48_000
    assert per_class.agg(F.min("n"), F.max("n"), F.count("*")).first() == (2, 3, 20_000)


def test_neighbours_far_from_the_origin(spark):
    draw = random.Random(3)
    rows = [(i, 0, [1.6e9 + draw.randrange(4000) / 8, draw.randrange(300) / 4.0]) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, class_id int, features array<double>")
    got = {(r["id"], r["place"]): (r["neighbour_id"], r["distance"]) for r in kn.nearest_neighbours(df, 3, pivots=9, block_rows=100).collect()}
    for i, _, x in rows:
        want = sorted((math.sqrt((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2), j) for j, _, y in rows if j != i)[:3]
        assert [got[i, p + 1] for p in range(3)] == [(j, d) for d, j in want]


def test_neighbours_of_seeds_only(spark):
    rows = [(i, 0, [float(i * i % 97), float(i)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, class_id int, features array<double>")
    every = {tuple(r) for r in kn.nearest_neighbours(df, 3).collect()}
    some = {tuple(r) for r in kn.nearest_neighbours(df, 3, visitors=df.filter("id < 10")).collect()}
    assert some == {r for r in every if r[0] < 10}


def test_running_total_and_numbers(spark):
    rows = [("hot", i, i % 5) for i in range(500)] + [("x", i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, p bigint, n int").repartition(7)
    got = {(r["g"], r["p"]): r["t"] for r in od.running_total(df, "g", "p", F.col("n"), "t", chunk=16).collect()}
    assert all(got[(g, p)] == sum(n for h, q, n in rows if h == g and q < p) for g, p, _ in rows)
    numbered = od.number_rows(df, [F.col("g"), F.desc("p")], "k").collect()
    order = sorted(rows, key=lambda r: (r[0], -r[1]))
    assert [(r["g"], r["p"]) for r in sorted(numbered, key=lambda r: r["k"])] == [(g, p) for g, p, _ in order]
    assert sorted(r["k"] for r in numbered) == list(range(1, len(rows) + 1))


@pytest.fixture(scope="module")
def cloud(spark):
    """One class with most rows, repeated points and a tight clump."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        label = 0 if i % 4 else 1
        spread = 1 if i % 3 == 0 else 100
        rows.append((i, label, [float(round(rng.gauss(0, spread))) for _ in range(4)]))  # whole numbers: ties are exact
    return rows, spark.createDataFrame(rows, "id bigint, class_id int, features array<double>").cache()


@pytest.mark.parametrize("tuning", [{"pivots": 1}, {"pivots": 9, "block_rows": 23}])
def test_neighbours_match_brute_force(cloud, tuning):
    rows, df = cloud
    got = {}
    for r in kn.nearest_neighbours(df, 3, **tuning).collect():
        got.setdefault(r["id"], {})[r["place"]] = r["neighbour_id"]
    for i, label, x in rows:
        near = sorted((math.dist(x, y), j) for j, other, y in rows if other == label and j != i)[:3]
        assert [got[i][p] for p in (1, 2, 3)] == [j for _, j in near], i


def test_oversampling_properties(cloud):
    rows, df = cloud
    points = {i: (label, x) for i, label, x in rows}
    made = kn.oversample(df).collect()
    sizes = {c: sum(r["class_id"] == c for r in made) for c in (0, 1)}
    assert sizes[0] == sizes[1] == 300 and sum(not r["is_synthetic"] for r in made) == 400
    for r in (r for r in made if r["is_synthetic"]):
        (label, a), (mate_label, b) = points[r["id"]], points[r["neighbour_id"]]
        assert label == mate_label == r["class_id"] and r["id"] != r["neighbour_id"]
        assert all(min(x, y) - 1e-9 <= v <= max(x, y) + 1e-9 for v, x, y in zip(r["features"], a, b))
    with pytest.raises(ValueError):
        kn.oversample(df.filter("class_id = 0 OR id < 9"))


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    scaler = pp.fit_scaler(df)
    assert (scaler.mean, scaler.std) == ([2.0, 5.0], [1.0, 1.0])
    assert sorted(tuple(r[0]) for r in scaler.apply(df).collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_one_hot_aligns_to_train(spark):
    train = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    test = spark.createDataFrame([("c", 3), ("b", 4)], "s string, n int")
    encoder = pp.fit_one_hot(train, ("s",))
    assert pp.feature_names(train, encoder, ()) == ["n", "s_a", "s_b"]
    assert sorted(r["features"] for r in pp.feature_matrix(test, encoder, ()).collect()) == [[3.0, 0.0, 0.0], [4.0, 0.0, 1.0]]


def test_metrics_with_an_absent_class(spark):
    df = spark.createDataFrame([("m", "t", 0, 0), ("m", "t", 0, 2), ("m", "t", 1, 1), ("m", "t", 1, 0)], "model string, split string, y int, p int")
    r = mt.scores(mt.confusion_counts(df)).first()
    f1 = [0.5, 2 / 3, 0.0]
    assert r["accuracy"] == 0.5 and r["f1_macro"] == pytest.approx(sum(f1) / 3) and r["f1_weighted"] == pytest.approx((f1[0] + f1[1]) / 2)


def test_constant_column_correlates_last(spark):
    df = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 7, 1)], "a int, b int, y int")
    top = fl.top_correlated(fl.label_correlations(df, ("a", "b"), "y"), 2).collect()
    assert [r["column"] for r in top] == ["a", "b"] and top[1]["correlation"] is None


def test_bounded_collect_refuses(spark):
    with pytest.raises(ValueError):
        pp.collect_bounded(spark.range(11), 10, "x")
