"""The stages of the pipeline, each held against a plain version on its own input, and the registered queries."""

import re

import corpus_pipeline
import __spark_entry__ as entry
from wardflow.llm import mixing, neardup, quality, secrets
from wardflow.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = set(entry.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names


def test_stages(spark, sf_dir, tmp_path):
    docs, kept = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((name, before, docs))
    assert [n for n, _, _ in kept] == ["quality", "near_dedup", "secrets", "mix", "tokens"]
    assert all(after.columns == COLUMNS for _, _, after in kept[:-1])
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    _, before, after = kept[0]
    scored = quality.score_documents(before, table(spark, sf_dir, "labels"))
    assert ids(after) == ids(scored.filter("predicted = 1")) and len(ids(after)) < before.count()
    _, before, after = kept[1]
    assert ids(after) == ids(neardup.near_duplicates(before).filter("kept")) and neardup.near_duplicates(after).filter("NOT kept").count() == 0
    _, before, after = kept[2]
    assert ids(after) == ids(before) and secrets.scan(after).filter("size(spans) > 0").count() == 0
    _, before, after = kept[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert ids(after) == sorted(i for i, n in copies.items() for _ in range(n))
    _, before, after = kept[4]
    assert ids(after) == ids(before) and after.filter("n_tokens = 0").count() == 0


def written(spark, docs, good, folder):
    """A folder with `docs` and labels that call the ids in `good` good and nine made ids bad."""
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in range(9000, 9009)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, odd, tmp_path):
    """Null and repeated ids, null and empty texts, very long ones, extra columns: every stage decides on each row."""
    folder, kept = written(spark, odd, range(1, 14), tmp_path), []
    docs = table(spark, folder, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        assert name == "tokens" or docs.columns == COLUMNS
    ids = [sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i)) for df in kept]
    assert ids[0] == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11, 12, 13, None]  # only good labels were learned from
    assert ids[1] == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, None]  # copies of 1 and 8 go, equal rows of 7 become one
    assert ids[2] == ids[1] and ids[4] == ids[3]
    assert set(ids[3]) <= set(ids[2]) and max(ids[3].count(i) for i in ids[3]) <= 3
    assert [r["text"] for r in kept[2].filter("doc_id IN (4, 5)").orderBy("doc_id").collect()] in ([None, ""], ["", ""])


def test_run_over_an_empty_table(spark, none, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, none, [], tmp_path)).count() == 0


def test_a_bad_and_a_good_row_of_one_id(spark, tmp_path):
    """One decision for all rows of an id: they stay if one of them is predicted to be good."""
    good, bad = "the river runs past the old mill and the road goes on to the town. " * 6, "$$ ## %% && @@ !! ~~ || {} <> == ++ ** ^^ // " * 9
    rows = [(i, (good if i % 2 else bad) + f"{i}", "en", "a", 1) for i in range(400)] + [(1000, good + "x", "en", "a", 1), (1000, bad + "x", "en", "a", 1), (1002, bad + "y", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = [r["doc_id"] for r in corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).collect()]
    assert left.count(1000) == 2 and 1002 not in left and all(i % 2 for i in left if i < 400) and len(left) == 202
