"""Documents to tokens in five stages: quality, near duplicates, secrets, source mix, byte-level BPE."""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import bpe, mixing, neardup, quality, secrets
from wardflow.llm.common import table
from wardflow.llm.queries import RANKS, digest_rows
from wardflow.session import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, decided: DataFrame, keep: str) -> DataFrame:
    """The documents whose id is decided to stay, all rows of an id if any of them is; a null id is an id like others."""
    ids = decided.filter(keep).select("doc_id").distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, predicts to be good."""
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"))
    return _only(docs, scored, "predicted = 1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; equal rows become one."""
    return _only(docs, neardup.near_duplicates(docs), "kept").dropDuplicates(["doc_id", "text"])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each copy of which at least half is taken, so some leave and some repeat."""
    mixed = mixing.mix(docs, keep=COLUMNS[1:])
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes they decode to, one row per document of the mix."""
    return digest_rows(bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [
    ("quality", quality_filter), ("near_dedup", near_dedup), ("secrets", redact_secrets), ("mix", mix_sources), ("tokens", tokenize),
]
ORACLE_SQL = None  # a fitted classifier and similarity groups are not SQL; the tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
